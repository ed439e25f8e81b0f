import json

import pytest
from pyspark.sql import functions as F

from loomtrace import cli
from loomtrace.functions import emit
from loomtrace.plans import imports, messages, reconcile, rollouts
from loomtrace.sources import bodies, logs, sinks
from loomtrace.streaming import live


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "a") as file:
        file.writelines(json.dumps(line) + "\n" for line in lines)


def entry(kind, **payload):
    return {"timestamp": "2024-01-01T00:00:10.000Z", "type": kind, "payload": payload}


def test_two_ticks(spark, tmp_path):
    log, rollout = tmp_path / "sessions/s1/events.jsonl", tmp_path / "codex/2024/rollout-x-th-1.jsonl"
    write(log, {"event_type": "session_started", "content": {}}, {"event_type": "llm_request", "content": {"codex_thread_id": "th-1"}})
    write(tmp_path / "sessions/s2/events.jsonl", {"event_type": "session_started", "content": {}})
    write(rollout, entry("session_meta", id="th-1", cwd="/w", model="m"), entry("response_item", type="custom_tool_call", call_id="c1", name="apply_patch", input="{}"))
    history = [(0, "th-1", 1704067300.9, "go"), (1, "other", 1704067300.0, "no"), (2, "th-1", 5.0, "too old"), (3, "th-1", None, "untimed")]
    sessions = spark.createDataFrame([("s1", "/w", 1704067200.0), ("s2", "/else", 1704067200.0)], "session_id string, cwd string, started double")

    def tick(state=None, rows=history, final=False):
        entries = logs.json_lines(spark, f"{tmp_path}/codex/*/*.jsonl")
        said = spark.createDataFrame(rows, "history_row long, session_id string, ts double, text string")
        return reconcile.tick(sessions, logs.events(spark, f"{tmp_path}/sessions/*/events.jsonl"), entries, said, state, final)

    first = tick()
    one, two = sorted(first.summaries.collect())
    assert one.thread_ids == ["th-1"] and one.rollout_entries_imported == 2 and one.history_entries_imported == 2 and one.authz_refreshed and one.authz_case_count == 1
    assert [p.rsplit("/", 1)[1] for p in one.rollout_paths] == ["rollout-x-th-1.jsonl"] and two.thread_ids == [] and not two.authz_refreshed and two.rollout_events_imported == 0
    kinds = [r.event_type for r in first.events.orderBy(F.col("path").isNull(), "entry_index", "emit").collect()]
    assert kinds == ["codex_session_meta", "tool_call_requested", "tool_call_dispatched", "user_input", "user_input"]
    write(rollout, entry("event_msg", type="patch_apply_end", call_id="c1", stdout="done", success=True))
    second = tick(first.state, [*history, (4, "th-1", 1704067400.0, "more")])
    one = sorted(second.summaries.collect())[0]
    assert (one.rollout_entries_imported, one.rollout_entries_total, one.history_entries_imported, one.history_entries_total, one.authz_refreshed) == (1, 3, 1, 3, False)
    told = {r.event_type: json.loads(r.content) for r in second.events.collect()}
    assert told["tool_call_result"]["tool_name"] == "apply_patch" and told["user_input"] == {"text": "more", "codex_thread_id": "th-1", "history_index": 0}
    rollout.write_text("")
    write(rollout, entry("session_meta", id="th-1", cwd="/w"))
    third = tick(second.state, [*history, (4, "th-1", 1704067400.0, "more")], final=True)
    assert [r.event_type for r in third.events.collect()] == ["codex_session_meta"] and sorted(third.summaries.collect())[1].authz_refreshed
    closed = reconcile.reconciled_events(third.summaries).collect()
    assert sorted(json.loads(r.content)["rollout_entries_total"] for r in closed) == [0, 4]


@pytest.mark.parametrize("nested, want", [
    ([{"type": "tool_result", "content": [{"type": "tool_result", "content": [{"type": "tool_result", "content": [{"type": "text", "text": "a"}, "b"]}]}]}, "c"], "a\nb\nc"),
    ({"content": {"content": {"content": {"content": {"text": "deep"}}}}}, "deep"), ([["not", "read"], {"type": "thinking", "thinking": "hm"}, {"type": "text", "text": ""}], "hm"),
    ({"content": [{"type": "tool_result", "content": "x"}]}, "x"), (5, "5"), (True, "True"), ({"a": [1, None]}, "{'a': [1, None]}"), (None, ""), ("", ""),
])
def test_nested_text(spark, nested, want):
    """Text is followed however deep it lies; the chat dialect and results of calls say the same."""
    row = spark.createDataFrame([(json.dumps(nested),)], "t string").select(F.parse_json("t").alias("v")).select(emit.text(F.when(~F.is_variant_null("v"), F.col("v"))).alias("t")).first()
    assert row.t == want
    payload = spark.createDataFrame([(1, json.dumps({"messages": [{"role": "user", "content": nested}]}))], "key long, t string").select("key", F.parse_json("t").alias("payload"))
    assert json.loads(messages.chat_requests(payload).first().content)["text"] == want


def test_depth_has_no_limit(spark):
    value = "end"
    for _ in range(200):
        value = [{"type": "tool_result", "content": value}]
    assert "".join(emit.pieces(value)) == "end" and "".join(emit.pieces(value, False)) == ""
    entries = spark.createDataFrame([("p", 0, json.dumps(entry("response_item", type="message", role="user", content={"content": {"content": {"content": "in"}}})))], "path string, entry_index long, t string")
    found = rollouts.canonical(entries.select("path", "entry_index", F.parse_json("t").alias("value"), F.lit(True).alias("request_backfill"), F.lit(True).alias("response_backfill")))
    assert [json.loads(r.content)["text"] for r in found.collect()] == ["in"]


def test_staged_tables(spark):
    sessions = spark.createDataFrame([("s", "t1"), ("s", "t2")], "session_id string, thread_id string")
    threads = spark.createDataFrame([("t1", 20, "/w", "main", "abc"), ("t2", 10, "/w", None, None), ("t3", 1, "/", None, None)], "id string, updated_at long, cwd string, git_branch string, git_sha string")
    found = imports.thread_events(imports.threads_of(threads, sessions)).orderBy("place").collect()
    assert [(r.event_type, r.target_name) for r in found] == [("codex_threads_imported", "codex"), ("codex_thread_detected", "t2"), ("codex_thread_detected", "t1")] and json.loads(found[0].content) == {"count": 2}
    edges = spark.createDataFrame([("t1", "c2", "open"), ("t1", "c1", "done"), ("x", "y", "open")], "parent_thread_id string, child_thread_id string, status string")
    assert [r.target_name for r in imports.edge_events(imports.edges_of(edges, sessions)).orderBy("place").collect()] == ["codex", "c1", "c2"]
    lines = spark.createDataFrame([(k, "t1", 5 + k // 2, 1 - k % 2) for k in range(10)] + [(99, "t9", 9, 0)], "id long, thread_id string, ts long, ts_nanos long")
    some = imports.log_lines(lines, spark.createDataFrame([("t1", 6)], "thread_id string, started long"), 3)
    assert [r.id for r in some.orderBy("place").collect()] == [3, 2, 5] and json.loads(imports.log_events(some, sessions).first().content) == {"codex_thread_id": "t1", "count": 3}
    rows = spark.createDataFrame([("t1", 5.9, "a"), ("t9", None, "b"), ("t1", 4.0, "c")], "session_id string, ts double, text string")
    kept = lambda *given: sorted(r.text for r in imports.history_kept(rows, *given).collect())
    assert kept(sessions, 5) == ["a"] and kept(sessions.limit(0), 5) == ["a", "b"] and kept(None, None) == ["a", "b", "c"]


def test_requests_and_places(spark):
    row = spark.range(1)
    meta = lambda **headers: row.select(imports.request_metadata(F.create_map(*[F.lit(x) for pair in headers.items() for x in pair])).alias("m")).first().m
    found = meta(**{"x-codex-turn-metadata": '{"turn_id": "t", "session_id": ""}', "Session-Id": "s", "x-codex-window-id": "w"})
    assert (found.turn_id, found.codex_thread_id, found.codex_window_id) == ("t", "s", "w")
    assert json.loads(meta(**{"X-Codex-Turn-Metadata": "{oops"}).codex_turn_metadata) == {"raw": "{oops"}
    urls = row.select(imports.upstream(F.lit("https://h:1/api/"), F.lit("/v1/x?q=1")).alias("a"), imports.upstream(F.lit("http://h"), F.lit("/v1")).alias("b"), imports.host_digest(F.lit("h")).alias("h")).first()
    assert tuple(urls.a) == ("https://h:1/api/v1/x?q=1", "/api/v1/x?q=1") and urls.b.url == "http://h/v1" and len(urls.h) == 12
    bodies_ = spark.createDataFrame([(' {"a": 1}', None), ("[1]", "text/plain"), ("a", "application/json"), ('"s"', "application/JSON"), ("plain", None)], "body string, type string")
    assert [r[0] for r in bodies_.select(F.to_json(bodies.json_body(F.col("body"), F.col("type")))).collect()] == ['{"a":1}', "[1]", None, '"s"', None]


def test_cache_trace_rows_count_once(spark, tmp_path):
    row = {"messages": [{"role": "user", "content": "u"}], "prompt": "p"}
    write(tmp_path / "t/trace.jsonl", row, dict(reversed(row.items())), {"prompt": {"a": 1}})
    found = messages.cache_trace(logs.json_lines(spark, f"{tmp_path}/t/trace.jsonl")).orderBy("key", "item", "emit").collect()
    assert [r.event_type for r in found] == ["openclaw_cache_trace_imported", "request_user_message", "request_system_message", "openclaw_cache_trace_imported", "request_system_message"]
    assert json.loads(found[0].content) == {"row_index": 0, "keys": ["messages", "prompt"]} and found[1].parent_event_id == found[0].event_id and found[4].platform_metadata.source == "openclaw_cache_trace.prompt" and found[2].visibility.user_visible is False


def test_blocks_that_stream(spark, tmp_path):
    """Blocks are put together across batches and say what whole streams say."""
    said = [("message_start", {"message": {"model": "m"}}), ("content_block_start", {"index": 0, "content_block": {"type": "text", "text": "a"}}), ("content_block_delta", {"index": 0, "delta": {"type": "text_delta", "text": "b"}}),
            ("content_block_start", {"index": 1, "content_block": {"type": "tool_use", "id": "c", "name": "f"}}), ("content_block_stop", {"index": 0}), ("content_block_delta", {"index": 1, "delta": {"type": "input_json_delta", "partial_json": '{"k": 1}'}}), ("content_block_stop", {"index": 1})]
    rows = [("s", k, name, json.dumps(data)) for k, (name, data) in enumerate(said)]
    schema = "key string, block long, event string, data string"
    opened = lambda df: df.withColumn("data", F.parse_json("data"))
    for k, some in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        live.append(live.assembled(opened(spark.readStream.schema(schema).json(f"{tmp_path}/in"))), f"{tmp_path}/out", f"{tmp_path}/checkpoint", {"availableNow": True}).awaitTermination(120)
    fields = ["key", "item", "emit", "event_type", "target_name", "content"]
    want = sorted(map(tuple, messages.block_streams(opened(spark.createDataFrame(rows, schema))).select(*fields).collect()))
    assert len(want) == 2 and sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(*fields).collect())) == want


def test_sessions_that_are_not_written_stay(spark, tmp_path):
    for name in ("s1", "s2"):
        write(tmp_path / f"sessions/{name}/events.jsonl", {"event_type": "user_input", "content": {"text": name}}, {"event_type": "tool_call_requested", "content": {"tool_name": "t", "tool_call_id": "c", "arguments": {}}})
    root, out = f"{tmp_path}/sessions", f"{tmp_path}/out"
    cli.main(["cases", root, out])
    cli.main(["cases", root, out, "--session", "s2"])
    cli.main(["render", root, out, "--session-dir", f"{root}/s1", "--session", "s2"])
    there = lambda kind: sorted(p.parent.name for p in (tmp_path / "out" / kind).glob("*/*.txt"))
    assert there("cases") == there("reviews") == ["session_id=s1", "session_id=s2"] and there("reports") == ["session_id=s1"]
    told = [json.loads(line) for p in (tmp_path / "out/events").glob("session_id=s2/*.txt") for line in p.read_text().splitlines()]
    assert sorted(t["event_type"] for t in told) == ["authz_cases_generated"] * 2 and told[0]["content"]["case_count"] == 1
    with pytest.raises(Exception, match="no session|Path does not exist|PATH_NOT_FOUND"):
        cli.main(["render", root, out, "--session", "nowhere"])
    events = spark.createDataFrame([("a", "x", 1)], "session_id string, event_type string, place int")
    sinks.write_events(events, f"{tmp_path}/log")
    sinks.write_events(events, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2


def test_manifest_lists_as_python_writes_them(spark, tmp_path):
    from loomtrace.plans import report

    write(tmp_path / "sessions/s/events.jsonl", {"event_type": "user_input", "content": {"text": "x"}})
    (tmp_path / "sessions/s/manifest.json").write_text(json.dumps({"command": ["bash", "-lc", "curl https://x.y/z,w"]}))
    text = report.build(logs.events(spark, f"{tmp_path}/sessions/*/events.jsonl"), logs.manifests(spark, f"{tmp_path}/sessions/*/manifest.json")).first().text
    assert '- command: ["bash", "-lc", "curl https://x.y/z,w"]' in text


def test_prefixes_after_any_white_space(spark):
    from loomtrace import vocabulary as V
    from loomtrace.functions import text

    df = spark.createDataFrame([("\n rm -rf x",), ("\trm x",), (" rm",), ("arm",), ("git\tpush",)], "c string")
    assert [r[0] for r in df.select(text.starts_with_any(F.col("c"), V.WRITE_PREFIXES)).collect()] == [True, True, True, False, False]
