import json
import pathlib

import pytest
from pyspark.sql import functions as F

from loomtrace import cli
from loomtrace.plans import rollouts
from loomtrace.sources import logs, sinks
from loomtrace.streaming import live
from loomtrace.streaming.tail import TailReader, TailSource


def test_offsets_of_a_growing_file(tmp_path):
    file = tmp_path / "a.jsonl"
    reader = TailReader({"path": str(tmp_path / "*.jsonl")})
    read = lambda a, b: [line for piece in reader.partitions(a, b) for _, _, line in reader.read(piece)]
    file.write_bytes("one\r\ntwo é\nhalf".encode())
    first = reader.latestOffset()
    assert read({}, first) == ["one", "two é"]
    with open(file, "ab") as more:
        more.write("-written x\n".encode())
    second = reader.latestOffset()
    assert read(first, second) == ["half-written x"] and read(second, second) == []
    file.write_bytes(b"new\n")
    assert read(second, reader.latestOffset()) == ["new"]
    assert TailReader({"path": str(tmp_path / "*.jsonl"), "startAtEnd": "true"}).initialOffset() == {str(file): 4}


def test_a_backlog_is_taken_in_batches(spark, tmp_path):
    """About so many bytes in a batch, whatever lines they cut; nothing is lost or read twice."""
    want = {}
    for name in ("a", "b"):
        want[name] = [f"{name} line {k}" for k in range(100)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(want[name]) + "\nhalf")
    reader = TailReader({"path": f"file://{tmp_path}/*.jsonl", "maxBytesPerBatch": "500"})
    at, got, batches = reader.initialOffset(), [], 0
    while (end := reader.latestOffset()) != at:
        assert sum(end.values()) - sum(at.values()) <= 500
        got += [line for piece in reader.partitions(at, end) for _, _, line in reader.read(piece)]
        at, batches = end, batches + 1
    assert got == want["a"] + want["b"] and batches == 4
    # In a run of Spark what is there at its start is one batch; what comes later is bounded.
    spark.dataSource.register(TailSource)
    stream = spark.readStream.format("loomtrace_tail").option("path", f"{tmp_path}/*.jsonl").option("maxBytesPerBatch", "500").load()
    sizes = []
    query = stream.writeStream.foreachBatch(lambda df, _: sizes.append(df.count())).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="0 seconds").start()
    query.processAllAvailable()
    with open(tmp_path / "b.jsonl", "a") as more:
        more.write("\n" + "\n".join(want["b"]) * 3 + "\n")
    query.processAllAvailable()
    query.stop()
    assert sum(sizes) == 201 + 298 and sizes[0] == 200 and len(sizes) >= 6


def test_ranges_split_at_lines(tmp_path, monkeypatch):
    from loomtrace.streaming import tail

    monkeypatch.setattr(tail, "RANGE", 7)
    lines = [f"line {k}" * (k % 4) for k in range(50)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    reader = TailReader({"path": str(tmp_path / "*.jsonl")})
    assert [line for piece in reader.partitions({}, reader.latestOffset()) for _, _, line in reader.read(piece)] == lines


ENTRIES = [
    ("session_meta", {"id": "th", "model": "m0"}), ("turn_context", {"turn_id": "t1", "model": "m1"}), ("response_item", {"type": "function_call", "call_id": "c", "name": "spawn_agent", "arguments": '{"message": "go"}'}),
    ("event_msg", {"type": "user_message", "message": "hi"}), ("response_item", {"type": "function_call_output", "call_id": "c", "output": '{"id": "a"}'}), ("event_msg", {"type": "exec_command_end", "call_id": "c", "stdout": "o"}), ("event_msg", {"type": "task_complete", "turn_id": "t2"}),
]


def test_a_stream_says_what_the_batch_says(spark, tmp_path):
    """Entries come in two batches; names, turns and models are carried from the first to the second."""
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [json.dumps({"timestamp": "t", "type": kind, "payload": payload}) + "\n" for kind, payload in ENTRIES]
    spark.dataSource.register(TailSource)

    def run():
        stream = live.entries(spark.readStream.format("loomtrace_tail").option("path", f"{folder}/*.jsonl").load())
        stream = stream.withColumn("request_backfill", F.lit(True)).withColumn("response_backfill", F.lit(True))
        live.append(live.once(live.rollout_events(stream)), f"{tmp_path}/out", f"{tmp_path}/checkpoint", {"availableNow": True}).awaitTermination(120)

    for some in (lines[:3], lines[3:]):
        for name in ("a", "b"):
            with open(folder / f"rollout-{name}.jsonl", "a") as file:
                file.writelines(some)
        run()
    fields = ["emit", "turn_id", "thread_id", "event_type", "target_name", "content"]
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").where("path like '%-a.jsonl'").select("entry_index", *fields).collect()))
    whole = rollouts.canonical(logs.json_lines(spark, f"{folder}/rollout-a.jsonl").withColumn("request_backfill", F.lit(True)).withColumn("response_backfill", F.lit(True)))
    want = sorted(map(tuple, whole.select("entry_index", *fields).collect()))
    # The same call of the second file is one that is known.
    kinds = {r.event_type for r in spark.read.parquet(f"{tmp_path}/out").where("path like '%-b.jsonl'").collect()}
    both = [r[1:] for r in got]
    assert len(spark.read.parquet(f"{tmp_path}/out").where("event_type = 'tool_call_requested'").collect()) == 1
    assert set(both) <= {r[1:] for r in want} and {"user_input", "codex_task_complete", "tool_call_stdout"} <= kinds
    assert [r[1:] for r in got if "tool_call" not in r[4] and "subagent" not in r[4]] == [r[1:] for r in want if "tool_call" not in r[4] and "subagent" not in r[4]]


def test_sessions_with_equal_calls_and_a_file_written_anew(spark, tmp_path):
    """Two sessions use one call id; then a file is truncated, and starts with a line of no entry."""
    folder = tmp_path / "in"
    folder.mkdir()
    line = lambda kind, **payload: json.dumps({"timestamp": "t", "type": kind, "payload": payload}) + "\n"
    call = line("response_item", type="function_call", call_id="c", name="f", arguments="{}")
    spark.dataSource.register(TailSource)

    def run():
        stream = live.entries(spark.readStream.format("loomtrace_tail").option("path", f"{folder}/*.jsonl").load())
        stream = stream.withColumn("request_backfill", F.lit(True)).withColumn("response_backfill", F.lit(True))
        live.append(live.once(live.rollout_events(stream)), f"{tmp_path}/out", f"{tmp_path}/checkpoint", {"availableNow": True}).awaitTermination(120)
        return spark.read.parquet(f"{tmp_path}/out")

    for name in ("a", "b"):
        (folder / f"{name}.jsonl").write_text(line("session_meta", id=name) + line("turn_context", turn_id=f"turn-{name}") + call + line("event_msg", type="user_message", message="old"))
    asked = lambda events: sorted(r.thread_id for r in events.where("event_type = 'tool_call_requested'").collect())
    assert asked(run()) == ["a", "b"]
    (folder / "a.jsonl").write_text("x\n" + line("session_meta", id="new") + call)
    assert asked(run()) == ["a", "b", "new"]
    (folder / "a.jsonl").write_text(line("session_meta", id="last"))
    events = run()
    again = {(r.thread_id, r.turn_id, r.event_type, r.generation) for r in events.where("generation > 0").collect()}
    assert {("new", None, "tool_call_requested", 1), ("new", None, "codex_session_meta", 1), ("last", None, "codex_session_meta", 2)} <= again
    assert events.where("event_type = 'codex_session_meta'").count() == 4 and events.where("event_type = 'user_input'").count() == 2


def rollout_run(spark, folder):
    """What a run of the stream gives in all, and the keys of its state."""
    stream = spark.readStream.schema("path string, entry_index long, value string").parquet(f"{folder}/in").withColumn("value", F.parse_json("value"))
    stream = stream.withColumn("request_backfill", F.lit(True)).withColumn("response_backfill", F.lit(True))
    query = live.append(live.rollout_events(stream), f"{folder}/out", f"{folder}/checkpoint", {"availableNow": True})
    query.awaitTermination(120)
    return spark.read.parquet(f"{folder}/out"), next(p for p in reversed(query.recentProgress) if p["numInputRows"])["stateOperators"][0]["numRowsTotal"]


def rollout_rows(spark, folder, path, entries, at=0):
    rows = [(path, at + k, json.dumps({"type": kind, "payload": payload})) for k, (kind, payload) in enumerate(entries)]
    spark.createDataFrame(rows, "path string, entry_index long, value string").write.mode("append").parquet(f"{folder}/in")


def asking(call, name):
    return "response_item", {"type": "function_call", "call_id": call, "name": name, "arguments": json.dumps({"message": name})}


def answer(call):
    return "response_item", {"type": "function_call_output", "call_id": call, "output": '{"id": "a"}'}


def test_files_share_groups_and_calls_stand_with_their_file(spark, tmp_path):
    """Files of a few calls cost one state key each, however many calls they have; without it each call costs accesses of its own."""
    rows = [(f"f{file}", k, json.dumps({"type": kind, "payload": payload})) for file in range(20) for k, (kind, payload) in enumerate([asking(f"c{call}", f"tool{file}") for call in range(8)])]
    spark.createDataFrame(rows, "path string, entry_index long, value string").write.parquet(f"{tmp_path}/in")
    assert rollout_run(spark, tmp_path)[1] == 20
    rows = [(f"f{file}", 8, json.dumps({"type": kind, "payload": payload})) for file in range(20) for kind, payload in [answer("c3")]]
    spark.createDataFrame(rows, "path string, entry_index long, value string").write.mode("append").parquet(f"{tmp_path}/in")
    events, keys = rollout_run(spark, tmp_path)
    got = {(r.path, json.loads(r.content)["tool_name"]) for r in events.where("event_type = 'tool_call_result'").collect()}
    assert keys == 20 and got == {(f"f{file}", f"tool{file}") for file in range(20)}


class States(dict):
    containsKey, getValue, updateValue = dict.__contains__, dict.__getitem__, dict.__setitem__


def test_no_calls_stand_with_a_file_where_they_are_forgotten():
    names, arguments = States(), States()
    calls = live.Calls("p", names, arguments, {}, False)
    calls.learn("c", "f", "{}")
    calls.learn("c", "g", None)
    assert calls.kept(0) == ("{}", True) and names == {("p", "c"): ("g",)} and arguments == {("p", "c"): ("{}",)}
    later = live.Calls("p", names, arguments, {}, True)
    assert (later.name("c"), later.said("c"), later.name("d"), later.said(None)) == ("g", "{}", None, None)


def test_older_calls_than_stand_with_a_file(spark, tmp_path):
    """Calls of long ago, calls of long arguments and calls named twice are known, as over the whole file; a file written anew knows none."""
    calls = [asking(f"c{k}", "spawn_agent" if k % 7 == 0 else f"tool{k}") for k in range(100)] + [asking("long", "x" * 5000), asking("c1", "again")]
    rollout_rows(spark, tmp_path, "a", calls)
    rollout_rows(spark, tmp_path, "b", [asking("c5", "other")])
    rollout_run(spark, tmp_path)
    rollout_rows(spark, tmp_path, "a", [answer(c) for c in ("c0", "c1", "c50", "c99", "long", "none")] + [("response_item", {"type": "custom_tool_call", "call_id": "c0", "name": "named", "input": "{}"}), answer("c0")], at=len(calls))
    rollout_rows(spark, tmp_path, "b", [answer("c5"), answer("c50")], at=1)
    events, _ = rollout_run(spark, tmp_path)
    fields = ["path", "entry_index", "emit", "turn_id", "thread_id", "event_type", "target_name", "content"]
    whole = rollouts.canonical(spark.read.parquet(f"{tmp_path}/in").withColumn("value", F.parse_json("value")).withColumn("request_backfill", F.lit(True)).withColumn("response_backfill", F.lit(True)))
    by = lambda df: sorted(map(repr, df.select(*fields).collect()))
    assert by(events) == by(whole) and events.where("event_type = 'subagent_spawned'").count() == 1
    rollout_rows(spark, tmp_path, "a", [answer("c0"), answer("c99"), answer("long")])
    events, keys = rollout_run(spark, tmp_path)
    assert [r.content for r in events.where("generation = 1").collect() if "tool_name" in r.content] == [] and events.where("generation = 1").count() == 3
    assert keys == 2


def test_command_line_and_sinks(spark, tmp_path):
    for name in ("s1", "s2"):
        folder = tmp_path / "sessions" / name
        folder.mkdir(parents=True)
        lines = [{"event_type": "user_input", "content": {"text": "go"}}, {"event_type": "tool_call_requested", "content": {"tool_name": "exec_command", "tool_call_id": "c", "arguments": {"cmd": "pwd"}}}]
        (folder / "events.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    (tmp_path / "sessions" / "s1" / "manifest.json").write_text("{}")
    cli.main(["cases", f"{tmp_path}/sessions", f"{tmp_path}/out"])
    cli.main(["render", f"{tmp_path}/sessions", f"{tmp_path}/out", "--session", "s2"])
    text = lambda pattern: "".join(p.read_text() for p in sorted(pathlib.Path(tmp_path, "out").glob(pattern)))
    assert json.loads(text("cases/session_id=s1/*.txt"))["case_id"] == "s1:action_0001"
    assert "- case_count: 1" in text("reviews/session_id=s2/*.txt") and "# Session Report: s2" in text("reports/session_id=s2/*.txt") and not text("reports/session_id=s1/*.txt")
    left = spark.createDataFrame([("a", {"x": "1", "y": "2"}), ("b", {"x": "1"})], "session_id string, manifest map<string,string>")
    right = spark.createDataFrame([("a", {"y": "3"})], "session_id string, manifest map<string,string>")
    assert {r.session_id: r.manifest for r in sinks.merged(left, right).collect()} == {"a": {"x": "1", "y": "3"}, "b": {"x": "1"}}


@pytest.mark.parametrize("name, want", [("Authorization", "<redacted>"), ("X-Other", "v")])
def test_headers(spark, name, want):
    from loomtrace.functions import text

    row = spark.range(1).select(text.end_to_end(text.redact(F.create_map(F.lit(name), F.lit("v"), F.lit("TE"), F.lit("x")))).alias("h"), text.option(F.array(F.lit("--a=b=c"), F.lit("--d"), F.lit("e")), "--a").alias("a"), text.option(F.array(F.lit("--a=b=c"), F.lit("--d"), F.lit("e")), "--d").alias("d")).first()
    assert row.h == {name: want} and row.a == "b=c" and row.d == "e"


def test_counters_count_a_repeated_batch_once(spark, tmp_path):
    checkpoint = f"file:{tmp_path}/c"
    assert live.totals(checkpoint) == {}
    for number, seen in ((0, {"a": 2, "b": 0}), (1, {"a": 3, "b": 1}), (1, {"a": 3, "b": 1}), (2, {"a": 0, "b": None}), (2, {"a": 1, "b": 0})):
        live._count(checkpoint, number, seen)
    assert live.totals(checkpoint) == {"a": 6, "b": 1} and len(list((tmp_path / "c/counters").iterdir())) == 2
