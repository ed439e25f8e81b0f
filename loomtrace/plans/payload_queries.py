"""Queries over payloads, files and streams that are made of the driver's tables, each with the SQL that says the same.

A conversation is one payload, and `turn % n` decides which form a turn takes, so that every branch of a dialect has
rows. Files and streams are written to and read from the session's shared folder.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import text as X
from ..functions import values as J
from ..operators import events as E
from ..session import cut, scratch, table
from ..sources import artifacts, bodies, logs, sinks, store
from ..streaming import live, tail
from . import cases, imports, messages, reconcile, report, rollouts, ticks
from .queries import CARRIED, CASES, REPORT_TEXT, _entries, _manifests, _recorded, chat, log, query

TURN = "event_index"


def json(**fields: Column | str | int) -> Column:
    return F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]))


def utc() -> Column:
    """The time of a row of `events`, which has no zone, as text in UTC."""
    return F.concat(F.col("ts").cast("string"), F.lit("Z"))


def raw(text: Column | str) -> Column:
    """JSON text as a value inside of other JSON."""
    return F.parse_json(text if isinstance(text, Column) else F.lit(text))


def by_turn(*forms: Column) -> Column:
    """The form of a turn by its number."""
    chosen = F.when(F.lit(False), forms[0])
    for k, form in enumerate(forms):
        chosen = chosen.when(F.col(TURN) % len(forms) == k, form)
    return chosen


def payloads(spark, sf_dir, form: Column, head: str = "{", name: str = "messages") -> DataFrame:
    """Each conversation as a payload with its turns, in their forms, as one list."""
    joined = E.joined_in_order(chat(spark, sf_dir).withColumn("form", form), "form", ["session_id"], separator=", ", name="list")
    return joined.select(F.col("session_id").alias("key"), F.parse_json(F.concat(F.lit(f'{head}"{name}": ['), "list", F.lit("]}"))).alias("payload"))


def told(found: DataFrame, *fields: str) -> DataFrame:
    """key, item, event_type and some fields of the content, as text."""
    return found.select("key", F.col("item").cast("long").alias("item"), "event_type", *[F.get_json_object("content", f"$.{f}").alias(f) for f in fields])


NUMBER = lambda name: F.concat(F.lit(name), F.col(TURN).cast("string"))


@query("""SELECT session_id AS key, event_index AS item, CASE event_index % 3 WHEN 1 THEN 'tool_call_result_attached' WHEN 2 THEN 'request_message' ELSE 'request_user_message' END AS event_type,
          CASE event_index % 3 WHEN 0 THEN text || chr(10) || 'end' WHEN 1 THEN text ELSE text END AS text, CASE WHEN event_index % 3 = 1 THEN 'c' || event_index END AS tool_call_id FROM chat
          UNION ALL SELECT DISTINCT session_id, -1, 'request_system_message', 'rules', NULL FROM chat""")
def chat_request_branches(spark, sf_dir):
    """A system prompt, tools and other roles; text lies five levels deep"""
    said = F.struct(F.lit("text").alias("type"), "text")
    for _ in range(5):
        said = F.struct(F.lit("tool_result").alias("type"), F.array(said).alias("content"))
    nested = F.array(raw(F.to_json(said)), raw('"end"'))
    forms = by_turn(json(role="user", content=nested), json(role="tool", tool_call_id=NUMBER("c"), content=F.struct(F.struct(F.struct(F.col("text").alias("text")).alias("content")).alias("content"))), json(role="other", content=F.struct("text")))
    return told(messages.chat_requests(payloads(spark, sf_dir, forms, '{"system": "rules", ')), "text", "tool_call_id")


@query("""SELECT session_id AS key, event_index AS item, unnest(CASE event_index % 4 WHEN 0 THEN ['request_user_message'] WHEN 1 THEN ['assistant_reasoning_final', 'tool_call_requested', 'subagent_spawn_requested', 'request_assistant_message']
          WHEN 2 THEN ['tool_call_result_attached'] ELSE ['assistant_reasoning_final'] END) AS event_type, unnest(CASE event_index % 4 WHEN 0 THEN [text] WHEN 1 THEN ['hm', NULL, NULL, 'one' || chr(10) || text] WHEN 2 THEN [NULL] ELSE [NULL] END) AS text,
          unnest(CASE event_index % 4 WHEN 0 THEN [NULL] WHEN 1 THEN [NULL, 'c' || event_index, 'c' || event_index, NULL] WHEN 2 THEN ['c' || event_index] ELSE [NULL] END) AS tool_call_id,
          unnest(CASE event_index % 4 WHEN 2 THEN [text] WHEN 1 THEN [NULL, NULL, NULL, NULL] ELSE [NULL] END) AS output FROM chat""")
def block_request(spark, sf_dir):
    """Blocks of reasoning, calls, results and text"""
    block = lambda **fields: raw(json(**fields))
    assistant = F.array(block(type="thinking", thinking="hm"), block(type="text", text="one"), block(type="tool_use", id=NUMBER("c"), name="spawn_agent", input=F.struct(F.lit("w").alias("agent_type"))), block(type="output_text", text=F.col("text")))
    forms = by_turn(
        json(role="user", content=F.array(raw(F.to_json(F.struct("text"))))), json(role="assistant", content=assistant),
        json(role="user", content=F.array(block(type="tool_result", tool_use_id=NUMBER("c"), content=F.array(block(type="tool_result", content=F.array(block(type="text", text=F.col("text")))))))), json(role="assistant", content=F.array(block(type="redacted_thinking", data="x"))),
    )
    return told(messages.requests(payloads(spark, sf_dir, forms, '{"anthropic_version": "1", ')), "text", "tool_call_id", "output")


@query("""SELECT session_id AS key, event_index AS item, CASE event_index % 4 WHEN 0 THEN 'request_system_message' WHEN 1 THEN 'tool_call_dispatched' WHEN 2 THEN 'tool_call_result' ELSE 'assistant_reasoning_final' END AS event_type,
          CASE event_index % 4 WHEN 0 THEN text END AS text, CASE event_index % 4 WHEN 1 THEN 't' || event_index WHEN 2 THEN coalesce(called, 'own') END AS tool_name, CASE event_index % 4 WHEN 2 THEN text END AS output, CASE event_index % 4 WHEN 3 THEN text END AS summary_text
          FROM (SELECT *, last_value(CASE event_index % 4 WHEN 1 THEN 't' || event_index END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS called FROM chat)
          UNION ALL SELECT DISTINCT session_id, -1, 'request_system_message', 'obey', NULL, NULL, NULL FROM chat""")
def item_request(spark, sf_dir):
    """Items; outputs have the name of the latest call before them"""
    forms = by_turn(
        json(type="message", role="developer", content=F.col("text")), json(type="function_call", call_id="c", name=NUMBER("t"), arguments='{"a": 1}'), json(type="function_call_output", call_id="c", name="own", output=F.col("text")),
        json(type="reasoning", summary=F.array(raw(json(type="text", text=F.col("text"))))),
    )
    return told(messages.requests(payloads(spark, sf_dir, forms, '{"instructions": "obey", ', "input")), "text", "tool_name", "output", "summary_text")


# What a result of each delegation tool becomes.
RESULTS = {"spawn_agent": "subagent_spawned", "send_input": "subagent_message", "wait_agent": "subagent_result", "resume_agent": "subagent_resumed", "close_agent": "subagent_closed"}
TOOL = "CASE event_index % 5 " + " ".join(f"WHEN {k} THEN '{tool}'" for k, tool in enumerate(V.DELEGATE_TOOLS)) + " END"
RESULT = "CASE event_index % 5 " + " ".join(f"WHEN {k} THEN '{RESULTS[tool]}'" for k, tool in enumerate(V.DELEGATE_TOOLS)) + " END"
AGENT = "CASE event_index % 5 WHEN 0 THEN 'a' || event_index ELSE 't' || event_index END"


@query(f"""SELECT session_id AS key, event_type, tool_call_id, target_name, delivery_state FROM (SELECT session_id, 'c' || event_index AS tool_call_id, event_index, unnest(['tool_call_dispatched', 'tool_call_result', {RESULT}, CASE WHEN event_index % 5 = 1 THEN 'subagent_message' END]) AS event_type,
           unnest([{TOOL}, NULL, {AGENT}, {AGENT}]) AS target_name, unnest([NULL, NULL, CASE WHEN event_index % 5 = 1 THEN 'acknowledged' END, 'dispatched']) AS delivery_state FROM chat) WHERE event_type IS NOT NULL""")
def subagent_stages(spark, sf_dir):
    """What calls and results of delegation tools mean"""
    tool = by_turn(*map(F.lit, V.DELEGATE_TOOLS))
    arguments = json(agent_type="w", target=NUMBER("t"), message=F.col("text"), targets=F.array(NUMBER("t"), F.lit("")))
    pair = F.concat_ws(", ", json(type="function_call", call_id=NUMBER("c"), name=tool, arguments=arguments), json(type="function_call_output", call_id=NUMBER("c"), output=json(id=by_turn(*[NUMBER("a")] + [F.lit(None).cast("string")] * 4))))
    found = messages.requests(payloads(spark, sf_dir, pair, name="input"))
    named = F.when(F.col("event_type") != "tool_call_result", F.col("target_name"))
    return found.select("key", "event_type", F.get_json_object("content", "$.tool_call_id").alias("tool_call_id"), named.alias("target_name"), F.get_json_object("content", "$.delivery_state").alias("delivery_state"))


@query("""SELECT session_id AS key, event_index AS item, unnest(['assistant_text_final', 'tool_call_requested']) AS event_type, unnest([text, NULL]) AS text, unnest([NULL, '{"a":' || event_index || '}']) AS arguments, 'chat' AS dialect FROM chat
          UNION ALL SELECT session_id, event_index, CASE event_index % 2 WHEN 0 THEN 'assistant_text_final' ELSE 'tool_call_requested' END, CASE event_index % 2 WHEN 0 THEN text END, CASE event_index % 2 WHEN 1 THEN 'no json' END, 'items' FROM chat
          UNION ALL SELECT session_id, 0, 'assistant_text_final', string_agg(text, chr(10) ORDER BY event_index), NULL, 'blocks' FROM chat WHERE event_index % 2 = 0 GROUP BY session_id
          UNION ALL SELECT session_id, 0, 'tool_call_requested', NULL, '{"a":' || event_index || '}', 'blocks' FROM chat WHERE event_index % 2 = 1""")
def response_dialects(spark, sf_dir):
    """C5, C9, C10, C11, X8"""
    call = F.struct(F.lit("c").alias("id"), F.struct(F.lit("f").alias("name"), json(a=F.col(TURN)).alias("arguments")).alias("function"))
    chosen = json(message=F.struct(F.col("text").alias("content"), F.array(call).alias("tool_calls")))
    items = by_turn(json(type="message", content=F.array(raw(json(type="output_text", text=F.col("text"))))), json(type="function_call", call_id="c", name="f", arguments="no json"))
    blocks = by_turn(json(type="text", text=F.col("text")), json(type="tool_use", id="c", name="f", input=F.struct(F.col(TURN).alias("a"))))
    made = [payloads(spark, sf_dir, chosen, name="choices").withColumn("dialect", F.lit("chat")), payloads(spark, sf_dir, items, '{"object": "response", ', "output").withColumn("dialect", F.lit("items")), payloads(spark, sf_dir, blocks, name="content").withColumn("dialect", F.lit("blocks"))]
    every = made[0].unionByName(made[1]).unionByName(made[2]).withColumn("key", F.concat_ws(":", "key", "dialect"))
    return told(messages.responses(every), "text", "arguments").withColumns({"dialect": F.split("key", ":")[1], "key": F.split("key", ":")[0].cast("long")})


def events_of(name: str, data: Column) -> Column:
    return F.concat(F.lit(f"event: {name}\ndata: "), data, F.lit("\n\n"))


def streams(spark, sf_dir, form: Column, head: str = "") -> DataFrame:
    joined = E.joined_in_order(chat(spark, sf_dir).withColumn("form", form), "form", ["session_id"], separator="", name="body")
    return joined.select(F.col("session_id").alias("key"), F.concat(F.lit(head), "body").alias("body"))


def pieces() -> Column:
    """A turn as a block of a stream: text in two pieces, or a call; every fifth has no end."""
    at, half = F.col(TURN), F.floor(F.length("text") / 2).cast("int")
    start = by_turn(raw(json(type="text", text=F.substring(F.col("text"), F.lit(1), half))), raw(json(type="tool_use", id="c", name="f")))
    more = by_turn(raw(json(type="text_delta", text=F.substr(F.col("text"), half + 1))), raw(json(type="input_json_delta", partial_json=json(a=at))))
    stop = F.when(at % 5 != 4, events_of("content_block_stop", json(index=at))).otherwise("")
    return F.concat(events_of("content_block_start", json(index=at, content_block=start)), events_of("content_block_delta", json(index=at, delta=more)), stop)


ASSEMBLED = r"""SELECT session_id AS key, event_index AS block_index, CASE event_index % 2 WHEN 0 THEN 'assistant_text_final' ELSE 'tool_call_requested' END AS event_type, 'm' AS model,
          CASE event_index % 2 WHEN 0 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') END AS text, CASE event_index % 2 WHEN 1 THEN '{"a":' || event_index || '}' END AS arguments FROM chat WHERE event_index % 5 <> 4"""


def assembled(found: DataFrame) -> DataFrame:
    model = F.when(F.col("target_kind") == "model", F.col("target_name")).otherwise("m")
    return found.select("key", F.get_json_object("content", "$.block_index").cast("long").alias("block_index"), "event_type", model.alias("model"), F.get_json_object("content", "$.text").alias("text"), F.get_json_object("content", "$.arguments").alias("arguments"))


HEAD = 'event: message_start\ndata: {"message": {"model": "m"}}\n\n'


@query(ASSEMBLED)
def block_assembly(spark, sf_dir):
    """C12, T4 (whole streams), A6"""
    return assembled(messages.response_streams(streams(spark, sf_dir, pieces(), HEAD)))


@query(ASSEMBLED)
def block_assembly_live(spark, sf_dir):
    """The same as a stream with state"""
    folder = f"{scratch(spark)}/blocks-{uuid.uuid4().hex}"
    bodies.stream_events(streams(spark, sf_dir, pieces(), HEAD)).select("key", F.col("block").cast("long").alias("block"), "event", "raw_data").write.parquet(f"{folder}/in")
    blocks = spark.readStream.schema("key long, block long, event string, raw_data string").parquet(f"{folder}/in").withColumn("data", F.try_parse_json("raw_data")).withColumn("key", F.col("key").cast("string"))
    live.append(live.assembled(blocks), f"{folder}/out", f"{folder}/checkpoint", {"availableNow": True}).awaitTermination()
    return assembled(spark.read.parquet(f"{folder}/out").withColumn("key", F.col("key").cast("long")))


@query("""SELECT session_id AS key, unnest(['assistant_text_delta', 'assistant_text_final', 'assistant_text_final', 'assistant_text_final', 'tool_call_requested', 'assistant_reasoning_final']) AS event_type,
          unnest([text, text, text, text, NULL, NULL]) AS text, unnest(['i' || event_index, 'i' || event_index, 'other', 'i' || event_index, NULL, 'r']) AS item_id, unnest([NULL, NULL, NULL, NULL, 'c' || event_index, NULL]) AS tool_call_id, unnest([NULL, NULL, NULL, NULL, NULL, 'why']) AS why FROM chat""")
def item_stream(spark, sf_dir):
    """Pieces, ends, items that repeat an end (left out) or don't, calls, reasoning, and the replay at the end"""
    said = lambda number: F.struct(F.lit("message").alias("type"), F.lit("assistant").alias("role"), number.alias("id"), F.array(F.struct(F.lit("output_text").alias("type"), "text")).alias("content"))
    call = F.struct(F.lit("function_call").alias("type"), NUMBER("c").alias("call_id"), F.lit("f").alias("name"), F.lit("{}").alias("arguments"))
    thought = F.struct(F.lit("reasoning").alias("type"), F.lit("r").alias("id"), F.array(F.struct(F.lit("text").alias("type"), F.lit("why").alias("text"))).alias("summary"))
    done = lambda item: events_of("response.output_item.done", json(item=item))
    form = F.concat(
        events_of("response.output_text.delta", json(delta=F.col("text"), item_id=NUMBER("i"))), events_of("response.output_text.done", json(text=F.col("text"), item_id=NUMBER("i"))), done(said(NUMBER("i"))), done(said(F.lit("other"))), done(call), done(thought),
        events_of("response.completed", json(response=F.struct(F.array(said(NUMBER("i"))).alias("output")))),
    )
    found = messages.response_streams(streams(spark, sf_dir, form))
    get = lambda name: F.get_json_object("content", f"$.{name}")
    reasons = F.col("event_type") == "assistant_reasoning_final"
    return found.select("key", "event_type", F.when(~reasons, get("text")).alias("text"), get("item_id").alias("item_id"), get("tool_call_id").alias("tool_call_id"), F.when(reasons, get("text")).alias("why"))


@query("""SELECT session_id AS key, event_index AS item, unnest(CASE event_index % 4 WHEN 0 THEN ['tool_call_requested', 'assistant_text_final'] WHEN 1 THEN ['tool_call_result'] WHEN 2 THEN ['final_output'] ELSE ['claude_session_init'] END) AS event_type,
          unnest(CASE event_index % 4 WHEN 0 THEN [NULL, text] WHEN 2 THEN [text] ELSE [NULL] END) AS text, unnest(CASE event_index % 4 WHEN 1 THEN [text] WHEN 0 THEN [NULL, NULL] ELSE [NULL] END) AS output, unnest(CASE event_index % 4 WHEN 3 THEN [text] WHEN 0 THEN [NULL, NULL] ELSE [NULL] END) AS cwd FROM chat""")
def transcript(spark, sf_dir):
    """C13, C14"""
    block = lambda **fields: raw(json(**fields))
    message = lambda **fields: F.struct(*[v.alias(k) if isinstance(v, Column) else F.lit(v).alias(k) for k, v in fields.items()])
    form = by_turn(
        json(type="assistant", message=message(role="assistant", content=F.array(block(type="tool_use", id="c", name="f", input=F.struct(F.lit(1).alias("x"))), block(type="text", text=F.col("text"))))),
        json(type="user", message=message(content=F.array(block(type="tool_result", tool_use_id="c", content=F.col("text"))))), json(type="result", result=F.col("text")), json(type="system", subtype="init", cwd=F.col("text")),
    )
    rows = chat(spark, sf_dir).select(F.struct("session_id", F.col(TURN).alias("turn")).alias("key"), F.parse_json(form).alias("payload"))
    found = told(messages.agent_messages(rows), "text", "output", "cwd")
    return found.select(F.col("key.session_id").alias("key"), F.col("key.turn").alias("item"), "event_type", "text", "output", "cwd")


@query("""SELECT session_id, row_index, unnest(['openclaw_cache_trace_imported', 'request_user_message', 'request_system_message']) AS event_type, unnest(['["messages","prompt"]', NULL, NULL]) AS keys, unnest([NULL, text, 'p']) AS text,
          unnest([NULL, 'openclaw_cache_trace.messages', 'openclaw_cache_trace.prompt']) AS source, 'openclaw' AS platform, false AS user_visible FROM (SELECT session_id, text, row_number() OVER (PARTITION BY session_id ORDER BY min(event_index)) - 1 AS row_index FROM chat GROUP BY session_id, text)""")
def cache_trace(spark, sf_dir):
    """Every row comes twice, with its keys in another order"""
    rows, list_ = chat(spark, sf_dir), F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages")
    twice = F.array(F.to_json(F.struct(list_, F.lit("p").alias("prompt"))), F.to_json(F.struct(F.lit("p").alias("prompt"), list_)))
    lines = rows.select(F.col("session_id").cast("string").alias("path"), TURN, F.posexplode(twice).alias("n", "line")).select("path", (2 * F.col(TURN) + F.col("n")).alias("entry_index"), F.parse_json("line").alias("value"))
    found = messages.cache_trace(lines)
    get = lambda name: F.get_json_object("content", f"$.{name}")
    return found.select(F.split("key", ":")[0].cast("long").alias("session_id"), F.split("key", ":")[1].cast("long").alias("row_index"), "event_type", get("keys").alias("keys"), get("text").alias("text"), F.col("platform_metadata.source").alias("source"), "platform", F.col("visibility.user_visible").alias("user_visible"))


# The entries of `rollout_routes` and the events that each becomes.
ROUTES = {
    "task_started": ["codex_task_started"], "turn_aborted": ["codex_turn_aborted"], "context_compacted": ["codex_context_compacted"], "token_count": ["codex_token_count"], "task_complete": ["final_output", "codex_task_complete"], "user_message": ["user_input"],
    "agent_message": ["assistant_text_final"], "exec_command_end": ["tool_call_stdout", "tool_call_stderr", "tool_call_result", "tool_call_error"], "message": ["request_system_message"], "reasoning": ["assistant_reasoning_final"],
    "function_call": ["tool_call_requested", "tool_call_dispatched"], "function_call_output": ["tool_call_result"], "custom_tool_call": ["tool_call_requested", "tool_call_dispatched"], "custom_tool_call_output": ["tool_call_result"], "unknown": [],
}
ROUTE_ROWS = ", ".join(f"({k}, {n}, '{event}')" for k, events in enumerate(ROUTES.values()) for n, event in enumerate(events))


@query(f"""SELECT session_id AS path, event_index AS entry_index, r.event_type, CASE WHEN r.event_type IN ('tool_call_stderr', 'tool_call_error') THEN 'e' ELSE m.said END AS said FROM (SELECT *, 'm' || event_id AS said, event_id % {len(ROUTES)} AS k FROM log) m JOIN (VALUES {ROUTE_ROWS}) r(k, n, event_type) ON m.k = r.k""")
def rollout_routes(spark, sf_dir):
    """Every kind of rollout entry, and what its events say"""
    events, said = log(spark, sf_dir), F.concat(F.lit("m"), F.col("event_id").cast("string"))
    more = json(
        type="KIND", call_id="c", name=said, message=said, last_agent_message=said, stdout=said, stderr="e", success=False, role="developer", content=F.array(F.struct(F.lit("input_text").alias("type"), said.alias("text"))),
        summary=F.array(F.struct(F.lit("text").alias("type"), said.alias("text"))), arguments="{}", input="{}", output=said,
    )
    kinds = F.array(*map(F.lit, ROUTES))
    kind = F.element_at(kinds, (F.col("event_id") % len(ROUTES) + 1).cast("int"))
    entry = F.when(kind.isin([k for k in list(ROUTES)[:8]]), "event_msg").otherwise("response_item")
    value = F.parse_json(F.concat(F.lit('{"type": "'), entry, F.lit('", "payload": '), F.replace(more, F.lit("KIND"), kind), F.lit("}")))
    found = rollouts.canonical(events.select(F.col("session_id").alias("path"), F.col("event_index").alias("entry_index"), value.alias("value"), F.lit(True).alias("request_backfill"), F.lit(True).alias("response_backfill")))
    # What each event says, from its own content.
    of = {"tool_call_result": "output", "tool_call_error": "error", "assistant_reasoning_final": "summary_text", "tool_call_requested": "tool_name", "tool_call_dispatched": "tool_name"}
    of |= dict.fromkeys(("final_output", "user_input", "assistant_text_final", "tool_call_stdout", "tool_call_stderr", "request_system_message"), "text")
    told = F.coalesce(*[F.when(F.col("event_type") == kind, F.get_json_object("content", f"$.{name}")) for kind, name in of.items()], F.when(~F.col("event_type").isin(*of), F.get_json_object("content", "$.message")))
    return found.select("path", "entry_index", "event_type", told.alias("said"))


@query("""SELECT session_id AS thread, event_index AS history_index, value::VARCHAR AS text FROM log WHERE session_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AND floor(epoch_us(ts) / 1000000.0) >= 1704153600""")
def history_import(spark, sf_dir):
    """C21, P6, T10, J7"""
    known = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").cast("string").alias("thread_id"))
    rows = log(spark, sf_dir).select(F.col("session_id").cast("string").alias("session_id"), X.seconds(utc()).alias("ts"), F.col("value").cast("string").alias("text"), F.col("event_index").alias("history_index"))
    found = rollouts.history(rows, known, 1704153600.0)
    return found.select(F.col("session_id").cast("long").alias("thread"), "history_index", F.get_json_object("content", "$.text").alias("text"))


@query("""SELECT thread_id, id, place FROM (SELECT user_id AS thread_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, epoch_us(ts) % 1000000, event_id) AS place FROM events WHERE epoch_us(ts) // 1000000 >= 1704153600) WHERE place <= 20""")
def thread_log_lines(spark, sf_dir):
    """S16, O4"""
    micros = F.unix_micros(F.try_to_timestamp(utc()))
    lines = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("thread_id"), F.floor(micros / 1000000).alias("ts"), F.pmod(micros, F.lit(1000000)).alias("ts_nanos"))
    return imports.log_lines(lines, lines.select("thread_id", F.lit(1704153600).alias("started")).distinct(), 20).select("thread_id", "id", F.col("place").cast("long").alias("place"))


@query("""SELECT c_nationkey AS session_id, place, event_type, target FROM (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal::BIGINT, c_custkey::VARCHAR) AS place, 'codex_thread_detected' AS event_type, c_custkey::VARCHAR AS target FROM customer
          UNION ALL SELECT c_nationkey, 0, 'codex_threads_imported', count(*)::VARCHAR FROM customer GROUP BY 1)
          UNION ALL SELECT n_regionkey, place, event_type, target FROM (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_regionkey::VARCHAR, n_nationkey::VARCHAR) AS place, 'subagent_spawned' AS event_type, n_nationkey::VARCHAR AS target FROM nation
          UNION ALL SELECT n_regionkey, 0, 'codex_spawn_edges_imported', count(*)::VARCHAR FROM nation GROUP BY 1)""")
def staged_threads(spark, sf_dir):
    """Customers as threads of their nation, nations as threads that their region spawned"""
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    threads = customers.select(F.col("c_custkey").cast("string").alias("id"), F.rint("c_acctbal").cast("long").alias("updated_at"), F.col("c_mktsegment").alias("cwd"))
    sessions = customers.select(F.col("c_nationkey").alias("session_id"), F.col("c_custkey").cast("string").alias("thread_id"))
    edges = nations.select(F.col("n_regionkey").cast("string").alias("parent_thread_id"), F.col("n_nationkey").cast("string").alias("child_thread_id"), F.col("n_name").alias("status"))
    parents = nations.select(F.col("n_regionkey").alias("session_id"), F.col("n_regionkey").cast("string").alias("thread_id"))
    made = [imports.thread_events(imports.threads_of(threads, sessions)), imports.edge_events(imports.edges_of(edges, parents))]
    target = F.when(F.col("place") == 0, F.get_json_object("content", "$.count")).otherwise(F.col("target_name"))
    return made[0].unionByName(made[1], allowMissingColumns=True).select(F.col("session_id").cast("int").alias("session_id"), F.col("place").cast("long").alias("place"), "event_type", target.alias("target"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 't' || page_id END AS turn_id, CASE page_id % 4 WHEN 3 THEN NULL ELSE 's' || page_id END AS codex_thread_id, CASE page_id % 4 WHEN 2 THEN 'w' || page_id END AS codex_window_id, CASE page_id % 4 WHEN 3 THEN '{"raw":"no json"}' END AS raw FROM pages""")
def request_headers(spark, sf_dir):
    """C23"""
    named, none = (lambda letter: F.concat(F.lit(letter), F.col("page_id").cast("string"))), F.lit("")
    kind = F.col("page_id") % 4
    headers = F.create_map(
        F.when(kind == 0, "x-codex-turn-metadata").otherwise("X-Codex-Turn-Metadata"), F.when(kind == 0, json(turn_id=named("t"), session_id=named("s"))).when(kind == 3, "no json").otherwise(none),
        F.when(kind == 1, "session_id").otherwise("Session-Id"), F.when(kind.isin(1, 2), named("s")).otherwise(none), F.lit("X-Codex-Window-Id"), F.when(kind == 2, named("w")).otherwise(none),
    )
    found = table(spark, sf_dir, "pages").select("page_id", imports.request_metadata(headers).alias("m"))
    return found.select("page_id", "m.turn_id", "m.codex_thread_id", "m.codex_window_id", F.when(F.col("page_id") % 4 == 3, F.col("m.codex_turn_metadata")).alias("raw"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') || '/v1/x' || CASE WHEN page_id % 2 = 0 THEN '?q=' || page_id ELSE '' END AS url, substr(sha256(url), 1, 12) AS host FROM pages""")
def upstream_urls(spark, sf_dir):
    """X25, X27"""
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/v1/x?q="), F.col("page_id").cast("string"))).otherwise("/v1/x")
    return table(spark, sf_dir, "pages").select("page_id", imports.upstream(F.col("url"), path)["url"].alias("url"), imports.host_digest(F.col("url")).alias("host"))


@query(r"""SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(found, lambda p: regexp_replace(p, '[''".,)]+$', '')))), ' ') AS paths, array_to_string(list_transform(found, lambda p: regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '[''".,)]+$', ''), '/+$', ''), '/\*$', ''), '/+$', '')), ' ') AS cleaned
           FROM (SELECT page_id, regexp_extract_all(url || ' ' || html, '(?:^|[^A-Za-z0-9_])((?:~?/|\.\.?/)[^\s''"<>|;:,]+)', 1) AS found FROM pages)""")
def path_extract(spark, sf_dir):
    """X11, X12"""
    whole = F.concat_ws(" ", "url", "html")
    every = F.transform(F.regexp_extract_all(whole, F.lit(V.PATH), 1), lambda p: X.clean(F.regexp_replace(p, r"""['".,)]+$""", "")))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(X.paths(whole)), " ").alias("paths"), F.array_join(every, " ").alias("cleaned"))


STARTS = lambda words: " OR ".join(f"starts_with(ltrim(c, chr(32) || chr(9) || chr(10) || chr(13)), $${w}$$)" for w in words)
HOLDS = lambda words: " OR ".join(f"contains(c, $${w}$$)" for w in words)


@query(f"""SELECT doc_id, ({HOLDS(V.DESTRUCTIVE)}) AS destructive_action, ({HOLDS([*V.DESTRUCTIVE, *V.IRREVERSIBLE_WORDS])}) AS irreversible_action, ({STARTS(V.WRITE_PREFIXES)}) AND NOT ({STARTS(V.READ_PREFIXES)}) AS write_action,
           ({STARTS(V.READ_PREFIXES)}) AND NOT ({STARTS(V.WRITE_PREFIXES)}) AND NOT ({HOLDS(V.DESTRUCTIVE)}) AND NOT ({HOLDS(V.EXTERNAL)}) AS read_only_action, ({HOLDS(V.EXTERNAL)}) AS external_effect, false AS delegate_action
           FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'rm -rf x; ' WHEN 1 THEN 'git status ' WHEN 2 THEN 'python -c ' WHEN 3 THEN 'cat http://' ELSE ' ' END || lower(coalesce(text, '')) AS c FROM documents)""")
def prefix_flags(spark, sf_dir):
    """Commands after white space of several kinds"""
    rows, number = table(spark, sf_dir, "documents"), F.col("doc_id") % 5
    head = F.when(number == 0, "\n rm -rf x; ").when(number == 1, "\tgit status ").when(number == 2, " python -c ").when(number == 3, "\r\ncat http://").otherwise(" ")
    command = F.concat(head, F.coalesce("text", F.lit("")))
    return rows.select("doc_id", *[flag.alias(name) for name, flag in cases._flags(command, F.lit("exec_command"), command).items()])


@query("""SELECT event_id, '{"b": ' || k || ', "a": [' || k || ', "x,y: é"]}' AS plain, '{"a": [' || k || ', "x,y: é"], "b": ' || k || '}' AS sorted FROM (SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events)""")
def json_as_python(spark, sf_dir):
    """X4, X5"""
    k = F.get_json_object("props", "$.k")
    line = F.concat(F.lit('{"event_type": "t", "content": {"arguments": {"b": '), k, F.lit(', "a": ['), k, F.lit(', "x,y: é"]}}}'))
    told = J.with_texts(table(spark, sf_dir, "events").select("event_id", line.alias("raw")), name="t")
    return told.select("event_id", F.col("t.arguments").alias("plain"), F.col("t.sorted_arguments").alias("sorted"))


@query("""SELECT session_id, event_index, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS first, CASE event_index % 2 WHEN 0 THEN 'v' || event_index ELSE 'w=' || event_index END AS value FROM chat""")
def first_filled(spark, sf_dir):
    """X22, X28"""
    blank = F.when(F.col(TURN) % 2 == 0, " \n\t").otherwise("")
    arguments = F.when(F.col(TURN) % 2 == 0, F.array(F.lit("x"), F.lit("--f"), NUMBER("v"))).otherwise(F.array(F.lit("--fx"), F.concat(F.lit("--f="), NUMBER("w="))))
    return chat(spark, sf_dir).select("session_id", TURN, X.first_filled(blank, F.col("text"), F.lit("no")).alias("first"), X.option(arguments, "--f").alias("value"))


@query("""SELECT page_id, string_agg(name || '=' || value, '|' ORDER BY name) AS headers FROM (SELECT page_id, unnest([CASE page_id % 2 WHEN 0 THEN 'Authorization' ELSE 'aUTHORIZATION' END, CASE page_id % 3 WHEN 0 THEN 'X-Api-Key' ELSE 'X-Page' END, 'Content-Type']) AS name,
          unnest(['<redacted>', CASE page_id % 3 WHEN 0 THEN '<redacted>' ELSE url END, 'text/html']) AS value FROM pages) GROUP BY page_id""")
def header_maps(spark, sf_dir):
    """Names in either case, secret, of one hop, or neither"""
    k = F.col("page_id")
    headers = F.create_map(
        F.when(k % 2 == 0, "Authorization").otherwise("aUTHORIZATION"), F.col("url"), F.when(k % 3 == 0, "X-Api-Key").otherwise("X-Page"), F.col("url"), F.lit("Content-Type"), F.lit("text/html"), F.when(k % 2 == 0, "Connection").otherwise("tRANSFER-encoding"), F.lit("close"), F.lit("Keep-Alive"), F.lit("5"),
    )
    kept = F.array_sort(F.transform(F.map_entries(X.end_to_end(X.redact(headers))), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(kept, "|").alias("headers"))


@query("""SELECT c_custkey AS session_id, CASE WHEN c_custkey % 3 = 0 THEN 'l' WHEN c_custkey % 3 = 1 THEN c_name ELSE c_mktsegment END AS shared, CASE WHEN c_custkey % 3 <> 2 THEN 'only left' END AS own FROM customer""")
def manifest_merge(spark, sf_dir):
    """K7"""
    rows, k = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "session_id"), F.col("session_id") % 3
    left = rows.where(k != 2).select("session_id", F.create_map(F.lit("shared"), F.lit("l"), F.lit("own"), F.lit("only left")).alias("manifest"))
    right = rows.where(k != 0).select("session_id", F.create_map(F.lit("shared"), F.when(k == 1, F.col("c_name")).otherwise(F.col("c_mktsegment"))).alias("manifest"))
    return sinks.merged(left, right).select("session_id", F.element_at("manifest", "shared").alias("shared"), F.element_at("manifest", "own").alias("own"))


@query("""SELECT session_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY session_id ORDER BY event_id) - 1 AS event_index, CASE event_type WHEN 'signup' THEN 'user_input' WHEN 'error' THEN 'tool_call_result' WHEN 'purchase' THEN 'tool_call_requested' WHEN 'click' THEN 'request_user_message' ELSE 'request_system_message' END AS kind,
          CASE WHEN event_type NOT IN ('error', 'purchase') THEN 'look at /data/' || json_extract(props, '$.k') END AS text FROM log""")
def log_files(spark, sf_dir):
    """Logs of all sessions kept in a store and read again, with lines between that are no events"""
    root = f"{scratch(spark)}/logs-{uuid.uuid4().hex}"
    lines = _recorded(spark, sf_dir).select("session_id", F.posexplode(F.array(F.col("raw"), F.lit("[1]"), F.lit("{half"), F.lit(""))).alias("part", "value"), F.col("event_id").cast("long").alias("id"))
    store.write(lines.select("session_id", F.struct("id", "part").alias("at"), "value"), root)
    return logs.stored_events(spark, root).select("session_id", "event_index", F.col("event_type").alias("kind"), J.string("content", "$.text").alias("text"))


@query(f"""{CASES}, told AS (SELECT session_id, count(f.case_id) AS case_count FROM (SELECT DISTINCT session_id FROM log) LEFT JOIN found f USING (session_id) GROUP BY session_id)
           SELECT session_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY session_id ORDER BY event_index) - 1 AS line, case_id, command, categories, case_count FROM found JOIN told USING (session_id)
           UNION ALL SELECT session_id::VARCHAR, NULL, NULL, NULL, NULL, case_count FROM told WHERE case_count = 0""")
def stored_cases(spark, sf_dir):
    """K4, K5: cases kept in a store twice, the later ones in place of the earlier, and the events that tell of them"""
    root, events = f"{scratch(spark)}/cases-{uuid.uuid4().hex}", _recorded(spark, sf_dir)
    found, sessions = cut(cases.build(events)), events.select("session_id").distinct()
    half = found.where(F.col("session_id").cast("long") % 2 == 0).withColumn("case_id", F.lit("old"))
    sinks.keep_cases(half, f"{root}/cases", "first")
    for _ in range(2):  # the second time nothing happens
        sinks.keep_cases(found, f"{root}/cases", "second")
        sinks.keep_events(sinks.cases_generated(sessions, found, root), f"{root}/events", commit="told")
    told = logs.stored_events(spark, f"{root}/events").where("event_type = 'authz_cases_generated'").select("session_id", F.try_variant_get("content", "$.case_count", "long").alias("case_count"))
    case = F.from_json("value", "case_id string, action struct<command: string>, heuristic_hints struct<suspected_categories: array<string>>").alias("c")
    kept = store.read(spark, f"{root}/cases").select("session_id", F.col("line_index").alias("line"), case).select("session_id", "line", "c.case_id", "c.action.command", F.array_join("c.heuristic_hints.suspected_categories", ", ").alias("categories"))
    return told.join(kept, "session_id", "left").select("session_id", "line", "case_id", "command", "categories", "case_count")


@query(REPORT_TEXT)
def stored_reports(spark, sf_dir):
    """K6: reports kept in a store, line by line, for the sessions that the events tell of"""
    root, events = f"{scratch(spark)}/reports-{uuid.uuid4().hex}", _recorded(spark, sf_dir)
    manifests = _manifests(events)
    sinks.keep_pages(report.lines(events, manifests), f"{root}/reports")
    sinks.keep_events(sinks.report_generated(manifests, root), f"{root}/events")
    told = logs.stored_events(spark, f"{root}/events").where("event_type = 'session_report_generated'").select("session_id")
    return sinks.kept_pages(store.read(spark, f"{root}/reports").join(told, "session_id", "left_semi"))


@query("""SELECT asked, s.session_id::VARCHAR AS session_id, (SELECT count(*) FROM log WHERE log.session_id = s.session_id) + CASE WHEN s.session_id % 2 = 0 THEN (SELECT count(*) FROM log WHERE log.session_id = s.session_id) ELSE 0 END AS lines
          FROM (SELECT 'folder' AS asked, min(session_id) AS session_id FROM log UNION ALL SELECT 'id', min(session_id) FILTER (session_id > (SELECT min(session_id) FROM log)) FROM log
          UNION ALL SELECT 'latest', max(session_id::VARCHAR)::BIGINT FROM log WHERE session_id % 2 = 0 UNION ALL SELECT 'none', NULL) s""")
def session_choice(spark, sf_dir):
    """S3, O1: a session chosen by folder, by id or as the latest one of a catalogue, and read by the index alone; one that isn't there"""
    root, events = f"{scratch(spark)}/sessions-{uuid.uuid4().hex}", cut(_recorded(spark, sf_dir).select("session_id", F.col("event_index").alias("at"), F.col("raw").alias("value")))
    store.write(events, root, "all")
    store.write(events.where(F.col("session_id").cast("long") % 2 == 0), root, "even")
    found = store.catalogue(spark, root)
    first, second = (str(r[0]) for r in events.select(F.col("session_id").cast("long").alias("s")).distinct().orderBy("s").limit(2).collect())
    asked = {"folder": {"folder": f"/logs/{first}/", "session": second, "newest": True}, "id": {"session": second, "newest": True}, "latest": {"newest": True}, "none": {"session": "nowhere"}}
    told = []
    for name, choice in asked.items():
        try:
            session = logs.resolved(found, **choice)
        except FileNotFoundError:
            session = None
        read = store.read(spark, root, "nowhere" if session is None else session)
        told.append(read.agg(F.count("*").alias("lines")).select(F.lit(name).alias("asked"), F.lit(session).cast("string").alias("session_id"), "lines"))
    return reduce(DataFrame.unionByName, told)


@query("""SELECT session_id, path, thread_id FROM (SELECT n_nationkey AS session_id, n_nationkey AS thread_id, 'rollout-x-t' || n_nationkey || '.jsonl' AS path FROM nation WHERE n_nationkey % 2 = 0)
          UNION ALL SELECT session_id, path, thread_id FROM (SELECT s.n_nationkey AS session_id, r.n_nationkey AS thread_id, 'rollout-x-t' || r.n_nationkey || '.jsonl' AS path, row_number() OVER (PARTITION BY s.n_nationkey ORDER BY abs(100 * r.n_nationkey - 100 * s.n_nationkey - 60), r.n_nationkey) AS n
          FROM nation s JOIN nation r ON s.n_regionkey = r.n_regionkey AND 100 * r.n_nationkey BETWEEN 100 * s.n_nationkey + 60 - 300 AND 100 * s.n_nationkey + 60 + 3600 WHERE s.n_nationkey % 2 = 1) WHERE n = 1""")
def rollout_files(spark, sf_dir):
    """Rollouts of nations, found by thread or by folder (region) and time (number)"""
    folder = f"{scratch(spark)}/rollouts-{uuid.uuid4().hex}"
    nations, name = table(spark, sf_dir, "nation"), F.concat(F.lit("t"), F.col("n_nationkey").cast("string"))
    region, time = F.concat(F.lit("/r"), F.col("n_regionkey").cast("string")), 100.0 * F.col("n_nationkey")
    meta = json(type="session_meta", payload=F.struct(name.alias("id"), region.alias("cwd"), X.iso_millis(time).alias("timestamp")))
    lines = F.array(F.lit('{"type": "turn_context", "payload": {}}'), meta, F.lit('{"type": "session_meta", "payload": {"id": "later"}}'))
    written = nations.select("n_nationkey", F.posexplode(lines).alias("at", "value")).repartition("n_nationkey").sortWithinPartitions("n_nationkey", "at").drop("at")
    written.write.partitionBy("n_nationkey").text(folder)
    metadata = logs.rollout_metadata(logs.json_lines(spark, f"{folder}/*/*.txt")).withColumn("path", F.concat(F.lit("rollout-x-"), "thread_id", F.lit(".jsonl")))
    sessions = nations.select(F.col("n_nationkey").alias("session_id"), F.when(F.col("n_nationkey") % 2 == 0, F.array(name)).otherwise(F.array(F.lit("none"))).alias("thread_ids"), region.alias("cwd"), (time + 60).alias("started"))
    near = logs.rollouts_of(sessions, metadata)
    return near.join(metadata.select("path", "thread_id"), "path").select("session_id", "path", F.substr(F.col("thread_id"), F.lit(2)).cast("int").alias("thread_id"))


@query("SELECT event_type AS counter, count(*)::BIGINT AS n, (SELECT count(*) FROM log)::BIGINT AS every FROM log GROUP BY event_type")
def counted_stream(spark, sf_dir):
    """Counters of a stream in three batches, observed while it is written, whose totals the checkpoint keeps"""
    folder, rows = f"{scratch(spark)}/counted-{uuid.uuid4().hex}", log(spark, sf_dir).select("event_id", "event_type")
    kinds = [r[0] for r in rows.select("event_type").distinct().collect()]
    counters = {kind: F.count_if(F.col("event_type") == kind) for kind in kinds} | {"every": F.count(F.lit(1))}
    for part in range(3):
        rows.where(F.col("event_id") % 3 == part).write.mode("append").parquet(f"{folder}/in")
        live.append(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint", {"availableNow": True}, counters=counters).awaitTermination()
    found = live.totals(f"{folder}/checkpoint")
    return spark.createDataFrame([(kind, found[kind], found["every"]) for kind in kinds], "counter string, n long, every long")


@query("""SELECT session_id, event_index, CASE event_index % 3 WHEN 2 THEN 'artifacts' ELSE 'raw' END AS kind, text AS said, (SELECT count(DISTINCT CASE event_index % 3 WHEN 2 THEN 'plain ' || text ELSE role || chr(0) || text END) FROM chat) AS kept FROM chat""")
def raw_artifacts(spark, sf_dir):
    """Bodies of requests kept once by their digest, events that refer to them, and what is read back by reference: JSON by type or first character, and other text"""
    root, third = f"{scratch(spark)}/bodies-{uuid.uuid4().hex}", F.col(TURN) % 3
    sent = chat(spark, sf_dir).select("session_id", TURN, F.when(third == 2, F.concat(F.lit("plain "), "text")).otherwise(json(role=F.col("role"), text=F.col("text"))).alias("body"), F.when(third == 0, "application/JSON").otherwise("text/plain").alias("content_type"))
    told = artifacts.exchanged(sent)
    artifacts.keep(told, root)
    events = told.select("session_id", TURN, F.coalesce("raw_ref", "artifact").alias("raw_ref"))
    back = artifacts.fetched(events, root).withColumn("body", F.col("body").cast("string"))
    said = F.coalesce(J.string(bodies.json_body(F.col("body"), F.lit(None).cast("string")), "$.text"), F.substring("body", 7, 1 << 30))
    kept = store.catalogue(spark, root).agg(F.count("*").alias("kept"))
    return back.select("session_id", TURN, F.substring_index("raw_ref", "/", 1).alias("kind"), said.alias("said")).join(F.broadcast(kept))


@query("SELECT event_id, session_id, props AS line FROM log WHERE event_id % 3 <> 0")
def tail_from_end(spark, sf_dir):
    """A stream that begins at the end of what is there when it starts, and takes what comes in batches of bounded bytes, or a hundredth of it where that is more"""
    folder = f"{scratch(spark)}/tail-end-{uuid.uuid4().hex}"
    tail.register(spark)
    rows = log(spark, sf_dir).select("event_id", json(event_id=F.col("event_id"), session_id=F.col("session_id"), line=F.col("props")).alias("value"))
    rows.where("event_id % 3 = 0").select("value").write.mode("append").text(f"{folder}/in")
    lines = spark.readStream.format(tail.TailSource.name()).option("path", f"{folder}/in/*.txt").option("startAtEnd", "true").option("maxBytesPerBatch", str(1 << 16)).option("maxBatchesBehind", "100").load()
    stream = live.append(lines.withColumn("event_type", F.lit("line")), f"{folder}/out", f"{folder}/checkpoint", {"processingTime": "0 seconds"})
    stream.processAllAvailable()
    rows.where("event_id % 3 <> 0").select("value").write.mode("append").text(f"{folder}/in")
    stream.processAllAvailable()
    stream.stop()
    of = lambda name: F.get_json_object("line", f"$.{name}")
    return spark.read.parquet(f"{folder}/out").select(of("event_id").cast("long").alias("event_id"), of("session_id").cast("long").alias("session_id"), of("line").alias("line"))


def _placed(rows: DataFrame, folder: str) -> None:
    """Write rows (name, at, value) as files of these names, each whole, in order; a task that runs again writes the same."""

    def write(batches):
        files, base = store.opened(folder)
        files.create_dir(base)
        name, out = None, None
        for batch in batches:
            for of, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if of != name:
                    name, out = of, (out and out.close()) or files.open_output_stream(f"{base}/{of}")
                out.write(value.encode() + b"\n")
        if out:
            out.close()
        return iter(())

    rows.repartition("name").sortWithinPartitions("name", "at").select("name", "value").mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


#: Where the second tick begins in each session.
LATER = 40


@query(f"""SELECT session_id::VARCHAR AS session_id, 't' || session_id AS thread_ids, count(*) FILTER (event_type <> 'click' AND event_index >= {LATER})::BIGINT AS rollout_entries_imported, count(*) FILTER (event_type <> 'click')::BIGINT AS rollout_entries_total,
          count(*) FILTER (event_type = 'click' AND event_index >= {LATER})::BIGINT AS history_entries_imported, count(*) FILTER (event_type = 'click')::BIGINT AS history_entries_total, (count(*) FILTER (event_type IN ('signup', 'view', 'error') AND event_index >= {LATER}) + 2 * count(*) FILTER (event_type = 'purchase' AND event_index >= {LATER}))::BIGINT AS rollout_events_imported,
          count(DISTINCT CASE WHEN event_type = 'purchase' THEN json_extract(props, '$.k')::INT END)::BIGINT AS authz_case_count, coalesce(bool_or(event_type = 'purchase' AND event_index >= {LATER}), false) AS authz_refreshed, (SELECT count(*) FROM log WHERE event_type <> 'click' AND event_index >= {LATER})::BIGINT AS lines_read FROM log GROUP BY session_id""")
def second_tick(spark, sf_dir):
    """Q-RECON, T6, T9: rollout files and history that grow between two ticks; the second one reads what was appended"""
    root, events = f"{scratch(spark)}/ticks-{uuid.uuid4().hex}", cut(log(spark, sf_dir).drop("value"))
    thread = F.concat(F.lit("t"), F.col("session_id").cast("string"))
    entries = events.where("event_type <> 'click'").select(F.concat(F.lit("rollout-x-"), thread, F.lit(".jsonl")).alias("name"), F.col("event_index").alias("at"), F.concat(F.lit('{"type": "'), _entry(F.col("event_type"))[0], F.lit('", "payload": '), _entry(F.col("event_type"))[1], F.lit("}")).alias("value"))
    later = F.col("event_index") >= LATER
    history = events.where("event_type = 'click'").select((F.col("event_id") + F.when(later, 1 << 40).otherwise(0)).alias("history_row"), thread.alias("session_id"), X.seconds(utc()).alias("ts"), F.col("props").alias("text"), later.alias("later"))
    sessions = events.select(F.col("session_id").cast("string").alias("session_id"), thread.alias("thread")).distinct()
    started = F.to_json(F.struct(F.lit("session_started").alias("event_type"), F.struct(F.col("thread").alias("codex_thread_id")).alias("content")))
    store.write(sessions.select("session_id", F.lit(0).alias("at"), started.alias("value")), f"{root}/log", "started")
    known = sessions.select("session_id", F.lit("/w").alias("cwd"), F.lit(0.0).alias("started"))
    for part, said in ((entries.where(F.col("at") < LATER), history.where("NOT later")), (entries, history)):
        _placed(part, f"{root}/rollouts")
        done = ticks.advance(spark, f"{root}/state", known, f"{root}/log", f"{root}/rollouts/*.jsonl", said.drop("later"), f"{root}/cases")
    names = ("rollout_entries_imported", "rollout_entries_total", "history_entries_imported", "history_entries_total", "rollout_events_imported", "authz_case_count", "authz_refreshed")
    return done.summaries.select("session_id", F.array_join("thread_ids", ",").alias("thread_ids"), *names, F.lit(done.read["entries"]).cast("long").alias("lines_read"))


@query(CARRIED)
def rollout_stream(spark, sf_dir):
    """Rollouts as a stream of two batches; what the first says of turns and calls, the second knows"""
    folder, entries = f"{scratch(spark)}/rollout-stream-{uuid.uuid4().hex}", _entries(spark, sf_dir).withColumn("value", F.to_json("value"))
    for part in (F.col("entry_index") < 12, F.col("entry_index") >= 12):
        entries.where(part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(entries.schema).parquet(f"{folder}/in").withColumn("value", F.parse_json("value"))
        live.append(live.rollout_events(stream), f"{folder}/out", f"{folder}/checkpoint", {"availableNow": True}).awaitTermination()
    found = spark.read.parquet(f"{folder}/out").where("event_type = 'tool_call_result'")
    return found.select(F.col("path").cast("long").alias("path"), "entry_index", F.get_json_object("content", "$.tool_name").alias("tool"), "turn_id")


@query("SELECT event_id, session_id, props AS line FROM log")
def tail_lines(spark, sf_dir):
    """Lines of files that grow between two runs of a stream"""
    folder = f"{scratch(spark)}/tail-{uuid.uuid4().hex}"
    tail.register(spark)
    events = log(spark, sf_dir)
    for part in range(2):
        events.where(F.col("event_id") % 2 == part).select(json(event_id=F.col("event_id"), session_id=F.col("session_id"), line=F.col("props")).alias("value")).write.mode("append").text(f"{folder}/in")
        lines = spark.readStream.format(tail.TailSource.name()).option("path", f"{folder.removeprefix('file:')}/in/*.txt").load()
        live.append(lines.withColumn("event_type", F.lit("line")), f"{folder}/out", f"{folder}/checkpoint", {"availableNow": True}).awaitTermination()
    got = spark.read.parquet(f"{folder}/out")
    return got.select(F.get_json_object("line", "$.event_id").cast("long").alias("event_id"), F.get_json_object("line", "$.session_id").cast("long").alias("session_id"), F.get_json_object("line", "$.line").alias("line"))


@query("""SELECT session_id, kind, props, n FROM (SELECT session_id, 'tool_call_requested' AS kind, props, 1::BIGINT AS n FROM log WHERE event_type = 'purchase' GROUP BY session_id, props
          UNION ALL SELECT session_id, 'user_input', props, count(*) FROM log WHERE event_type = 'signup' GROUP BY session_id, props)""")
def keyed_stream(spark, sf_dir):
    """A stream in which one event of each call of a session stays, and all others"""
    folder = f"{scratch(spark)}/once-{uuid.uuid4().hex}"
    rows = log(spark, sf_dir).where("event_type in ('purchase', 'signup')")
    kinds = F.when(F.col("event_type") == "purchase", "tool_call_requested").otherwise("user_input")
    rows.select(F.col("session_id").cast("string").alias("session_id"), kinds.alias("event_type"), json(tool_call_id=F.col("props")).alias("content"), F.lit("log").alias("path"), F.col("event_id").alias("entry_index"), F.lit(0).alias("emit")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("session_id string, event_type string, content string, path string, entry_index long, emit int").parquet(f"{folder}/in")
    live.append(live.once(stream), f"{folder}/out", f"{folder}/checkpoint", {"availableNow": True}).awaitTermination()
    got = spark.read.parquet(f"{folder}/out").withColumn("props", F.get_json_object("content", "$.tool_call_id"))
    return got.groupBy(F.col("session_id").cast("long").alias("session_id"), F.col("event_type").alias("kind"), "props").agg(F.count("*").alias("n"))


@query("""SELECT session_id, string_agg(thread, ',' ORDER BY f) AS thread_ids FROM (SELECT session_id, thread, min(event_index) AS f FROM (SELECT session_id, event_index, 't' || json_extract(props, '$.k') AS thread FROM log WHERE event_type <> 'view') GROUP BY session_id, thread) GROUP BY session_id""")
def threads_named(spark, sf_dir):
    """A5: threads in the order of their first mention, in metadata or content"""
    thread = json(codex_thread_id=F.concat(F.lit("t"), F.get_json_object("props", "$.k")))
    of = lambda kind: F.when(F.col("event_type") == kind, F.parse_json(thread))
    events = log(spark, sf_dir).where("event_type <> 'view'").withColumn("content", of("error")).withColumn("platform_metadata", F.when(F.col("event_type") != "error", F.parse_json(thread)))
    return reconcile.known_threads(events).select("session_id", F.array_join("thread_ids", ",").alias("thread_ids"))


def _entry(kind: Column) -> tuple[Column, Column]:
    """Type and payload of the rollout entry that stands for a row of the log."""
    call = F.concat(F.lit("c"), F.get_json_object("props", "$.k"))
    payload = F.when(kind == "signup", json(type="task_started")).when(kind == "view", json(model="m")).when(kind == "purchase", json(type="custom_tool_call", call_id=call, name="f", input="{}")).otherwise(json(type="exec_command_end", call_id=call))
    return F.when(kind.isin("signup", "error"), "event_msg").when(kind == "view", "turn_context").otherwise("response_item"), payload


@query("""SELECT session_id, 't' || session_id AS thread_ids, count(*) FILTER (event_type <> 'click')::BIGINT AS rollout_entries_imported, count(*) FILTER (event_type = 'click')::BIGINT AS history_entries_imported,
          (count(*) FILTER (event_type IN ('signup', 'view', 'error')) + 2 * count(*) FILTER (event_type = 'purchase'))::BIGINT AS rollout_events_imported, count(DISTINCT CASE WHEN event_type = 'purchase' THEN json_extract(props, '$.k')::INT END)::BIGINT AS authz_case_count, bool_or(event_type = 'purchase') AS authz_refreshed FROM log GROUP BY session_id""")
def reconcile_tick(spark, sf_dir):
    """Q-RECON, A4, J5, D1, T9: clicks as history, all else as rollouts of one thread a session"""
    events, thread = log(spark, sf_dir), F.concat(F.lit("t"), F.col("session_id").cast("string"))
    named = F.parse_json(json(codex_thread_id=thread))
    started = events.groupBy("session_id").agg(F.min("event_index").alias("event_index")).select(
        F.col("session_id").cast("string").alias("session_id"), F.lit(0).cast("long").alias("event_index"), F.lit("session_started").alias("event_type"), *[F.lit(None).cast("string").alias(n) for n in ("timestamp", "event_id", "turn_id")],
        named.alias("content"), *[F.lit(None).cast("variant").alias(n) for n in ("actor", "platform_metadata")], F.lit(None).cast("string").alias("raw"),
    )
    entry, payload = _entry(F.col("event_type"))
    entries = E.number(events.where("event_type <> 'click'").select(F.concat(F.lit("/r/rollout-x-"), thread, F.lit(".jsonl")).alias("path"), F.col("event_index").alias("at"), F.parse_json(F.concat(F.lit('{"type": "'), entry, F.lit('", "payload": '), payload, F.lit("}"))).alias("value")), "at", session="path", index="entry_index")
    history = events.where("event_type = 'click'").select(F.col("event_id").alias("history_row"), thread.alias("session_id"), X.seconds(utc()).alias("ts"), F.col("props").alias("text"))
    sessions = started.select("session_id", F.lit("/w").alias("cwd"), F.lit(0.0).alias("started"))
    # A rollout is known by its name where its entries name no thread.
    done = reconcile.tick(sessions, started, entries, history).summaries
    return done.select(F.col("session_id").cast("long").alias("session_id"), F.array_join("thread_ids", ",").alias("thread_ids"), "rollout_entries_imported", "history_entries_imported", "rollout_events_imported", "authz_case_count", "authz_refreshed")
