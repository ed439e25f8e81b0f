"""Canonical events of requests and responses of model providers, in three dialects, whole or as streams.

Every function takes a table with columns `key` (of one payload) and `payload` (a variant) and gives, in the order
of key, item and emit: key, item, emit, event_type, actor, target and content (JSON text without null fields).

A payload is read by steps that each add plain columns: its lists become rows, the fields of a row one struct, and
rules on these give events. So an expression is as long as one rule, whatever a payload nests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import emit as M
from ..functions import values as J
from ..operators import events as E
from ..session import ship
from ..sources.bodies import stream_events

# Event types by role, block types and stream events that tell the block dialect.
ROLES = {"user": "request_user_message", "assistant": "request_assistant_message", "system": "request_system_message"}
BLOCK_TYPES = ["thinking", "redacted_thinking", "tool_use", "tool_result"]
BLOCK_STREAM = ["message_start", "content_block_start", "content_block_delta", "content_block_stop", "message_delta", "message_stop"]

KEEP = ["key", "item"]


def _null() -> Column:
    return F.lit(None).cast("variant")


def _emitted(rows: DataFrame, *rules: Column, place: str | None = None) -> DataFrame:
    return M.exploded(rows.withColumn("item", F.col("item").cast("long")), KEEP, list(rules), F.col(place) if place else None)


def _by_role(role: Column, **more: str) -> Column:
    kind = F.when(F.lit(False), "")
    for name, value in (ROLES | more).items():
        kind = kind.when(role == name, value)
    return kind.otherwise("request_message")


def _objects(payloads: DataFrame, *fields: str) -> DataFrame:
    """key and p, the fields of payloads that are objects."""
    ship(payloads.sparkSession)
    return J.opened(payloads.select("key", "payload"), "payload", "p", *fields).where("p is not null")


def _listed(objects: DataFrame, values: Column, *more: Column) -> DataFrame:
    """key, item, value of an array of variants, and `more` columns."""
    return objects.select("key", *more, F.posexplode(values).alias("item", "value"))


def block_units(content: Column) -> Column:
    """The blocks of a message's content as an array of variants: an object is one, other things in a list are left out,
    and text alone has none."""
    one = F.when(J.is_object(content), F.array(content))
    return F.coalesce(F.filter(J.items(content), lambda x: J.is_object(x) | (J.kind(x) == "STRING")), one, F.array().cast("array<variant>"))


def block_events(rows: DataFrame) -> DataFrame:
    """The events of messages: of their blocks reasoning, calls and results in order, then one event with all text.

    Rows have key, item, units (blocks), whole (the text), text_type, result_type, always (whether empty text counts),
    actor (a kind and id), target (kind and name) and what a message event says of it: index, role, tool_call_id, name.
    """
    own = ["key", "item", "whole", "text_type", "result_type", "always", "actor", "target", "index", "role", "tool_call_id", "name"]
    found = rows.select(*own, F.posexplode(F.concat("units", F.array(_null()))).alias("place", "block"))
    found = J.opened(found, "block", "b", "type", "thinking", "text", "name", "id", "tool_use_id", "tool_call_id", "input", "content", "is_error")
    b = lambda field: F.col(f"b.{field}")
    found = (
        found.withColumn("kind", J.text_of(b("type"))).withColumn("tool", J.text_of(b("name"))).withColumn("thought", F.coalesce(J.truthy(b("thinking")), b("text")))
        .withColumn("thought", M.text(F.when(F.col("kind").isin("thinking", "redacted_thinking"), F.col("thought"))))
        .withColumn("said", M.text(F.when(F.col("kind") == "tool_result", b("content"))))
    )
    found = M.delegated(found, F.when(F.col("kind") == "tool_use", F.col("tool")), b("input"))
    kind, thought, target = F.col("kind"), F.col("thought"), ("target.kind", "target.name")
    actor, target = tuple(map(F.col, ("actor.kind", "actor.id"))), tuple(map(F.col, target))
    common, hidden = {"block_index": F.col("place"), "message_index": F.col("index")}, (kind == "redacted_thinking") & (thought == "")
    thinks = kind.isin("thinking", "redacted_thinking") & ((thought != "") | hidden)
    calls = M.requested(F.col("tool"), M.first(b("id"), b("tool_use_id")), b("input"), **common)
    result = M.content(**common, tool_call_id=M.first(b("tool_use_id"), b("tool_call_id"), b("id")), output=F.col("said"), is_error=J.truthy(b("is_error")).isNotNull())
    message = M.content(message_index=F.col("index"), role=F.col("role"), text=F.col("whole"), tool_call_id=F.col("tool_call_id"), name=F.col("name"))
    return _emitted(
        found,
        F.when(thinks, M.event("assistant_reasoning_final", M.ASSISTANT, target, M.content(**common, text=F.nullif(thought, F.lit("")), has_encrypted_content=F.when(hidden, True)))),
        *[F.when(kind == "tool_use", e) for e in calls],
        F.when(kind == "tool_result", M.event(F.col("result_type"), actor, target, result)),
        F.when(F.col("block").isNull() & (F.col("always") | (F.col("whole") != "")), M.event(F.col("text_type"), actor, target, message)),
        place="place",
    )


def _pair(kind: Column, name: Column, of: str) -> Column:
    return F.struct(kind.alias("kind"), name.alias(of))


def is_block_request(p: str) -> Column:
    """Whether a request (a struct of its fields) speaks in blocks: its version, its system prompt, its tools or any block says so."""
    get = lambda name: F.col(f"{p}.`{name}`")
    has = lambda value, path: F.try_variant_get(value, path, "variant").isNotNull()
    tells = lambda b: F.try_variant_get(b, "$.type", "string").isin(BLOCK_TYPES) | J.truthy(F.try_variant_get(b, "$.tool_use_id", "variant")).isNotNull()
    content = lambda m: F.try_variant_get(m, "$.content", "variant")
    tests = [
        get("anthropic-version").isNotNull() | get("anthropic_version").isNotNull(), J.is_object(get("system")) | J.items(get("system")).isNotNull(),
        F.exists(J.items(get("tools")), lambda t: has(t, "$.input_schema")),
        F.exists(J.items(get("messages")), lambda m: F.exists(F.coalesce(J.items(content(m)), F.array(content(m))), lambda b: F.coalesce(tells(b), F.lit(False)))),
    ]
    found = F.lit(False)
    for test in tests:
        found = found | F.coalesce(test, F.lit(False))
    return found


def _messages(objects: DataFrame) -> DataFrame:
    """The events of requests in blocks or of the chat dialect (column `blocks` tells); their system prompt is item -1."""
    system = F.array(J.truthy(F.col("p.system")))
    listed = F.coalesce(J.items(F.col("p.messages")), F.array().cast("array<variant>"))
    rows = _listed(objects, F.concat(system, listed), "blocks", J.text_of(F.col("p.model")).alias("model")).withColumn("item", F.col("item") - 1)
    rows = J.opened(rows, "value", "m", "role", "content", "tool_call_id", "name").withColumn("first", F.col("item") < 0)
    rows = rows.where(F.when(F.col("first"), F.col("value").isNotNull()).otherwise(F.col("m").isNotNull()))
    first, blocks, role = F.col("first"), F.col("blocks"), J.text_of(F.col("m.role"))
    rows = rows.withColumn("content", F.when(first, F.col("value")).otherwise(F.col("m.content")))
    rows = rows.withColumn("role", F.when(first, "system").when(blocks, F.coalesce(J.shown_or_null(J.truthy(F.col("m.role"))), F.lit("unknown"))).otherwise(F.coalesce(role, F.lit("unknown"))))
    in_blocks, of_tool = blocks & ~first, lambda name: F.when(~first & ~blocks & (role == "tool"), F.col(f"m.{name}"))
    rows = rows.withColumn("by_block", M.block_text(F.when(in_blocks, F.col("content")))).withColumn("by_text", M.text(F.when(~in_blocks, F.col("content"))))
    kind = F.when(first, "request_system_message").when(blocks, _by_role(F.col("role"), developer="request_system_message")).otherwise(_by_role(F.col("role"), tool="tool_call_result_attached"))
    return block_events(rows.select(
        *KEEP, F.when(in_blocks, block_units(F.col("content"))).otherwise(F.array().cast("array<variant>")).alias("units"), F.when(in_blocks, F.col("by_block")).otherwise(F.col("by_text")).alias("whole"),
        kind.alias("text_type"), F.lit("tool_call_result_attached").alias("result_type"), (~first & ~blocks).alias("always"), _pair(F.col("role"), F.col("role"), "id").alias("actor"), _pair(F.lit("model"), F.col("model"), "name").alias("target"),
        F.when(~first, F.col("item")).alias("index"), F.when(~first & ~blocks, F.col("role")).alias("role"), of_tool("tool_call_id").alias("tool_call_id"), of_tool("name").alias("name"),
    ))


def _items(objects: DataFrame) -> DataFrame:
    """The events of requests of items; their instructions are item -1."""
    rows = _listed(objects, F.concat(F.array(J.truthy(F.col("p.instructions"))), J.items(F.col("p.input"))), J.text_of(F.col("p.model")).alias("model")).withColumn("item", F.col("item") - 1)
    rows = J.opened(rows, "value", "v", "type", "role", "content", "call_id", "id", "name", "arguments", "output", "summary", "encrypted_content")
    v, first = (lambda name: F.col(f"v.{name}")), F.col("item") < 0
    rows = rows.where(F.when(first, F.col("value").isNotNull()).otherwise(F.col("v").isNotNull()))
    rows = rows.withColumn("type", F.when(~first, J.text_of(v("type")))).withColumn("tool", J.text_of(v("name"))).withColumn("arguments", J.parsed(v("arguments")))
    calls, answers = F.col("type") == "function_call", F.col("type") == "function_call_output"
    rows = rows.withColumn("call", F.when(calls, M.first(v("call_id"), v("id"))).when(answers, J.text_of(v("call_id"))))
    # An output has the name and arguments of the latest call before it in the same payload.
    learned = F.when(calls & F.col("tool").isNotNull(), F.struct("tool", "arguments"))
    met = E.as_of(rows, ["key", "call"], learned, "known", "item").withColumn("known", F.when(F.col("call").isNotNull(), F.col("known")))
    met = met.withColumn("tool", F.when(answers, F.coalesce(F.nullif("known.tool", F.lit("")), F.col("tool"))).otherwise(F.col("tool")))
    met = M.delegated(met.drop("output"), F.col("tool"), F.when(answers, F.col("known.arguments")).otherwise(F.col("arguments")), F.when(answers, v("output")))
    said = F.when(first, F.col("value")).when(F.col("type") == "message", v("content")).when(answers, v("output")).when(F.col("type") == "reasoning", v("summary"))
    met = met.withColumn("said", said).withColumn("said", M.text(F.col("said"))).withColumn("role", F.coalesce(J.text_of(v("role")), F.lit("unknown")))
    at, model, text, call, tool, role = {"message_index": F.col("item")}, ("model", F.col("model")), F.col("said"), F.col("call"), F.col("tool"), F.col("role")
    thought = M.content(**at, summary_text=text, has_encrypted_content=J.truthy(v("encrypted_content")).isNotNull(), reasoning_id=J.truthy(v("id")))
    return _emitted(
        met,
        F.when(first & (text != ""), M.event("request_system_message", ("system", "instructions"), model, M.content(text=text))),
        F.when(F.col("type") == "message", M.event(_by_role(role, developer="request_system_message"), (role, role), model, M.content(**at, role=role, text=text))),
        F.when(F.col("type") == "reasoning", M.event("assistant_reasoning_final", M.ASSISTANT, model, thought)),
        *[F.when(calls, rule) for rule in M.dispatched(tool, call, F.col("arguments"), **at)],
        F.when(answers, M.event("tool_call_result", ("tool", call), model, M.content(**at, tool_call_id=call, tool_name=tool, output=text))),
        F.when(answers, M.subagent("result", tool, call)),
    )


REQUEST = ("model", "system", "messages", "tools", "anthropic-version", "anthropic_version", "input", "instructions")


def requests(payloads: DataFrame) -> DataFrame:
    """Requests of any dialect; payloads that are no objects give nothing."""
    told = _objects(payloads, *REQUEST).withColumn("blocks", is_block_request("p"))
    of_items = ~F.col("blocks") & J.items(F.col("p.input")).isNotNull()
    return _messages(told.where(~of_items)).unionByName(_items(told.where(of_items)))


def chat_requests(payloads: DataFrame) -> DataFrame:
    return _messages(_objects(payloads, *REQUEST).withColumn("blocks", F.lit(False)))


def block_requests(payloads: DataFrame) -> DataFrame:
    return _messages(_objects(payloads, *REQUEST).withColumn("blocks", F.lit(True)))


def item_requests(payloads: DataFrame) -> DataFrame:
    return _items(_objects(payloads, *REQUEST))


def _of_assistant(content: Column, target: Column, role: Column | None = None, text_type: Column | None = None, result_type: Column | None = None) -> list[Column]:
    """What `block_events` needs of a message that says no more of itself."""
    role, none = F.lit("assistant") if role is None else role, F.lit(None).cast("string")
    return [
        block_units(content).alias("units"), M.block_text(content).alias("whole"), (F.lit("assistant_text_final") if text_type is None else text_type).alias("text_type"),
        (F.lit("tool_call_result") if result_type is None else result_type).alias("result_type"), F.lit(False).alias("always"), _pair(role, role, "id").alias("actor"), target.alias("target"),
        F.lit(None).cast("int").alias("index"), none.alias("role"), _null().alias("tool_call_id"), _null().alias("name"),
    ]


def _choices(objects: DataFrame) -> DataFrame:
    """Responses of choices: for each its text, its reasoning and its calls."""
    rows = J.opened(_listed(objects, J.items(F.col("p.choices")), J.text_of(F.col("p.model")).alias("model")), "value", "c", "message", "reasoning").where("c is not null")
    rows = J.opened(rows.withColumn("message", F.col("c.message")), "message", "m", "content", "reasoning", "tool_calls")
    rows = rows.withColumn("said", M.text(F.col("m.content"))).withColumn("thought", F.coalesce(J.truthy(F.col("m.reasoning")), J.truthy(F.col("c.reasoning")))).withColumn("thought", M.text(F.col("thought")))
    # Place 0 is the message, the others are its calls.
    rows = rows.select(*KEEP, "model", "said", "thought", F.posexplode(F.concat(F.array(_null()), F.coalesce(J.items(F.col("m.tool_calls")), F.array().cast("array<variant>")))).alias("place", "unit"))
    rows = J.opened(J.opened(rows, "unit", "u", "id", "function").withColumn("function", F.col("u.function")), "function", "f", "name", "arguments")
    rows = rows.withColumn("tool", J.text_of(F.col("f.name"))).withColumn("arguments", J.parsed(F.col("f.arguments")))
    rows = M.delegated(rows, F.col("tool"), F.col("arguments"))
    at, model, message = {"choice_index": F.col("item")}, ("model", F.col("model")), F.col("place") == 0
    calls = M.requested(F.col("tool"), J.shown_or_null(F.col("u.id")), F.col("arguments"), **at)
    return _emitted(
        rows,
        F.when(message & (F.col("said") != ""), M.event("assistant_text_final", M.ASSISTANT, model, M.content(**at, text=F.col("said")))),
        F.when(message & (F.col("thought") != ""), M.event("assistant_reasoning_final", M.ASSISTANT, model, M.content(**at, text=F.col("thought")))),
        *[F.when(~message & F.col("u").isNotNull(), e) for e in calls],
        place="place",
    )


def _output(objects: DataFrame) -> DataFrame:
    """Responses of items: their messages and calls."""
    rows = _listed(objects, J.items(F.col("p.output")), J.text_of(F.col("p.model")).alias("model"))
    return _emitted(*_output_items(rows, {"output_index": F.col("item")}, F.lit(True)))


ITEM = ("type", "role", "content", "summary", "name", "call_id", "id", "arguments")


def _output_items(rows: DataFrame, at: dict, where: Column, model: Column | None = None) -> tuple:
    """Rows with an item of a response in `value`, opened, and the rules for its text or its call."""
    rows = J.opened(rows, "value", "v", *ITEM)
    v = lambda name: F.col(f"v.{name}")
    rows = rows.withColumn("kind", J.text_of(v("type"))).withColumn("tool", J.text_of(v("name"))).withColumn("arguments", J.parsed(v("arguments"))).withColumn("said", M.text(F.when(F.col("kind") == "message", v("content"))))
    rows = M.delegated(rows, F.when(F.col("kind") == "function_call", F.col("tool")), F.col("arguments"))
    message = M.event("assistant_text_final", M.ASSISTANT, ("model", F.col("model") if model is None else model), M.content(**at, text=F.col("said"), item_id=v("id")))
    calls = M.requested(F.col("tool"), M.first(v("call_id"), v("id")), F.col("arguments"), **at)
    return rows, F.when(where & (F.col("kind") == "message") & (F.col("said") != ""), message), *[F.when(F.col("kind") == "function_call", e) for e in calls]


RESPONSE = ("model", "choices", "content", "object", "output")


def responses(payloads: DataFrame) -> DataFrame:
    """Responses of any dialect; what is none gives nothing."""
    whole = (J.text_of(F.col("p.object")) == "response") & J.items(F.col("p.output")).isNotNull()
    told = _objects(payloads, *RESPONSE).withColumn("dialect", F.when(F.col("p.choices").isNotNull(), "chat").when(J.items(F.col("p.content")).isNotNull(), "blocks").when(whole, "items"))
    of = lambda name: told.where(F.col("dialect") == name)
    return _choices(of("chat")).unionByName(_block_response(of("blocks"))).unionByName(_output(of("items")))


def _block_response(objects: DataFrame) -> DataFrame:
    target = _pair(F.lit("model"), J.text_of(F.col("p.model")), "name")
    return block_events(objects.withColumn("content", F.col("p.content")).select("key", F.lit(0).alias("item"), *_of_assistant(F.col("content"), target)))


def chat_responses(payloads: DataFrame) -> DataFrame:
    return _choices(_objects(payloads, *RESPONSE))


def block_responses(payloads: DataFrame) -> DataFrame:
    return _block_response(_objects(payloads, *RESPONSE))


def item_responses(payloads: DataFrame) -> DataFrame:
    return _output(_objects(payloads, *RESPONSE))


def agent_messages(payloads: DataFrame) -> DataFrame:
    """Messages of an agent's own transcript: texts, calls and results by role; its start and its result."""
    ship(payloads.sparkSession)
    rows = J.opened(payloads.select("key", "payload"), "payload", "p", "type", "message", "subtype", "result").where("p is not null").withColumn("kind", J.text_of(F.col("p.type")))
    turns = rows.where(F.col("kind").isin("assistant", "user")).select("key", "kind", F.col("p.message").alias("message"))
    turns = J.opened(turns, "message", "m", "role", "content").where("m is not null")
    turns = turns.select("key", F.coalesce(J.shown_or_null(J.truthy(F.col("m.role"))), "kind").alias("by"), F.col("m.content").alias("content"))
    by, target = F.col("by"), F.struct(F.lit("agent").alias("kind"), F.lit("claude_code").alias("name"))
    said, result = F.when(by == "assistant", "assistant_text_final").otherwise("request_user_message"), F.when(by == "user", "tool_call_result").otherwise("tool_call_result_attached")
    spoken = block_events(turns.select("key", F.lit(0).alias("item"), *_of_assistant(F.col("content"), target, by, said, result)))
    rest = rows.where(~F.coalesce(F.col("kind").isin("assistant", "user"), F.lit(False))).withColumn("item", F.lit(0))
    start = F.when(J.text_of(F.col("p.subtype")) == "init", "claude_session_init").otherwise("claude_system_message")
    ended, system = J.text_of(F.col("p.result")), F.coalesce(F.col("kind") == "system", F.lit(False))
    body = F.to_json(F.map_filter(F.col("payload").try_cast("map<string, variant>"), lambda name, _: name != "type"))
    return spoken.unionByName(_emitted(
        rest,
        F.when(system, M.event(start, ("runtime", "claude_sdk"), ("agent", "claude_code"), body)),
        F.when(~system & ended.rlike(r"\S"), M.event("final_output", ("agent", "claude_code"), ("user", "terminal"), M.content(text=ended))),
    ))


def cache_rows(payloads: DataFrame) -> DataFrame:
    """Rows of a cache trace: their messages as a request, then their prompt; the source is in `origin`."""
    rows = _objects(payloads, "messages", "system", "model", "prompt")
    only = F.parse_json(F.to_json(F.struct("p.messages", "p.system", "p.model")))
    asked = requests(rows.where(J.items(F.col("p.messages")).isNotNull()).select("key", only.alias("payload")))
    text = F.coalesce(J.text_of(F.col("p.prompt")), F.to_json("p.prompt"))
    said = _emitted(rows.withColumn("item", F.lit(1 << 40)), F.when(text.rlike(r"\S"), M.event("request_system_message", ("runtime", "openclaw_cache_trace"), ("agent", "openclaw"), M.content(text=text))))
    return asked.withColumn("origin", F.lit("openclaw_cache_trace.messages")).unionByName(said.withColumn("origin", F.lit("openclaw_cache_trace.prompt")))


def cache_trace(lines: DataFrame) -> DataFrame:
    """The events of a cache trace (path, entry_index, value): each different row is imported once, by an event with its
    number and its sorted keys (item -1), then come its messages and its prompt as events below that one.

    Every event is of the platform `openclaw`, is exposed to the runtime only, and has its source; `row_index` numbers the
    rows of a file that stay. Rows are equal if their JSON is, whatever the order of their keys.
    """
    rows = lines.select("path", "entry_index", "value", F.sha2(F.to_json("value"), 256).alias("same"))
    rows = E.number(E.first_of(rows, ["path", "same"], "entry_index"), "entry_index", session="path", index="row_index")
    rows = rows.select("path", "row_index", F.concat_ws(":", "path", "row_index").alias("key"), F.col("value").alias("payload"))
    keys = F.array_sort(F.map_keys(F.col("payload").try_cast("map<string, variant>")))
    told = _emitted(rows.withColumn("item", F.lit(-2)), M.event("openclaw_cache_trace_imported", ("runtime", "openclaw_cache_trace"), ("file", F.col("path")), M.content(row_index=F.col("row_index"), keys=keys)))
    imported = F.sha2(F.concat(F.lit("openclaw_cache_trace_imported:"), "key"), 256)
    found = told.withColumns({"origin": F.lit(None).cast("string"), "parent_event_id": F.lit(None).cast("string"), "event_id": imported})
    below = cache_rows(rows).withColumns({"parent_event_id": imported, "event_id": F.lit(None).cast("string")})
    shown = F.struct(F.lit(False).alias("provider_exposed"), F.lit(True).alias("runtime_exposed"), F.lit(False).alias("user_visible"))
    return found.unionByName(below).withColumns({"platform": F.lit("openclaw"), "visibility": shown, "platform_metadata": F.when(F.col("origin").isNotNull(), F.struct(F.col("origin").alias("source")))})


STREAMED = ("item_id", "output_index", "content_index", "delta", "text", "item", "response")


def item_streams(blocks: DataFrame) -> DataFrame:
    """Streams of items: `key`, block, event and data."""
    ship(blocks.sparkSession)
    rows = J.opened(blocks.select("key", "block", "event", "data"), "data", "d", *STREAMED).where("d is not null")
    d, done = (lambda name: F.col(f"d.{name}")), F.col("event") == "response.output_text.done"
    # A text is final once: an item that repeats it later is left out.
    rows = rows.withColumn("own", F.coalesce(F.when(done, J.text_of(d("item_id"))), J.string(d("item"), "$.id")))
    rows = E.as_of(rows, ["key", "own"], F.when(done, True), "seen", "block").withColumn("seen", F.coalesce(F.col("seen") & F.col("own").isNotNull(), F.lit(False)))
    # A completed response replays its items: place 0 is the event itself, the others are these.
    replayed = F.when(F.col("event") == "response.completed", J.items(d("response"), "$.output"))
    rows = rows.select("key", F.col("block").alias("item"), "event", "d", "seen", F.posexplode(F.concat(F.array(d("item")), F.coalesce(replayed, F.array().cast("array<variant>")))).alias("place", "value"))
    own, ended = F.col("place") == 0, (F.col("place") == 0) & (F.col("event") == "response.output_item.done")
    rows = rows.withColumn("value", F.when(~own | ended, F.col("value")))
    by_assistant = F.when(ended, (J.text_of(F.col("v.role")) == "assistant") & ~F.col("seen")).otherwise(True)
    at = {"output_index": F.when(~own, F.col("place") - 1)}
    rows, message, *calls = _output_items(rows.withColumn("model", F.when(~own, J.string(d("response"), "$.model"))), at, by_assistant)
    rows = rows.withColumn("summary", M.text(F.when(ended & (F.col("kind") == "reasoning"), F.col("v.summary"))))
    model, told = ("model", None), lambda name: J.truthy(d(name)).isNotNull()
    places = {name: d(name) for name in ("item_id", "output_index", "content_index")}
    say = lambda name, where, what: F.when(own & (F.col("event") == name) & where, what)
    return _emitted(
        rows,
        say("response.output_text.delta", told("delta"), M.event("assistant_text_delta", M.ASSISTANT, model, M.content(text=d("delta"), **places))),
        say("response.output_text.done", told("text"), M.event("assistant_text_final", M.ASSISTANT, model, M.content(text=d("text"), **places))),
        say("response.reasoning_summary_text.delta", told("delta"), M.event("assistant_reasoning_delta", M.ASSISTANT, model, M.content(text=d("delta"), item_id=d("item_id")))),
        say("response.reasoning_summary_text.done", told("text"), M.event("assistant_reasoning_final", M.ASSISTANT, model, M.content(text=d("text"), item_id=d("item_id")))),
        *calls, message,
        F.when(ended & (F.col("kind") == "reasoning") & (F.col("summary") != ""), M.event("assistant_reasoning_final", M.ASSISTANT, model, M.content(text=F.col("summary"), item_id=F.col("v.id")))),
        place="place",
    )


def stream_pieces(blocks: DataFrame, carried: bool = True) -> DataFrame:
    """The pieces of streams of blocks: key, index, block, model, begun, stop, head (of a start) and piece (its text).
    The model is the one named last so far, or, not `carried`, that which the event itself names."""
    ship(blocks.sparkSession)
    event = F.col("event")
    rows = J.opened(blocks.select("key", "block", "event", "data"), "data", "d", "index", "content_block", "delta", "message").where("d is not null")
    model = F.when(event == "message_start", J.string(F.col("d.message"), "$.model"))
    rows = E.carry(rows, model, "model", ("key",), "block") if carried else rows.withColumn("model", model)
    is_int = F.startswith(J.kind(F.col("d.index")), F.lit("BIGINT"))
    piece = event.isin("content_block_start", "content_block_delta", "content_block_stop") & is_int
    rows = rows.where(piece if carried else piece | F.col("model").isNotNull()).withColumn("index", F.col("d.index").try_cast("long"))
    rows = rows.withColumn("start", F.when(event == "content_block_start", F.col("d.content_block"))).withColumn("delta", F.when(event == "content_block_delta", F.col("d.delta")))
    rows = J.opened(J.opened(rows, "start", "s", "type", "id", "name", "text", "thinking", "input"), "delta", "t", "type", "text", "thinking", "partial_json").withColumn("kind", J.text_of(F.col("s.type")))
    s, of_kind = (lambda name: F.col(f"s.{name}")), J.text_of(F.col("t.type"))
    said = F.when(F.col("kind") == "text", s("text")).when(F.col("kind").isin("thinking", "redacted_thinking"), F.coalesce(J.truthy(s("thinking")), s("text")))
    rows = rows.withColumn("said", said).withColumn("said", M.text(F.col("said")))
    first = F.when(F.col("kind") == "tool_use", F.coalesce(J.text_of(s("input")), F.to_json(s("input")), F.lit(""))).otherwise(F.col("said"))
    # What a delta of each type adds.
    adds = {"text_delta": "text", "thinking_delta": "thinking", "input_json_delta": "partial_json"}
    more = F.coalesce(*[F.when(of_kind == name, J.shown_or_null(J.truthy(F.col(f"t.{field}")))) for name, field in adds.items()], F.lit(""))
    head = F.when(F.col("s").isNotNull(), F.struct(F.col("kind").alias("type"), s("id").alias("id"), J.text_of(s("name")).alias("name")))
    return rows.select("key", "index", "block", "model", F.col("s").isNotNull().alias("begun"), (event == "content_block_stop").alias("stop"), head.alias("head"), F.when(F.col("s").isNotNull(), first).otherwise(more).alias("piece"))


def finished_blocks(whole: DataFrame) -> DataFrame:
    """The events of finished blocks: key, index, block (their stop), model, head and text."""
    kind, target, at = F.col("head.type"), ("model", F.col("model")), {"block_index": F.col("index")}
    rows = whole.withColumn("item", F.col("block")).withColumn("arguments", F.coalesce(F.try_parse_json("text"), F.parse_json(F.to_json(F.col("text").try_cast("variant")))))
    rows = M.delegated(rows, F.when(kind == "tool_use", F.col("head.name")), F.col("arguments"))
    said, hidden = F.regexp_replace("text", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), F.when(kind == "redacted_thinking", True)
    calls = M.requested(F.col("head.name"), J.shown_or_null(F.col("head.id")), F.col("arguments"), **at)
    return _emitted(
        rows,
        F.when((kind == "text") & (said != ""), M.event("assistant_text_final", M.ASSISTANT, target, M.content(**at, text=said))),
        F.when(kind.isin("thinking", "redacted_thinking") & ((said != "") | hidden.isNotNull()), M.event("assistant_reasoning_final", M.ASSISTANT, target, M.content(**at, text=F.nullif(said, F.lit("")), has_encrypted_content=hidden))),
        *[F.when(kind == "tool_use", e) for e in calls],
    )


def block_streams(blocks: DataFrame) -> DataFrame:
    """Streams of blocks: pieces of one index between its start and its stop are one block; unfinished ones are dropped."""
    pieces = stream_pieces(blocks)
    window = Window.partitionBy("key", "index").orderBy("block")
    # A start or the piece after a stop begins a new block.
    told = pieces.withColumn("part", F.sum((F.col("begun") | F.coalesce(F.lag("stop").over(window), F.lit(False))).cast("long")).over(window))
    texts = F.array_sort(F.collect_list(F.struct("block", "piece")))
    whole = told.groupBy("key", "index", "part").agg(
        F.max(F.when(F.col("stop"), F.col("block"))).alias("block"), F.max_by("model", "block").alias("model"), F.first("head", ignorenulls=True).alias("head"), F.array_join(F.transform(texts, lambda t: t["piece"]), "").alias("text")
    ).where("block is not null and head is not null")
    return finished_blocks(whole)


def response_streams(bodies: DataFrame) -> DataFrame:
    """Streamed responses (key, body) of either dialect."""
    blocks = stream_events(bodies.select("key", "body"))
    of_blocks = F.coalesce(F.max(F.col("event").isin(BLOCK_STREAM)).over(Window.partitionBy("key")), F.lit(False))
    told = blocks.withColumn("_blocks", of_blocks)
    return block_streams(told.where("_blocks").drop("_blocks")).unionByName(item_streams(told.where(~F.col("_blocks")).drop("_blocks")))
