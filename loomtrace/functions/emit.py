"""Building blocks of canonical events: text of nested content, and event structs.

An event struct has its type, actor, target and content as JSON text without null fields; rules give events as
columns in which null stands for one that doesn't apply, and `exploded` makes rows of them.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocabulary as V
from . import values as J

FIELDS = ("event_type", "actor_kind", "actor_id", "target_kind", "target_name", "content")


def pieces(content, results: bool = True):
    """The texts in a parsed JSON value, in order, however deep they lie.

    Lists nest through tool results (if `results`) and objects through their content; what is neither text nor one of
    these is shown as Python shows it.
    """
    waiting = [content]
    while waiting:
        value = waiting.pop()
        if isinstance(value, list):
            waiting += [part for item in reversed(value) if (part := _part(item, results))]
        elif isinstance(value, dict) and value.get("text") is not None:
            yield str(value["text"])
        elif isinstance(value, dict) and value.get("content") is not None:
            waiting.append(value["content"])
        elif value is not None:
            yield str(value)


def _part(item, results: bool):
    """What an item of a list says: a text, or the content of a tool result."""
    if not isinstance(item, dict):
        return item if isinstance(item, str) else None
    kind = item.get("type")
    if kind == "tool_result":
        return item.get("content") if results else None
    said = item.get("text") if kind in V.TEXT_BLOCKS else item.get("thinking") if kind == "thinking" else None
    return str(said) if said else None


def spoken(blocks):
    """The texts of the text blocks of a message: those of no type as a whole, those of a text type by their text."""
    for block in blocks if isinstance(blocks, list) else [blocks]:
        if isinstance(block, str):
            yield block
        elif isinstance(block, dict):
            kind = block.get("type")
            yield from pieces(block if kind is None else block.get("text") if kind in V.TEXT_BLOCKS else None)
        elif block is not None and block is blocks:
            yield str(block)


def _joined(said):
    @F.pandas_udf(T.StringType())
    def join(values: pd.Series) -> pd.Series:
        return values.map(lambda value: None if value is None else "\n".join(filter(None, said(json.loads(value)))))

    return join


_deep, _deep_without_results, _spoken = _joined(pieces), _joined(lambda value: pieces(value, False)), _joined(spoken)


def _told(content: Column, join) -> Column:
    # Most content is one string; only the rest goes to Python.
    plain = J.text_of(content)
    return F.when(content.isNull(), "").otherwise(F.coalesce(plain, join(F.when(plain.isNull() & content.isNotNull(), F.to_json(content))), F.lit("")))


def text(content: Column, results: bool = True) -> Column:
    """The text of a variant column: of a string, of the blocks of a list, or of an object's text or content; null is empty."""
    return _told(content, _deep if results else _deep_without_results)


def block_text(content: Column) -> Column:
    """The text of all text blocks of a message's content."""
    return _told(content, _spoken)


def content(**fields: Column | str | bool | None) -> Column:
    columns = [(value if isinstance(value, Column) else F.lit(value)).alias(name) for name, value in fields.items() if value is not None]
    return F.to_json(F.struct(*columns)) if columns else F.lit("{}")


def event(kind: Column | str, actor: tuple, target: tuple, what: Column) -> Column:
    parts = (kind, *actor, *target, what)
    return F.struct(*[(p if isinstance(p, Column) else F.lit(p).cast("string")).alias(name) for p, name in zip(parts, FIELDS, strict=True)])


def exploded(rows: DataFrame, keep: list[str], rules: list[Column], place: Column | None = None) -> DataFrame:
    """The events that rules give for each row: `keep`, emit and the fields of an event. The rows of one item are told apart by `place`."""
    # The outer form, as Spark would push a test of the array, with all rules in it, below every step before.
    made = rows.select(*keep, (F.lit(0) if place is None else place).alias("_place"), F.array(*rules).alias("_events"))
    found = made.select(*keep, "_place", F.posexplode_outer("_events").alias("_rule", "_event")).where("_event is not null")
    return found.select(*keep, (F.col("_place") * len(rules) + F.col("_rule")).cast("int").alias("emit"), *[f"_event.{name}" for name in FIELDS])


ASSISTANT, DISPATCHER, SUBAGENTS = ("assistant", "assistant"), ("runtime", "tool_dispatcher"), ("runtime", "subagent_runtime")
ASKED = ("agent_type", "model", "name", "target", "message", "items", "interrupt", "reasoning_effort", "fork_context", "targets", "timeout_ms", "id")
MADE = ("id", "agent_id", "nickname", "user_facing_nickname", "name", "target", "targets")


def delegated(rows: DataFrame, tool: Column, arguments: Column, output: Column | None = None) -> DataFrame:
    """`rows` with what `subagent` needs of the arguments and the output of calls of delegation tools: asked, made, output."""
    of_tool = lambda value: F.when(tool.isin(V.DELEGATE_TOOLS), J.parsed(value))
    none = F.lit(None).cast("variant")
    told = rows.withColumn("asked", of_tool(arguments)).withColumn("made", none if output is None else of_tool(output)).withColumn("output", F.col("made"))
    return J.opened(J.opened(told, "asked", "asked", *ASKED), "made", "made", *MADE)


def subagent(stage: str, tool: Column, call: Column) -> Column:
    """What a call of a delegation tool means at a stage (requested, dispatched, result), from rows of `delegated`; null if nothing."""
    get, name = (lambda field: F.col(f"asked.{field}")), (lambda field: F.nullif(J.text_of(F.col(f"asked.{field}")), F.lit("")))
    made = lambda field: F.nullif(J.text_of(F.col(f"made.{field}")), F.lit(""))
    agent = lambda who: ("agent", who)
    spawn = F.coalesce(name("agent_type"), name("model"), name("name"), F.lit("subagent"))
    common, output = {"tool_call_id": call}, F.col("output")
    sent = common | {"target_agent_id": name("target"), "message": get("message"), "items": get("items"), "interrupt": get("interrupt")}
    actor = ASSISTANT if stage == "requested" else SUBAGENTS
    # Delivery states by stage.
    state = {"requested": "requested", "dispatched": "dispatched", "result": "acknowledged"}[stage]
    rules = {"send_input": event("subagent_message", actor, agent(name("target")), content(**sent, delivery_state=state, result=output if stage == "result" else None))}
    if stage == "requested":
        rules["spawn_agent"] = event("subagent_spawn_requested", ASSISTANT, agent(spawn), content(**common, **{key: get(key) for key in ("agent_type", "model", "reasoning_effort", "fork_context", "message", "items")}))
    if stage == "result":
        agent_id, nickname = F.coalesce(made("id"), made("agent_id")), F.coalesce(made("nickname"), made("user_facing_nickname"), made("name"))
        rules["spawn_agent"] = event("subagent_spawned", SUBAGENTS, agent(F.coalesce(agent_id, nickname, spawn)), content(**common, agent_id=agent_id, nickname=nickname, agent_type=get("agent_type"), model=get("model"), message=get("message"), result=output))
        filled = lambda side: F.filter(F.transform(J.items(F.col(f"{side}.targets")), lambda t: F.nullif(J.text_of(t), F.lit(""))), lambda t: t.isNotNull())
        asked, told = filled("asked"), filled("made")
        targets = F.coalesce(F.when(F.size(asked) > 0, asked), F.when(F.size(told) > 0, told), F.array().cast("array<string>"))
        rules["wait_agent"] = event("subagent_result", SUBAGENTS, agent(F.get(targets, F.lit(0))), content(**common, targets=targets, timeout_ms=get("timeout_ms"), result=output))
        ended = F.coalesce(name("id"), name("target"), made("id"), made("target"))
        for tool_name, kind in (("resume_agent", "subagent_resumed"), ("close_agent", "subagent_closed")):
            rules[tool_name] = event(kind, SUBAGENTS, agent(ended), content(**common, agent_id=ended, result=output))
    chosen = F.when(F.lit(False), next(iter(rules.values())))
    for tool_name, rule in rules.items():
        chosen = chosen.when(tool == tool_name, rule)
    return chosen


def requested(tool: Column, call: Column, arguments: Column, **more: Column) -> list[Column]:
    return [event("tool_call_requested", ASSISTANT, ("tool", tool), content(**more, tool_call_id=call, tool_name=tool, arguments=arguments)), subagent("requested", tool, call)]


def dispatched(tool: Column, call: Column, arguments: Column, **more: Column) -> list[Column]:
    return [event("tool_call_dispatched", DISPATCHER, ("tool", tool), content(**more, tool_call_id=call, tool_name=tool, arguments=arguments)), subagent("dispatched", tool, call)]


def first(*values: Column) -> Column:
    """The first of some variants that doesn't count as false, as text."""
    return F.coalesce(*[J.shown_or_null(J.truthy(value)) for value in values])
