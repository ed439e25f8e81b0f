"""Session reports: counts by type and a timeline that leaves out noise and repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import text as X
from ..functions import values as J
from ..operators import events as E
from ..session import cut

JSON_TYPES = ["tool_call_requested", "tool_call_dispatched", "tool_call_result", "subagent_result"]
#: Fields of content that a report shows.
SHOWN = (
    "text", "summary_text", "has_encrypted_content", "phase", "headless", "structured_stream", "output_format", "session_id", "cwd", "model", "tool_name", "output", "error", "agent_type", "message", "agent_id", "nickname",
    "target_agent_id", "delivery_state", "path", "count", "approval_policy", "turn_id", "duration_ms", "reason", "proxy_enabled", "cache_trace_path", "exit_code",
)


def _line() -> Column:
    """What the timeline says of an event (its content in `c`), by its type; null leaves it out."""
    mark, show = (lambda name: J.or_mark(F.col(f"c.{name}"))), (lambda name: J.shown(F.col(f"c.{name}")))
    text = lambda *names: X.line(X.first_filled(*[J.text_of(F.col(f"c.{name}")) for name in names]))
    json = lambda name: X.line(F.col(f"json.{name}"))
    reasoning = F.coalesce(F.nullif(text("text", "summary_text"), F.lit("")), F.when(J.truthy(F.col("c.has_encrypted_content")).isNotNull(), F.lit("[encrypted reasoning content present]")))
    phase = F.coalesce(F.concat(F.lit("["), F.nullif(J.text_of(F.col("c.phase")), F.lit("")), F.lit("]")), F.lit(""))
    # What a report says of each type, in order.
    says = {
        "user_input": ["User: ", text("text")], "request_user_message": ["User: ", text("text")],
        "assistant_text_final": ["Assistant", phase, ": ", text("text")], "final_output": ["Final: ", text("text")],
        "claude_capture_mode": ["Claude capture mode: headless=", show("headless"), " structured_stream=", show("structured_stream"), " output_format=", mark("output_format")],
        "claude_session_init": ["Claude session init: session_id=", mark("session_id"), " cwd=", mark("cwd"), " model=", mark("model")],
        "assistant_reasoning_final": ["Reasoning: ", reasoning],
        "tool_call_requested": ["Tool requested: ", mark("tool_name"), " ", json("arguments")], "tool_call_dispatched": ["Tool dispatched: ", mark("tool_name"), " ", json("arguments")],
        "tool_call_stdout": ["Tool stdout: ", mark("tool_name"), " ", text("text")], "tool_call_stderr": ["Tool stderr: ", mark("tool_name"), " ", text("text")],
        "tool_call_result": ["Tool result: ", mark("tool_name"), " ", F.coalesce(F.nullif(text("output"), F.lit("")), json("output"))],
        "tool_call_error": ["Tool error: ", mark("tool_name"), " ", text("error")],
        "subagent_spawn_requested": ["Subagent spawn requested: type=", mark("agent_type"), " message=", text("message")],
        "subagent_spawned": ["Subagent spawned: agent_id=", mark("agent_id"), " nickname=", mark("nickname")],
        "subagent_message": ["Subagent message: target=", mark("target_agent_id"), " state=", mark("delivery_state"), " message=", text("message")],
        "subagent_result": ["Subagent result: targets=", json("targets"), " result=", json("result")],
        "subagent_resumed": ["Subagent resumed: agent_id=", mark("agent_id")], "subagent_closed": ["Subagent closed: agent_id=", mark("agent_id")],
        "codex_rollout_imported": ["Codex rollout imported: path=", mark("path"), " count=", show("count")],
        "codex_turn_context": ["Codex turn context: cwd=", mark("cwd"), " model=", mark("model"), " approval=", mark("approval_policy")],
        "codex_task_started": ["Codex task started: turn_id=", mark("turn_id")], "codex_task_complete": ["Codex task complete: turn_id=", mark("turn_id"), " duration_ms=", show("duration_ms")],
        "codex_turn_aborted": ["Codex turn aborted: reason=", mark("reason")], "codex_context_compacted": ["Codex context compacted"],
        "openclaw_overlay_configured": ["OpenClaw overlay configured: proxy_enabled=", show("proxy_enabled"), " cache_trace_path=", mark("cache_trace_path")],
        "session_started": ["Session started: cwd=", mark("cwd")], "session_ended": ["Session ended: exit_code=", show("exit_code")],
    }
    line = F.when(F.lit(False), F.lit(""))
    for kind, parts in says.items():
        line = line.when(F.col("event_type") == kind, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    return line


def _said(events: DataFrame) -> DataFrame:
    """What a report could say of each event. Written once: tests of a line would be pushed below it, each with all rules of a line in it."""
    shown = events.where(F.col("event_type").isin(V.INCLUDED_TYPES)).select("session_id", "event_index", "event_type", "timestamp", "content", F.when(F.col("event_type").isin(JSON_TYPES), F.col("raw")).alias("raw"))
    shown = J.opened(J.with_texts(shown), "content", "c", *SHOWN)
    return cut(shown.select("session_id", "event_index", "event_type", "timestamp", _line().alias("said"))).where("said is not null")


def timeline(said: DataFrame) -> DataFrame:
    """session_id, event_index, event_type and line of what a report shows, in order of event_index.

    Prompts and reasoning that say the same as before are left out first, then lines that repeat the one before.
    """
    once = E.first_where(said, F.col("event_type").isin(V.ONCE_BY_LINE_TYPES), ["session_id", "event_type", "said"])
    line = F.concat(F.lit("- "), F.coalesce(F.nullif("timestamp", F.lit("")), F.lit("?")), F.lit(" ["), "event_type", F.lit("] "), "said")
    return E.collapse_runs(once.withColumn("line", line), "line").select("session_id", "event_index", "event_type", "line")


def place(section: int, first: Column | int = 0, second: Column | int = 0) -> Column:
    """Where a line is in its page."""
    long = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("long")
    return F.struct(F.lit(section).alias("section"), long(first).alias("first"), long(second).alias("second")).alias("at")


def fixed(rows: DataFrame, *sections: list[Column | str]) -> DataFrame:
    """The lines that each session has besides its own: session_id, at, value; null ones are left out. Sections are numbered by twos."""
    lines = [F.struct(place(2 * n, k), (F.lit(value) if isinstance(value, str) else value).alias("value")) for n, section in enumerate(sections) for k, value in enumerate(section)]
    return rows.select("session_id", F.explode(F.array(*lines)).alias("l")).where("l.value is not null").select("session_id", "l.at", "l.value")


def lines(events: DataFrame, manifests: DataFrame, include_noisy: bool = False) -> DataFrame:
    """session_id, at (the place in the page) and value: the lines of the report of each session of `manifests`, however many they are."""
    noisy = F.coalesce(F.col("event_type").isin(V.NOISY_TYPES), F.lit(False))
    hidden = F.when(noisy & F.lit(not include_noisy), F.lit(" (hidden by default)")).otherwise("")
    counted = E.counts(events).select("session_id", place(1, -F.col("n"), F.col("first_index")), F.concat(F.lit("- "), F.coalesce("event_type", F.lit("None")), F.lit(": "), F.col("n").cast("string"), hidden).alias("value"))
    said = _said(events)
    told = timeline(said).select("session_id", place(3, F.col("event_index")), F.col("line").alias("value"))
    silent = manifests.join(said.select("session_id").distinct(), "session_id", "left_anti").select("session_id", place(3), F.lit("- [no included timeline events]").alias("value"))
    whole = manifests.join(E.totals(events, V.NOISY_TYPES), "session_id", "left")
    get = lambda name: J.field("manifest", f"$.{name}")
    item = lambda name, value: F.concat(F.lit(f"- {name}: "), value)
    json = lambda name: X.line(J.python_json(F.coalesce(F.to_json(get(name)), F.lit("null"))))
    head = [
        F.concat(F.lit("# Session Report: "), "session_id"), "", "## Summary", "",
        item("session_id", F.coalesce(F.when(J.truthy(get("session_id")).isNotNull(), J.shown(get("session_id"))), "session_id")),
        item("agent", J.or_mark(get("agent"))), item("cwd", J.or_mark(get("cwd"))), item("command", json("command")), item("provider", J.or_mark(get("provider"))),
        item("total_events", F.coalesce("total_events", F.lit(0)).cast("string")), item("noisy_events_hidden", F.lit("0") if include_noisy else F.coalesce("noisy_events", F.lit(0)).cast("string")),
        *[F.when(J.truthy(get(name)).isNotNull(), item(name, json(name))) for name in ("codex_thread_ids", "codex_rollout_paths")],
        "", "## Event Counts", "",
    ]
    # The notes of a report.
    notes = [
        "", "## Notes", "", "- `events.jsonl` is machine-oriented and intentionally verbose.", "- Large counts of `tty_output_chunk` and `assistant_text_delta` are normal in interactive sessions.",
        "- This report hides low-signal events by default so humans can read the session quickly.", "",
    ]
    own = counted.unionByName(told).join(manifests.select("session_id"), "session_id", "left_semi")
    return fixed(whole, head, ["", "## Timeline", ""], notes).unionByName(own).unionByName(silent)


def build(events: DataFrame, manifests: DataFrame, include_noisy: bool = False) -> DataFrame:
    """session_id and text: the report of each session of `manifests` as one text; `lines` has it for pages that are too long for a row."""
    return E.joined_in_order(lines(events, manifests, include_noisy), "value", ["session_id"], "at")
