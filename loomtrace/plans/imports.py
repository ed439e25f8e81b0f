"""Tables that a runtime keeps beside its logs (threads, spawned threads, log lines, history, snapshots), as events.

The tables come staged: from a JDBC source, Parquet or JSON Lines, with the columns named here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import emit as M
from ..functions import text as X

RUNTIME, AGENT = ("runtime", "codex_adapter"), ("agent", "codex")
#: Log lines of a thread that count, in order.
LOG_LINES = 500


def threads_of(threads: DataFrame, sessions: DataFrame) -> DataFrame:
    """The threads (id, updated_at, ...) of sessions (session_id, thread_id) with their session; order by updated_at."""
    wanted = sessions.select("session_id", F.col("thread_id").alias("_thread")).distinct()
    return threads.join(wanted, F.col("id") == F.col("_thread")).drop("_thread")


def edges_of(edges: DataFrame, sessions: DataFrame) -> DataFrame:
    """The spawned threads (parent_thread_id, child_thread_id, status) of sessions (session_id, thread_id); order by parent, then child."""
    wanted = sessions.select("session_id", F.col("thread_id").alias("_thread")).distinct()
    return edges.join(wanted, F.col("parent_thread_id") == F.col("_thread")).drop("_thread")


def log_lines(logs: DataFrame, threads: DataFrame, most: int = LOG_LINES) -> DataFrame:
    """The first `most` log lines (thread_id, ts, ts_nanos, id, ...) of threads (thread_id, started) since their start, with their place."""
    since = threads.groupBy(F.col("thread_id").alias("_thread")).agg(F.min("started").alias("_started"))
    met = logs.join(since, (F.col("thread_id") == F.col("_thread")) & (F.col("ts") >= F.col("_started"))).drop("_thread", "_started")
    return met.withColumn("place", F.row_number().over(Window.partitionBy("thread_id").orderBy("ts", "ts_nanos", "id"))).where(F.col("place") <= most)


def history_kept(rows: DataFrame, threads: DataFrame | None = None, started: float | None = None) -> DataFrame:
    """History rows (session_id, ts, text) since a time and of known threads (thread_id); rows without a time pass,
    and without any known thread all rows do."""
    late = rows if started is None else rows.where(F.col("ts").isNull() | (F.col("ts").cast("long") >= started))
    if threads is None:
        return late
    known = threads.select(F.col("thread_id").alias("session_id")).where(F.col("session_id").isNotNull()).distinct()
    unknown = known.agg((F.count("*") == 0).alias("_none"))
    marked = late.join(known.withColumn("_known", F.lit(True)), "session_id", "left").join(F.broadcast(unknown))  # one row
    return marked.where(F.coalesce("_known", F.lit(False)) | F.col("_none")).drop("_known", "_none")


def thread_events(threads: DataFrame) -> DataFrame:
    """One event of each thread of `threads_of`, and one of each session that says how many there are (place 0)."""
    own = [name for name in threads.columns if name != "session_id"]
    context = F.struct(*[F.col(source).alias(name) for name, source in (("cwd", "cwd"), ("git_branch", "git_branch"), ("git_head", "git_sha")) if source in own])
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("updated_at", "id"))
    each = threads.select("session_id", place.alias("place"), X.iso_millis(F.col("updated_at").cast("double")).alias("timestamp"), M.event("codex_thread_detected", RUNTIME, ("thread", F.col("id")), F.to_json(F.struct(*own))).alias("e"), F.to_json(context).alias("context_ref"))
    return _counted(threads, "codex_threads_imported").unionByName(each.select("session_id", "place", "timestamp", "e.*", "context_ref"), allowMissingColumns=True)


def edge_events(edges: DataFrame) -> DataFrame:
    """One event of each spawned thread of `edges_of`, and one of each session that says how many there are (place 0)."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("parent_thread_id", "child_thread_id"))
    what = M.content(**{name: F.col(name) for name in ("parent_thread_id", "child_thread_id", "status")})
    each = edges.select("session_id", place.alias("place"), M.event("subagent_spawned", ("agent", F.col("parent_thread_id")), ("agent", F.col("child_thread_id")), what).alias("e"))
    return _counted(edges, "codex_spawn_edges_imported").unionByName(each.select("session_id", "place", "e.*"))


def log_events(lines: DataFrame, sessions: DataFrame) -> DataFrame:
    """For each session (session_id, thread_id) one event of each of its threads with log lines (of `log_lines`)."""
    counted = lines.groupBy("thread_id").agg(F.count("*").alias("n"))
    what = M.content(codex_thread_id=F.col("thread_id"), count=F.col("n"))
    return sessions.join(counted, "thread_id").select("session_id", F.lit(0).alias("place"), M.event("codex_thread_logs_imported", RUNTIME, ("thread", F.col("thread_id")), what).alias("e")).select("session_id", "place", "e.*")


def _counted(rows: DataFrame, kind: str) -> DataFrame:
    found = rows.groupBy("session_id").agg(F.count("*").alias("n"))
    return found.select("session_id", F.lit(0).alias("place"), M.event(kind, RUNTIME, AGENT, M.content(count=F.col("n"))).alias("e")).select("session_id", "place", "e.*")


def request_metadata(headers: Column) -> Column:
    """What the headers of a request (a map) say of its turn: turn_id, codex_thread_id, codex_window_id, session_id_header
    and codex_turn_metadata (JSON text, or the raw text under `raw` if it is none). Names are either in lower case or in capitals."""
    either = lambda *names: F.coalesce(*[F.nullif(F.element_at(headers, name), F.lit("")) for name in names])
    raw, session = either("x-codex-turn-metadata", "X-Codex-Turn-Metadata"), either("session_id", "Session-Id")
    turn = F.try_parse_json(raw)
    said = lambda name: F.when(F.startswith(F.schema_of_variant(F.try_variant_get(turn, f"$.{name}", "variant")), F.lit("STRING")), F.nullif(F.try_variant_get(turn, f"$.{name}", "string"), F.lit("")))
    told = F.when(turn.isNull() & raw.isNotNull(), F.to_json(F.struct(raw.alias("raw")))).when(F.startswith(F.schema_of_variant(turn), F.lit("OBJECT")), F.to_json(turn))
    return F.struct(
        said("turn_id").alias("turn_id"), F.coalesce(said("session_id"), session).alias("codex_thread_id"), either("x-codex-window-id", "X-Codex-Window-Id").alias("codex_window_id"),
        session.alias("session_id_header"), told.alias("codex_turn_metadata"),
    )


def upstream(base: Column, path: Column) -> Column:
    """Where a request goes: the url of a base and the path of the request joined, and that path with its query."""
    part = lambda url, group: F.regexp_extract(url, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$", group)
    merged = F.concat(F.regexp_replace(part(base, 3), "/+$", ""), part(path, 3))
    rest = F.concat(merged, F.regexp_replace(part(path, 4), r"^\?$", ""), F.regexp_replace(part(path, 5), "^#$", ""))
    return F.struct(F.concat(part(base, 1), F.lit("://"), part(base, 2), rest).alias("url"), rest.alias("path"))


def host_digest(name: Column) -> Column:
    return F.substring(F.sha2(name, 256), 1, 12)


def context_ref(snapshot: str = "snapshot") -> Column:
    """What events keep of a snapshot (a struct) of their surroundings."""
    return F.struct(*[F.col(f"{snapshot}.{name}").alias(name) for name in ("cwd", "repo_root", "git_branch", "git_head")])
