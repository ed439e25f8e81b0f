"""Operators on tables of events: a session, a dense index of the order in it, and any other columns.

Windows are partitioned by session (and finer where the question allows it); a reader of the past that
needs few rows of it finds them by a scan over chunks (`scan`), so no step grows with the square of a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan

SESSION, INDEX = "session_id", "event_index"


def _before(*keys: str, order: str = INDEX):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def number(events: DataFrame, *order: str, session: str = SESSION, index: str = INDEX) -> DataFrame:
    """A dense index from 0 in each session."""
    return events.withColumn(index, (F.row_number().over(Window.partitionBy(session).orderBy(*order)) - 1).cast("long"))


def counts(events: DataFrame, kind: str = "event_type", keys: tuple[str, ...] = (SESSION,)) -> DataFrame:
    """Events of each type with the first index; order by n descending, then first."""
    return events.groupBy(*keys, kind).agg(F.count("*").alias("n"), F.min(INDEX).alias("first_index"))


def totals(events: DataFrame, noisy: list[str], kind: str = "event_type") -> DataFrame:
    return events.groupBy(SESSION).agg(F.count("*").alias("total_events"), F.count_if(F.col(kind).isin(noisy)).alias("noisy_events"))


def first_of(rows: DataFrame, keys: list[str], order: str = INDEX) -> DataFrame:
    """The first row of each key; null keys are keys like others."""
    window = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_place", F.row_number().over(window)).where("_place = 1").drop("_place")


def first_where(rows: DataFrame, eligible: Column, keys: list[str], order: str = INDEX) -> DataFrame:
    """The first row of each key among the eligible ones, and all others (each of which is a key of its own)."""
    marked = rows.withColumn("_others", F.when(eligible, None).otherwise(F.col(order)))
    window = Window.partitionBy(*keys, "_others").orderBy(order)
    return marked.withColumn("_place", F.row_number().over(window)).where((F.col("_place") == 1) | F.col("_others").isNotNull()).drop("_place", "_others")


def collapse_runs(rows: DataFrame, line: str, order: str = INDEX) -> DataFrame:
    """Without rows whose line equals that of the row before."""
    window = Window.partitionBy(SESSION).orderBy(order)
    return rows.withColumn("_last", F.struct(F.lag(line).over(window).alias("line"), (F.row_number().over(window) > 1).alias("there"))).where(~(F.col("_last.there") & F.col("_last.line").eqNullSafe(F.col(line)))).drop("_last")


def carry(rows: DataFrame, value: Column, name: str, keys: tuple[str, ...] = (SESSION,), order: str = INDEX, own: bool = True) -> DataFrame:
    """The last value that isn't null so far, with the row's own one or only before it."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(window))


def last_user(events: DataFrame, direct: Column, prompt: Column, name: str = "last_user_index") -> DataFrame:
    """The nearest earlier direct message, or else the nearest earlier prompt message."""
    window = _before(SESSION)
    return events.withColumn(name, F.coalesce(F.max(F.when(direct, F.col(INDEX))).over(window), F.max(F.when(prompt, F.col(INDEX))).over(window)))


def recent_unique(events: DataFrame, wanted: Column | dict[str, Column], asking: Column, key: str, columns: list[str], most: int, chunk: int = scan.CHUNK) -> DataFrame:
    """For each asking row, the latest `most` wanted rows before it that differ in `key`, each key by its latest row.
    Several kinds of wanted rows, none of them of two kinds, are each counted for themselves; `kind` tells them apart.

    References are found by a scan over chunks of `chunk` rows; the columns of the rows come last.
    """
    kinds = wanted if isinstance(wanted, dict) else {"": wanted}
    kind = F.coalesce(*[F.when(of, F.lit(name)) for name, of in kinds.items()])
    rows = events.select(F.col(SESSION).alias("session"), F.col(INDEX).alias("pos"), kind.alias("kind"), F.col(key).alias("key"), F.coalesce(asking, F.lit(False)).alias("asks"))
    found = scan.last_different(rows.where(F.col("kind").isNotNull() | F.col("asks")), most, chunk)
    references = found.withColumnsRenamed({"session": SESSION, "pos": INDEX})
    return _told(references, events, [name for name in dict.fromkeys([key, *columns]) if name != INDEX])


def _told(references: DataFrame, events: DataFrame, columns: list[str]) -> DataFrame:
    """References (session, index) with columns of their rows."""
    if not columns:
        return references
    told = events.select(F.col(SESSION).alias("_of"), F.col(INDEX).alias("_at"), *columns)
    return references.join(told, F.col(SESSION).eqNullSafe(F.col("_of")) & (F.col(INDEX) == F.col("_at"))).drop("_of", "_at")


def latest_since(events: DataFrame, wanted: Column, asking: Column, since: str, columns: list[str], most: int, chunk: int = scan.CHUNK) -> DataFrame:
    """For each asking row, the latest `most` wanted rows before it and after its index `since` (null: from the start)."""
    rows = events.select(F.col(SESSION).alias("session"), F.col(INDEX).alias("pos"), F.when(wanted, F.lit("")).alias("kind"), F.col(INDEX).alias("key"), F.coalesce(asking, F.lit(False)).alias("asks"))
    found = scan.last_different(rows.where(F.col("kind").isNotNull() | F.col("asks")), most, chunk).select(F.col("session").alias(SESSION), "asked", F.col("pos").alias(INDEX))
    starts = events.where(asking).select(F.col(SESSION).alias("_of"), F.col(INDEX).alias("_asked"), F.col(since).alias("_since"))
    near = found.join(starts, F.col(SESSION).eqNullSafe(F.col("_of")) & (F.col("asked") == F.col("_asked")))
    near = near.where(F.col("_since").isNull() | (F.col(INDEX) > F.col("_since"))).select(SESSION, "asked", INDEX)
    return _told(near, events, [name for name in dict.fromkeys(columns) if name != INDEX])


def after_with_key(events: DataFrame, asking: Column, wanted: Column, key: str, columns: list[str]) -> DataFrame:
    """For each asking row with a key, the wanted rows after it with the same key."""
    asks = events.where(asking & F.col(key).isNotNull()).select(F.col(SESSION).alias("_of"), F.col(key).alias("_key"), F.col(INDEX).alias("asked"))
    found = events.where(wanted & F.col(key).isNotNull()).select(SESSION, key, *dict.fromkeys([INDEX, *columns]))
    return asks.join(found, F.col(SESSION).eqNullSafe(F.col("_of")) & (F.col("_key") == F.col(key)) & (F.col(INDEX) > F.col("asked"))).drop("_of", "_key")


def as_of(rows: DataFrame, keys: list[str], value: Column, name: str, order: str = INDEX) -> DataFrame:
    """The latest earlier value of the same key."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(_before(*keys, order=order)))


def nearest(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, before: float, after: float, most: int, left_id: str, right_id: str | None = None) -> DataFrame:
    """For each left row, the `most` right rows of its key in [time - before, time + after] seconds, nearest first, earlier first,
    then by `right_id`, without which rows of one time have no order.

    Times meet in cells as long as the interval, so a key with many rows meets only its neighbours in time.
    """
    cell = float(before + after)
    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    lefts = left.withColumn("_cell", F.explode(F.array_distinct(F.array(F.floor((seconds(left_time) - before) / cell), F.floor((seconds(left_time) + after) / cell)))))
    met = lefts.join(right.withColumn("_cell", F.floor(seconds(right_time) / cell)), [*on, "_cell"])
    gap = seconds(right_time) - seconds(left_time)
    near = met.where((gap >= -before) & (gap <= after)).withColumn("gap", F.abs(gap))
    return near.withColumn("place", F.row_number().over(Window.partitionBy(left_id).orderBy("gap", right_time, *([right_id] if right_id else [])))).where(F.col("place") <= most).drop("_cell")


def having(events: DataFrame, condition: Column) -> DataFrame:
    """The sessions that have such an event."""
    return events.where(condition).select(SESSION).distinct()


def distinct_in_order(rows: DataFrame, value: str, keys: tuple[str, ...] = (SESSION,), order: str = INDEX, name: str = "values") -> DataFrame:
    """The distinct values of each key in the order of their first rows."""
    first = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("_first"))
    pairs = F.array_sort(F.collect_list(F.struct("_first", value)))
    return first.groupBy(*keys).agg(F.transform(pairs, lambda p: p[value]).alias(name))


def joined_in_order(rows: DataFrame, text: str, keys: list[str], order: str = INDEX, separator: str = "\n", name: str = "text") -> DataFrame:
    """The texts of each key in order, joined."""
    pairs = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda p: p[text]), separator).alias(name))
