"""Mixing sources to target weights by balanced sampling with the cube method.

Sizes are counts of words. Sources, by code point with null last, weigh 3, 1, 2
and so on; they share `share` of all sizes. A target stops at `most` times its
source's size and the excess is shared again by weight among the others, which
settles where target = min(weight x level, most x size).

Every document of a source is due target / size copies. The whole part is
taken; the fraction is an inclusion probability, settled by the cube method:
moves along the null-space of the two constraints (words, documents) keep both
totals while each move fixes one document at 0 or 1. Documents are dealt into
blocks of about `BLOCK` by a hash of their id, so a source of any size is many
tasks; a block leaves at most two fractions, which meet in the next round's
blocks until a source has one block. There the landing phase gives up the
document total first, then the word total, for the last two documents.

Equal rows (one doc_id, source, size and text) are one unit, due as many copies
as all of them together; the rows share what it gets evenly. So no block fills
with them, and blocks are of about `BLOCK` units however rows repeat.

Random numbers come from the source, the block and the round, and blocks are
ordered by unit, so reruns agree. A null or empty text has size 0; a source
without words has target 0 and takes nothing; very long texts are one document
of their size; an empty table gives no rows. `mixed` gives copies to rows, not to
doc_ids, which may repeat or be null, and keeps all columns whatever their names.
The sources themselves are ordered in one task, a row each.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, packed_row, ship, text_or_empty

WEIGHTS = (3, 1, 2)
BLOCK = 4096
TINY = 1e-9


#: What makes rows equal.
UNIT = ["doc_id", "source", "size", "words"]


def sizes(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size, words (a hash of the text) and a number of each row, with `more` columns."""
    size = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64(text_or_empty()).alias("words"), F.monotonically_increasing_id().alias("number"), *more)


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row for each source: source, source_size, source_docs, target."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    # From here on a row is a source; one task orders the sources, never documents.
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("place", place).withColumn("weight", weight.cast("double")).withColumn("full", most * F.col("source_size"))
    ordered = everything.orderBy(F.col("full") / F.col("weight"), "place")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = share * F.sum("source_size").over(whole) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # The level is that of the first source, by full / weight, which it does not fill.
    level = ranked.withColumn("level", left / weights_left).withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("full"), F.struct(F.col("full") / F.col("weight"), "place", "level"))).over(whole)["level"])
    return level.select("source", "source_size", "source_docs", F.when(F.col("level").isNull(), F.col("full")).otherwise(F.least(F.col("level") * F.col("weight"), "full")).alias("target"))


def flight(p: list[float], x: list[float], random: np.random.Generator, landing: bool) -> list[float]:
    """Moves p along the null-space of (x, 1), three documents at a time, until two fractions are left (none after landing)."""
    p, waiting, free = list(p), iter(range(len(p))), []
    draws = iter(random.random(2 * len(p) + 8).tolist())

    def move(direction: list[float]) -> None:
        up = min((1 - p[k]) / u if u > 0 else p[k] / -u for k, u in zip(free, direction, strict=True) if u)
        down = min(p[k] / u if u > 0 else (1 - p[k]) / -u for k, u in zip(free, direction, strict=True) if u)
        step = up if next(draws) * (up + down) < down else -down
        for k, u in zip(free, direction, strict=True):
            p[k] = min(1.0, max(0.0, p[k] + step * u))
            if p[k] < TINY or p[k] > 1 - TINY:
                p[k] = float(round(p[k]))

    while True:
        free[:] = [k for k in free if 0 < p[k] < 1]
        while len(free) < 3 and (k := next(waiting, None)) is not None:
            if 0 < p[k] < 1:
                free.append(k)
        if len(free) < 3:
            break
        a, b, c = (x[k] for k in free)
        move([b - c, c - a, a - b] if not a == b == c else [1.0, -1.0, 0.0])
    while landing and free:
        if len(free) == 2:
            a, b = (x[k] for k in free)
            move([b, -a] if a and b else [1.0, -1.0] if a == b else [1.0 * (a > 0), 1.0 * (b > 0)])
        else:
            move([1.0])
        free[:] = [k for k in free if 0 < p[k] < 1]
    return p


def _settle(units: DataFrame, turn: int, seed: int) -> DataFrame:
    """One flight in each (source, block); p becomes 0 or 1 but for two documents of a block that isn't its source's only one."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(name, "ascending") for name in ("mix_order", "doc_id", "size", "words")])
        name = table["source"][0].as_py()
        key = f"{'-' if name is None else '+' + name}\0{table['block'][0].as_py()}\0{turn}\0{seed}".encode()
        random = np.random.default_rng([zlib.crc32(key), len(key), zlib.adler32(key)])
        p = flight(table["p"].to_pylist(), table["size"].cast(pa.float64()).to_pylist(), random, table["blocks"][0].as_py() == 1)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p))

    ship(units.sparkSession)
    return units.groupBy("source", "block").applyInArrow(run, units.schema)


def _settled(sized: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: int, block: int) -> DataFrame:
    """One row for each unit: UNIT, source_size, target, n (its rows) and all (copies of them together)."""
    plan = targets(sized, weights, share, most).withColumnRenamed("source", "of")
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    grouped = sized.groupBy(*UNIT).agg(F.count("*").alias("n"))
    units = grouped.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # Rounding keeps whole numbers of copies whole.
    total = F.round(F.round(due, 12) * F.col("n"), 9)
    units = (
        units.withColumn("whole", F.floor(total).cast("long"))
        .withColumn("p", total - F.floor(total))
        .withColumn("blocks", F.greatest(F.ceil(F.col("source_docs") / block), F.lit(1)).cast("long"))
        .withColumn("mix_order", F.xxhash64("doc_id", "size", "words", F.lit(seed)))
        .withColumn("block", F.pmod("mix_order", F.col("blocks")))
    )
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    settled, turn, result = None, 0, units.where(~open_)
    rest = units.where(open_)
    while True:
        settled = cut(_settle(rest, turn, seed))
        result = result.unionByName(settled.where(~open_))
        rest = settled.where(open_)
        if rest.isEmpty():
            break
        turn += 1
        # At most two of each block are left; each block of the next round takes about `block` of them.
        rest = rest.withColumn("blocks", F.ceil(F.col("blocks") * 2 / block).cast("long")).withColumn("mix_order", F.xxhash64("mix_order", F.lit(turn))).withColumn("block", F.pmod("mix_order", F.col("blocks")))
    return result.select(*UNIT, "source_size", "target", "n", (F.col("whole") + F.col("p").cast("long")).alias("all"))


def _shared(sized: DataFrame, settled: DataFrame) -> DataFrame:
    """The rows of `sized` with source_size, target and copies: equal rows have equal numbers of them, or some have one more."""
    same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in UNIT]
    met = sized.join(settled.withColumnsRenamed({name: f"_{name}" for name in UNIT}), same).drop(*[f"_{name}" for name in UNIT])
    evenly, each = F.col("all") % F.col("n") == 0, F.floor(F.col("all") / F.col("n")).cast("long")
    rest = met.where(~evenly).withColumn("part", F.shiftright("number", 33))
    # A row's place among its equals: those in parts of the table before its own, and those before it in its part.
    before = rest.groupBy(*UNIT, "part").agg(F.count("*").alias("m")).withColumn("ahead", F.coalesce(F.sum("m").over(Window.partitionBy(*UNIT).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(*[F.col(name).alias(f"_{name}") for name in (*UNIT, "part")], "ahead")
    place = F.row_number().over(Window.partitionBy(*UNIT, "part").orderBy("number")) + F.col("ahead")
    placed = rest.join(before, [*same, F.col("part") == F.col("_part")]).withColumn("place", place)
    more = placed.withColumn("copies", each + (F.col("place") <= F.col("all") % F.col("n")).cast("long"))
    columns = [*sized.columns, "source_size", "target", "copies"]
    return met.where(evenly).withColumn("copies", each).select(*columns).unionByName(more.select(*columns))


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, copies."""
    sized = cut(sizes(docs))
    return _shared(sized, _settled(sized, weights, share, most, seed, block)).select("doc_id", "source", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """`docs` with each row as often as the mix takes it. Rows are written once, numbered, and meet their copies by number."""
    rows = cut(sizes(packed_row(docs, "doc_id", "source", "text"), "row"))
    sized = rows.drop("row")
    taken = _shared(sized, _settled(sized, weights, share, most, seed, block)).where("copies > 0").select("number", "copies")
    return rows.join(taken, "number").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
