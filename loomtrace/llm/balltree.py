"""Exact top-k search by inner product: branch and bound over ball trees, one for each shard.

Components become whole numbers (floor(scale * x)), so scores are exact. Vectors are dealt to the nearest of some pivots
and, where one has many, to shards of it by row number, so a shard is bounded however often a vector repeats. A shard
holds a ball tree: nodes with centre and radius, halved until leaves are small. The best score that a node can hold for a
query is query x centre + |query| x radius.

A query first goes through one shard of the pivot that suits it best. The kth best score it finds there goes with it to
the other shards: those that can't reach it are left out, all others are joined by shard, queries in blocks. In a shard
the nodes are taken by the best score that they can hold, for all queries of a block that may still find something in
it, and the kth best scores rise while the search goes on. Nothing is approximate: a node is left out only where it can't
hold a score as high as the kth.

Vectors that are null or hold null or non-finite components take no part. Vectors of different lengths meet in the
components that both have; empty vectors score 0. A query leaves out its own row, not others of its id; rows that repeat
are candidates (and queries) of their own. A null id is no query and comes last among equal scores. With fewer candidates
than k all are told; an empty table has no rows. A score that 64 bits can't hold is an error. Only the two named columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_arrow
from .lloyd import integers

K, SCALE, EVERY = 10, 1024, 100
#: Vectors of a shard, of a leaf, and queries of a block, about; pivots at most.
SHARD, LEAF, BLOCK, PIVOTS = 4096, 64, 512, 256
#: Bounds are raised by this part of their size, more than doubles can be off.
SLACK = 1e-9
#: Sums of products up to this are exact in doubles.
EXACT = 2.0**53
FOUND = "query long, score long, vec_id long"


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers given as doubles, exactly."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * width
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
    exact = whole(a) @ whole(b).T
    if max(abs(exact.max()), abs(exact.min())) >= 1 << 63:
        raise OverflowError("an inner product is over 64 bits")
    return exact.astype(np.int64)


def norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", v, v))


def reach(q: np.ndarray, lengths: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The best score that each query can have in each ball, a little raised."""
    around = np.outer(lengths, radii)
    return q @ centres.T + around + SLACK * (np.outer(lengths, norms(centres)) + around) + 1.0


class Tree:
    """A ball tree: centre, radius, children and, for a leaf, the span of its vectors, which lie in the order of the leaves."""

    PARTS = {"ids": "<i8", "v": "<f8", "centres": "<f8", "radii": "<f8", "spans": "<i8", "children": "<i8"}

    def __init__(self, ids: np.ndarray, v: np.ndarray, centres: np.ndarray, radii: np.ndarray, spans: np.ndarray, children: np.ndarray):
        self.ids, self.v, self.centres, self.radii, self.spans, self.children = ids, v, centres, radii, spans, children

    @classmethod
    def built(cls, ids: np.ndarray, v: np.ndarray) -> Tree:
        order, placed, todo = [], 0, [(np.arange(len(v)), -1)]
        centres, radii, spans, children = [], [], [], []
        while todo:
            rows, parent = todo.pop()
            number, own = len(radii), v[rows]
            if parent >= 0:
                children[parent].append(number)
            away = norms(own - (centre := own.mean(axis=0)))
            leaf = len(rows) <= LEAF or away.max() == 0
            centres.append(centre), radii.append(float(away.max())), children.append([])
            spans.append((placed, placed + len(rows)) if leaf else (-1, -1))
            if leaf:
                order.append(rows)
                placed += len(rows)
                continue
            # Halves along the line between a far vector and the one farthest from it.
            far = own[away.argmax()]
            other = own[norms(own - far).argmax()]
            half = np.argpartition(own @ (other - far), len(rows) // 2)
            todo += [(rows[half[len(rows) // 2 :]], number), (rows[half[: len(rows) // 2]], number)]
        order = np.concatenate(order)
        return cls(ids[order], v[order], np.array(centres), np.array(radii), np.array(spans), np.array([c or [-1, -1] for c in children]))

    def parts(self) -> dict[str, bytes]:
        return {name: np.ascontiguousarray(getattr(self, name), kind).tobytes() for name, kind in self.PARTS.items()}

    @classmethod
    def read(cls, parts: dict[str, bytes]) -> Tree:
        found = {name: np.frombuffer(parts[name], kind) for name, kind in cls.PARTS.items()}
        n, nodes = len(found["ids"]), len(found["radii"])
        shapes = {"v": n, "centres": nodes, "spans": nodes, "children": nodes}
        return cls(**{name: a.reshape(shapes[name], a.size // shapes[name]) if name in shapes else a for name, a in found.items()})

    def bounds(self, q: np.ndarray, lengths: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The best score that each node can hold for each query, a little raised."""
        width = min(q.shape[1], self.v.shape[1])
        return reach(q[:, :width], lengths, self.centres[nodes, :width], self.radii[nodes])


class Best:
    """The best (score, id) of each query so far, `count` of them, and the score of the last one (or one that is known to be reached)."""

    def __init__(self, count: int, known: np.ndarray):
        self.count, self.kth = count, known.astype(np.float64)
        self.query, self.score, self.ids = (np.empty(0, np.int64) for _ in range(3))

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the queries `rows` (some of all) with vectors of these ids."""
        # A score can matter only if it isn't below the kth; doubles may round a long up or down, so one unit is left.
        row, at = np.nonzero(scores >= self.kth[rows][:, None] - 1 - np.abs(self.kth[rows][:, None]) * SLACK)
        if not len(row):
            return
        mine = np.isin(self.query, rows)
        query = np.concatenate([self.query[mine], rows[row]])
        score = np.concatenate([self.score[mine], scores[row, at]])
        vec = np.concatenate([self.ids[mine], ids[at]])
        order = np.lexsort((vec, -score, query))
        query, score, vec = query[order], score[order], vec[order]
        first = np.concatenate([[True], query[1:] != query[:-1]])
        place = np.arange(len(query)) - np.maximum.accumulate(np.where(first, np.arange(len(query)), 0))
        keep = place < self.count
        last = place == self.count - 1
        self.kth[query[last]] = np.maximum(self.kth[query[last]], score[last])
        self.query, self.score, self.ids = (np.concatenate([old[~mine], new[keep]]) for old, new in ((self.query, query), (self.score, score), (self.ids, vec)))


def search(tree: Tree, q: np.ndarray, known: np.ndarray, count: int) -> Best:
    """The best `count` vectors of a shard for each query, but for those that can't be among the best of all as the kth score is `known`."""
    best, lengths = Best(count, known), norms(q)
    heap = [(-math.inf, 0, np.arange(len(q)), np.full(len(q), np.inf))]
    while heap:
        _, node, rows, most = heapq.heappop(heap)
        rows = rows[most >= best.kth[rows]]
        if not len(rows):
            continue
        start, end = tree.spans[node]
        if start >= 0:
            best.add(rows, products(q[rows], tree.v[start:end]), tree.ids[start:end])
            continue
        children = tree.children[node]
        reaches = tree.bounds(q[rows], lengths[rows], children)
        for k, child in enumerate(children):
            able = reaches[:, k] >= best.kth[rows]
            if able.any():
                heapq.heappush(heap, (-float(reaches[able, k].max()), child, rows[able], reaches[able, k]))
    return best


#: Stands for a null id, so that it comes last.
NULL_ID = (1 << 63) - 1
#: Queries that ask a shard: their number, their vectors, the score that the kth of each reaches, and the shards where they began.
ASKS = "shard long, n long, queries binary, q binary, known binary, homes binary"


def vectors_in(column: pa.ChunkedArray | pa.Array, width: int = 0) -> np.ndarray:
    """A column of lists as a matrix, short rows filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), max([width, *np.unique(sizes).tolist()])))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def dealt(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """`vectors` with the number of the nearest pivot."""
    at = vectors.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = vectors_in(batch.column(at), pivots.shape[1])
            near = ((pivots**2).sum(axis=1) - 2 * (v[:, : pivots.shape[1]] @ pivots.T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=[*batch.schema.names, "pivot"])

    return map_arrow(vectors, run, T.StructType([*vectors.schema.fields, T.StructField("pivot", T.IntegerType())]))


def shards_of(vectors: DataFrame, shard: int) -> DataFrame:
    """A row for each shard: its number, the ball around it and its tree. A pivot with many vectors has several, by row number."""
    sizes = vectors.groupBy("pivot").agg(F.ceil(F.count("*") / shard).alias("parts"))
    # A row for each pivot: PIVOTS at most.
    parted = vectors.join(F.broadcast(sizes), "pivot").select((F.col("pivot") * F.lit(1 << 40) + F.pmod(F.xxhash64("row"), F.col("parts"))).alias("shard"), "vec_id", "v")

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        tree = Tree.built(rows.column("vec_id").fill_null(NULL_ID).to_numpy(), vectors_in(rows.column("v")))
        row = {"shard": key[0].as_py(), "centre": tree.centres[0].tolist(), "radius": float(tree.radii[0])} | tree.parts()
        return pa.Table.from_pylist([row], schema=pa.schema([("shard", pa.int64()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), *((name, pa.binary()) for name in Tree.PARTS)]))

    return parted.groupBy("shard").applyInArrow(build, "shard long, centre array<double>, radius double, " + ", ".join(f"{name} binary" for name in Tree.PARTS))


def queries_of(vectors: DataFrame, every: int, pivots: np.ndarray) -> DataFrame:
    """query (a number), vec_id and v of different queries, how many rows each is, its score with itself, and the pivot where it begins."""
    same = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id", "v").agg(F.count("*").alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = vectors_in(batch.column(1), pivots.shape[1])
            own = [int(products(row[None], row[None])[0, 0]) for row in v]
            home = (v[:, : pivots.shape[1]] @ pivots.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64()), pa.array(home.astype(np.int32))], names=[*batch.schema.names, "own", "home"])

    told = map_arrow(same, run, T.StructType([*same.schema.fields, T.StructField("own", T.LongType()), T.StructField("home", T.IntegerType())]))
    return told.withColumn("query", F.monotonically_increasing_id())


def blocks(asking: DataFrame, block: int, name: str) -> DataFrame:
    """Queries (query, v, known, home) in blocks of those with the same home where `name` is `shard`, else of any home."""
    asking = asking.select("query", "v", "known", "home")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, homes = vectors_in(batch.column(1)), batch.column(3).to_numpy().astype(np.int64) << 40
            number, known = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            groups = [np.flatnonzero(homes == h) for h in np.unique(homes)] if name == "shard" else [np.arange(len(v))]
            parts = [rows[k : k + block] for rows in groups for k in range(0, len(rows), block)]
            yield asked([(int((homes if name == "shard" else number)[rows[0]]), rows) for rows in parts], number, v, known, homes)

    return map_arrow(asking, run, ASKS).withColumnRenamed("shard", name)


def asked(parts: list[tuple[int, np.ndarray]], number: np.ndarray, v: np.ndarray, known: np.ndarray, homes: np.ndarray) -> pa.RecordBatch:
    columns = {"shard": [s for s, _ in parts], "n": [len(rows) for _, rows in parts]}
    columns |= {name: [np.ascontiguousarray(a[rows], kind).tobytes() for _, rows in parts] for name, a, kind in (("queries", number, "<i8"), ("q", v, "<f8"), ("known", known, "<f8"), ("homes", homes, "<i8"))}
    kinds = {name: pa.int64() if name in ("shard", "n") else pa.binary() for name in columns}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kind) for c, kind in kinds.items()], names=list(kinds))


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    number, q, known, homes = (np.frombuffer(row[name], kind) for name, kind in (("queries", "<i8"), ("q", "<f8"), ("known", "<f8"), ("homes", "<i8")))
    return number, q.reshape(row["n"], q.size // row["n"]), known, homes


def each(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def answers(asks: DataFrame, shards: DataFrame, count: int) -> DataFrame:
    """query, score and vec_id of what each shard has for the queries that ask it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in each(batch):
                number, q, known, _ = opened(row)
                best = search(Tree.read(row), q, known, count)
                yield pa.RecordBatch.from_arrays([pa.array(number[best.query]), pa.array(best.score), pa.array(best.ids)], names=["query", "score", "vec_id"])

    return map_arrow(asks.join(shards.drop("centre", "radius"), "shard"), run, FOUND)


def able(asking: DataFrame, shards: DataFrame, block: int, n_queries: int) -> DataFrame:
    """Which queries have to ask which shards but those where they began, in blocks: those that a shard's ball may hold something for.

    Balls are gathered in slots, and both slots and blocks of queries spread, so that a task meets a bounded number of each.
    """
    slots = -(-shards.count() // 1024)
    spread = -(-n_queries // (64 * block))
    balls = shards.select("shard", "centre", "radius").groupBy(F.pmod(F.xxhash64("shard"), F.lit(slots)).cast("int").alias("slot")).agg(F.collect_list(F.struct("shard", "centre", "radius")).alias("balls"))
    balls = balls.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    many = blocks(asking, block, "first").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    met = many.withColumn("salt", F.pmod(F.xxhash64("first"), F.lit(spread)).cast("int")).join(balls, ["slot", "salt"]).select("n", "queries", "q", "known", "homes", "balls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in each(batch):
                (number, q, known, homes), balls = opened(row), row["balls"]
                centres = vectors_in(pa.array([b["centre"] for b in balls], pa.list_(pa.float64())), q.shape[1])
                most = reach(q, norms(q), centres[:, : q.shape[1]], np.array([b["radius"] for b in balls]))
                for k, ball in enumerate(balls):
                    rows = np.flatnonzero((most[:, k] >= known) & (homes != ball["shard"]))
                    if len(rows):
                        yield asked([(ball["shard"], rows)], number, q, known, homes)

    return map_arrow(met, run, ASKS)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, shard: int = SHARD, block: int = BLOCK, id_: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best vectors for every vector whose id is divisible by `every`."""
    # Row numbers are written, so a task that runs again deals its rows as before.
    base = cut(integers(vectors, scale, None, id_, embedding).select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.monotonically_increasing_id().alias("row")))
    # A sample of bounded size tells only where vectors lie; every vector is in a shard.
    sample = base.orderBy(F.xxhash64("row"), "row").limit(max(1, min(PIVOTS, -(-base.count() // shard)))).select("v").toArrow()
    pivots = vectors_in(sample.column("v"))
    if not len(pivots):
        return base.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("vec_id").alias("score"))
    asking = cut(queries_of(base, every, pivots))
    shards = cut(shards_of(dealt(base, pivots), shard))
    # The own row may be among the best, so one more is kept until it is left out.
    count, none = k + 1, F.lit(float("-inf"))
    began = cut(answers(blocks(asking.withColumn("known", none), block, "shard"), shards, count))
    known = began.groupBy("query").agg(F.when(F.count("*") >= count, F.min("score").cast("double")).alias("known"))
    knowing = asking.join(known, "query", "left").withColumn("known", F.coalesce("known", none))
    found = began.unionByName(answers(able(knowing, shards, block, asking.count()), shards, count))
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= count)
    told = ranked.join(asking.select("query", F.col("vec_id").alias("query_id"), "own", "rows"), "query")
    # Rows of the query's id and of its score with itself are alike here, whichever of them is its own.
    mine = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("place"))).over(Window.partitionBy("query"))
    others = told.withColumn("mine", mine).where(~F.col("place").eqNullSafe(F.col("mine"))).withColumn("rank", F.col("place") - F.coalesce(F.col("place") > F.col("mine"), F.lit(False)).cast("int")).where(F.col("rank") <= k)
    each_row = others.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each_row.select("query_id", F.col("rank").cast("int").alias("rank"), F.nullif("vec_id", F.lit(NULL_ID)).alias("vec_id"), "score")
