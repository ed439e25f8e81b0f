"""Centroid clustering: plain Lloyd over integer vectors, exact and the same on every run.

The centroids, as many as the parameter says, go to every task; a task adds up the vectors of each centroid, and its
sums meet those of other tasks in a groupBy, so a round moves a row for each task, centroid and component, and brings
centroids x components numbers to the driver. Centroids that hold most of the vectors cost nothing more.

Vectors that are null, of another length, or hold a null or non-finite component are left out. Ids may be null or repeat:
null ids come last in the choice of the first centroids, equal ids by their vectors; every row is assigned. With fewer
vectors than centroids there are as many centroids as vectors; an empty table has no rows. Components may have any size:
beyond 2^27 in amount a batch is computed in Python's integers; a distance or sum that 64 bits can't hold is an error.
Only the two named columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship

CENTROIDS, ROUNDS, SCALE, WIDTH, SEED = 40, 5, 256, 64, 2
#: Amount up to which squared differences of WIDTH components, and their sum over a batch, stay within 64 bits.
NARROW = 1 << 27


def integers(vectors: DataFrame, scale: int, width: int | None, id_: str, embedding: str) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component, of the vectors that take part. Whole numbers as doubles, which floats never exceed."""
    ship(vectors.sparkSession)
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    there = F.col(embedding).isNotNull() & ~bad
    there = there if width is None else there & (F.size(embedding) == width)
    # rint leaves what is whole; floor alone would give a long, which is too narrow for the largest floats.
    scaled = F.transform(embedding, lambda x: x.cast("double") * F.lit(float(scale)))
    whole = F.transform(scaled, lambda x: F.rint(x) - (F.rint(x) > x).cast("double"))
    return vectors.where(there).select(F.col(id_).alias("vec_id"), whole.alias("v"))


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """The vectors of a batch as integers: 64 bits if they are narrow, else Python's own."""
    found = np.stack(column.to_numpy()) if len(column) else np.empty((0, width))
    if not found.size or np.abs(found).max() <= NARROW:
        return found.astype(np.int64)
    return np.array([[int(x) for x in row] for row in found], object)


def assign(v: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the smaller number of equally near ones, and its squared distance."""
    narrow = v.dtype == np.int64 and all(abs(c) <= NARROW for row in centroids for c in row)
    v = v if narrow else v.astype(object)
    least, nearest = None, np.zeros(len(v), np.int64)
    for number, centroid in enumerate(centroids):
        apart = v - np.array(centroid, np.int64 if narrow else object)
        squares = np.einsum("ij,ij->i", apart, apart) if narrow else (apart * apart).sum(axis=1)
        closer = np.zeros(len(v), bool) if least is None else (squares < least).astype(bool)
        least = squares if least is None else np.where(closer, squares, least)
        nearest[closer] = number
    return nearest, least


def total(distances: np.ndarray) -> int:
    small = distances.dtype == np.int64 and distances.max() < 1 << 40
    return int(distances.sum()) if small else sum(map(int, distances))


def first_centroids(vectors: DataFrame, count: int, seed: int) -> list[list[int]]:
    """The `count` vectors with the least digests of their ids."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = vectors.orderBy(digest.asc_nulls_last(), "v").limit(count).select("v")
    return [[int(x) for x in row.v] for row in chosen.collect()]


def sums(vectors: DataFrame, centroids: list[list[int]]) -> list:
    """Rows (cluster, place, total, n): for each component of a centroid the sum and the number of its vectors; after the last component that of their distances."""
    width = len(centroids[0])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals, distances, counts = [[0] * width for _ in centroids], [0] * len(centroids), [0] * len(centroids)
        for batch in batches:
            v = matrix(batch["v"], width)
            nearest, least = assign(v, centroids)
            for k in np.unique(nearest).tolist():
                own = nearest == k
                totals[k] = [a + int(b) for a, b in zip(totals[k], v[own].sum(axis=0), strict=True)]
                distances[k] += total(least[own])
                counts[k] += int(own.sum())
        rows = [(k, place, Decimal(x), n) for k, n in enumerate(counts) if n for place, x in enumerate([*totals[k], distances[k]])]
        yield pd.DataFrame(rows, columns=["cluster", "place", "total", "n"])

    parts = vectors.select("v").mapInPandas(add, "cluster int, place int, total decimal(38,0), n long")
    return parts.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()


def lloyd(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, seed: int = SEED, id_: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, list[list[int]], list[int]]:
    """vec_id, cluster and distance of every vector that takes part; the centroids; and the sum of distances of each centroid."""
    # Written once: each round reads narrow numbers, whatever the vectors came from.
    kept = cut(integers(vectors, scale, width, id_, embedding))
    placed = first_centroids(kept, centroids, seed)
    if not placed:
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [], []
    for _ in range(rounds):
        for row in sums(kept, placed):
            if row.place < width:
                placed[row.cluster][row.place] = int(row.total) // row.n
    inertia = [0] * len(placed)
    for row in sums(kept, placed):
        if row.place == width:
            inertia[row.cluster] = int(row.total)

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nearest, least = assign(matrix(batch["v"], width), placed)
            if len(least) and max(least) >= 1 << 63:
                raise OverflowError("a squared distance is over 64 bits")
            yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": nearest.astype(np.int32), "distance": least.astype(np.int64)})

    id_type = kept.schema["vec_id"].dataType.simpleString()
    return kept.mapInPandas(last, f"vec_id {id_type}, cluster int, distance long"), placed, inertia


def clusters(vectors: DataFrame, **settings) -> DataFrame:
    """`lloyd` with the sums of its distances and the digest of each final centroid."""
    assigned, placed, inertia = lloyd(vectors, **settings)
    if any(x >= 1 << 63 for x in [*inertia, sum(inertia)]):
        raise OverflowError("a sum of squared distances is over 64 bits")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in placed]

    def told(values, kind):
        # A literal array as long as the centroids are many.
        return F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster"))

    return assigned.select("vec_id", "cluster", "distance", told(inertia, "bigint").alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), told(digests, "string").alias("centroid_sha256"))
