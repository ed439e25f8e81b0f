"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Parts into which the edges of every node are dealt, so that a node with most edges is not one task.
SALTS = 16


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node it reaches) that connect what the edges (a, b) connect."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least v of each u; every u is dealt into SALTS parts."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(least, ["u", "salt"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    met = _with_least(both).where(F.col("v") > F.col("u"))
    return met.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    met = _with_least(edges)
    return met.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a, b), the root itself included; the root is the least node reached.

    Alternating large and small stars until nothing changes; each round is cut off from the one before.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs, seen = cut(pairs), None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        pairs = cut(_small_star(_large_star(pairs).where("u <> v").distinct()).where("u <> v").distinct(), instead_of=pairs)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select("v", "v").distinct())
