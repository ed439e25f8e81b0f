import math
import random

import numpy as np
import pytest
from fixtures import ordered

from loomtrace.llm import balltree, queries

NAMES = ("query_id", "rank", "vec_id", "score")


def plainly(vectors, k=10, every=100, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for at, (i, q) in enumerate(kept):
        if i is None or i % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j is None, j or 0, n) for n, (j, v) in enumerate(kept) if n != at)
        found += [(i, rank, None if null else j, -score) for rank, (score, null, j, _) in enumerate(scores[:k], 1)]
    return sorted(found, key=repr)


def made(seed=1, count=700, width=12):
    draw = random.Random(seed)
    middles = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    vectors = [(k, [c + draw.gauss(0, 0.3) for c in draw.choice(middles)]) for k in range(count)]
    vectors += [(2000 + k, vectors[100][1]) for k in range(300)]  # a third are copies of one query's vector
    vectors += [(100, vectors[100][1]), (100, vectors[101][1]), (100, vectors[100][1]), (None, vectors[200][1]), (None, [9.0] * width), (-300, [-x for x in vectors[3][1]])]
    vectors += [(5000, []), (5001, []), (5100, [1.5] * 3), (5101, [1.5] * 20), (5200, [0.0] * width)]
    return vectors + [(6000, None), (6100, [1.0, None]), (6200, [float("nan")] * width), (6300, [float("inf")] * width)]


def written(spark, path, vectors, kind="float"):
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr("vec_id", f"cast(embedding AS array<{kind}>) AS embedding", "1 AS label", "'q' AS query", "'s' AS score", "2 AS row").repartition(5).write.parquet(f"{path}/embeddings.parquet")
    return [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]


def test_query(spark, tmp_path):
    vectors = written(spark, tmp_path, made())
    found = queries.op11_topk(spark, str(tmp_path))
    assert ordered(found, *NAMES) == plainly(vectors)
    assert [t for _, t in found.select(*NAMES).dtypes] == ["bigint", "int", "bigint", "bigint"]


@pytest.mark.parametrize(("shard", "block"), [(60, 3), (200, 1), (5000, 100)])
def test_shards_and_blocks_of_any_size(spark, tmp_path, shard, block, monkeypatch):
    monkeypatch.setattr(balltree, "LEAF", 8)
    vectors = written(spark, tmp_path, made(2, 400))
    stored = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    assert ordered(balltree.top_k(stored, 5, 20, 16, shard, block), *NAMES) == plainly(vectors, 5, 20, 16)


@pytest.mark.parametrize("vectors", [[], [(100, None)], [(100, [1.0])], [(100, [1.0, 2.0]), (200, [3.0, 1.0]), (7, [1.0, 1.0])], [(1, [1.0]), (2, [2.0])], [(0, []), (100, [])]])
def test_few_vectors_or_none(spark, tmp_path, vectors):
    there = written(spark, tmp_path, vectors)
    assert ordered(queries.op11_topk(spark, str(tmp_path)), *NAMES) == plainly(there)


def test_scores_beyond_doubles(spark, tmp_path):
    draw = random.Random(3)
    vectors = [(k, [draw.uniform(-1e5, 1e5) for _ in range(8)]) for k in range(150)] + [(k, [1e6 + (k % 3) * 0.0625] * 4) for k in range(150, 210)]
    there = written(spark, tmp_path, vectors, "double")
    assert ordered(queries.op11_topk(spark, str(tmp_path)), *NAMES) == plainly(there)
    written(spark, f"{tmp_path}/far", [(0, [3e38] * 4), (1, [3e38] * 4)])
    with pytest.raises(Exception, match="64 bits"):
        queries.op11_topk(spark, f"{tmp_path}/far").collect()


def test_nodes_that_can_hold_nothing_are_left_out():
    draw = np.random.default_rng(5)
    middles = draw.normal(0, 5000, (20, 8))
    v = np.floor(middles[draw.integers(0, 20, 4000)] + draw.normal(0, 100, (4000, 8)))
    tree = balltree.Tree.built(np.arange(4000), v)
    assert balltree.Tree.read(tree.parts()).v.tolist() == tree.v.tolist() and sorted(tree.ids.tolist()) == list(range(4000))
    for node, (start, end) in enumerate(tree.spans):
        if start >= 0:
            assert (balltree.norms(tree.v[start:end] - tree.centres[node]) <= tree.radii[node] + 1e-6).all()
    q, seen = v[:50], []
    tree.ids.flags.writeable = False
    real, balltree.products = balltree.products, lambda a, b: seen.append(len(a) * len(b)) or real(a, b)
    try:
        best = balltree.search(tree, q, np.full(50, -np.inf), 5)
        first = sum(seen)
        again = balltree.search(tree, q, best.kth, 5)
    finally:
        balltree.products = real
    exact = (q @ v.T).astype(np.int64)
    want = [(r, int(exact[r, i]), int(i)) for r in range(50) for i in np.lexsort((np.arange(4000), -exact[r]))[:5]]
    assert sorted(zip(best.query.tolist(), best.score.tolist(), best.ids.tolist(), strict=True)) == sorted(want)
    assert sorted(again.score.tolist()) == sorted(best.score.tolist())
    assert sum(seen) - first <= first < 50 * 4000 / 3
