import hashlib
import math
import random

import pytest
from fixtures import ordered

from loomtrace.llm import lloyd, queries

NAMES = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def plainly(vectors, count=40, rounds=5):
    """Rows of the query for (vec_id, vector), in Python's integers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    placed = [list(v) for _, v in sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else digest(r[0]), r[1]))[:count]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((apart(v, c), k) for k, c in enumerate(placed))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(nearest(v)[1], []).append(v)
        for k, members in own.items():
            placed[k] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    last = [(i, *nearest(v)) for i, v in kept]
    sums = {k: sum(d for _, d, c in last if c == k) for k in range(len(placed))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in placed]
    return sorted([(i, k, d, sums[k], sum(sums.values()), sha[k]) for i, d, k in last], key=repr)


def made(seed=1, count=300):
    draw = random.Random(seed)
    vectors = [(k, [draw.choice([-1, 1]) * round(draw.random() * 3, 2) for _ in range(64)]) for k in range(count)]
    vectors += [(1000 + k, vectors[0][1]) for k in range(150)] + [(1000, vectors[5][1]), (None, vectors[7][1]), (None, vectors[8][1]), (-3, [0.0] * 64), (-4, [-0.001] * 64)]
    return vectors + [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 63 + [None]), (2004, [float("nan")] + [1.0] * 63), (2005, [float("-inf")] + [1.0] * 63), (2006, [1.0] * 65)]


def written(spark, path, vectors, kind="float"):
    spark.createDataFrame(vectors, f"vec_id long, embedding array<double>").selectExpr("vec_id", f"cast(embedding AS array<{kind}>) AS embedding", "1 AS label", "'c' AS cluster", "'v' AS v").repartition(5).write.parquet(f"{path}/embeddings.parquet")  # noqa: F541
    return [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]


def test_query(spark, tmp_path):
    vectors = written(spark, tmp_path, made())
    found = queries.op12_lloyd(spark, str(tmp_path))
    assert ordered(found, *NAMES) == plainly(vectors)
    assert [t for _, t in found.select(*NAMES).dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]


@pytest.mark.parametrize("vectors", [made()[:3], made()[-7:], []])
def test_few_vectors_or_none(spark, tmp_path, vectors):
    there = written(spark, tmp_path, vectors)
    assert ordered(queries.op12_lloyd(spark, str(tmp_path)), *NAMES) == plainly(there)


def test_wide_components(spark, tmp_path):
    draw = random.Random(4)
    vectors = [(k, [draw.uniform(-6e5, 6e5) if k < 4 else draw.random() for _ in range(64)]) for k in range(90)]
    there = written(spark, tmp_path, vectors)
    assert ordered(queries.op12_lloyd(spark, str(tmp_path)), *NAMES) == plainly(there)
    written(spark, f"{tmp_path}/far", [(1, [1e30] * 64), (2, [-1e30] * 64)])
    one = lloyd.clusters(spark.read.parquet(f"{tmp_path}/far/embeddings.parquet"), rounds=0)
    assert [r.distance for r in one.collect()] == [0, 0]


def test_settings(spark):
    vectors = spark.createDataFrame([(k, [float(k % 2), float(k)]) for k in range(10)], "id string, e array<double>")
    assigned, placed, inertia = lloyd.lloyd(vectors, 2, 8, 1, 2, 0, "id", "e")
    assert assigned.count() == 10 and len(placed) == 2 and sum(inertia) == sum(r.distance for r in assigned.collect())
    by = {r.vec_id: r.cluster for r in assigned.collect()}
    assert by["0"] == by["3"] != by["9"]
