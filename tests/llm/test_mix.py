import re

import numpy as np
from fixtures import SCHEMA, extra, ordered, rows, table

from loomtrace.llm import mix, queries


def water(sizes, weights, share=1.5, most=2.0):
    """Targets by sharing the excess again and again."""
    due, capped = share * sum(sizes), set()
    while True:
        free = [k for k in range(len(sizes)) if k not in capped]
        left = due - sum(most * sizes[k] for k in capped)
        level = left / sum(weights[k] for k in free) if free else 0
        over = {k for k in free if level * weights[k] > most * sizes[k]}
        if not over:
            return [most * sizes[k] if k in capped else level * weights[k] for k in range(len(sizes))]
        capped |= over


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_query(spark, tmp_path):
    made = rows(count=200)
    table(spark, made).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op2_mix(spark, str(tmp_path)).collect()
    assert sorted((repr(r.doc_id), r["size"]) for r in found) == sorted((repr(m[0]), words(m[1])) for m in made)
    names = sorted({m[3] for m in made}, key=lambda s: (s is None, s or ""))
    sizes = [sum(words(m[1]) for m in made if m[3] == s) for s in names]
    want = dict(zip(sizes, water(sizes, [(3, 1, 2)[k % 3] for k in range(len(names))]), strict=True))
    assert all(abs(r.target - want[r.source_size]) < 1e-6 * max(1, r.target) and r.taken <= 2 * r["size"] for r in found)
    again = queries.op2_mix(spark, str(tmp_path)).repartition(7)
    assert ordered(again, "doc_id", "size", "taken") == sorted(((r.doc_id, r["size"], r.taken) for r in found), key=repr)


def test_totals_are_balanced(spark):
    draw = np.random.default_rng(1)
    made = [(n, " ".join(["w"] * int(draw.integers(1, 60))), "en", "abc"[n % 3], 0) for n in range(3000)]
    taken = mix.copies(table(spark, made), block=64).groupBy("source").agg({"target": "max", "source_size": "max"})
    targets = {r.source: r["max(target)"] for r in taken.collect()}
    for r in mix.copies(table(spark, made), block=64).selectExpr("source", "size * copies as taken").groupBy("source").sum("taken").collect():
        assert abs(r[1] - targets[r.source]) <= 60


def test_flight_keeps_both_totals():
    draw = np.random.default_rng(2)
    x, p = draw.integers(0, 500, 999).astype(float).tolist(), [0.3] * 999
    q = mix.flight(p, x, draw, False)
    assert sum(0 < k < 1 for k in q) <= 2
    assert abs(sum(q) - sum(p)) < 1e-6 and abs(np.dot(q, x) - np.dot(p, x)) < 1e-3
    assert set(mix.flight(p, x, draw, True)) <= {0.0, 1.0}


def test_rows_are_taken(spark):
    made = [(n, "some words here " * (n % 5), "en", "ab"[n % 2], 0) for n in range(100)]
    docs = extra(spark, made)
    copies = {r.doc_id: r.copies for r in mix.copies(docs).collect()}
    got = mix.mixed(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {k: v for k, v in copies.items() if v}
    assert mix.mixed(docs).columns == docs.columns
    assert mix.mixed(spark.createDataFrame([], SCHEMA)).count() == 0
