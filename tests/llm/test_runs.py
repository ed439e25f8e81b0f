import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from fixtures import SCHEMA, extra, ordered, rows, table
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtrace.llm import queries, runs


def plainly(words, least=6, power=4):
    """Runs by comparing words p apart, for each p."""
    found = []
    for p in range(1, len(words) // power + 1):
        start = 0
        while start + p < len(words):
            if words[start] != words[start + p]:
                start += 1
                continue
            end = start + p
            while end < len(words) and words[end] == words[end - p]:
                end += 1
            part = words[start:end]
            if end - start >= max(least, power * p) and not any(part[q:] == part[:-q] for q in range(1, p)):
                found.append((start, end - start, p))
            start = end - p + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def told(doc_id, text):
    words = planted(doc_id, text)
    found = plainly(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    gone = {k for s, length, p in found for k in range(s + p, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha(lines), sha(kept))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=6), st.sampled_from([(6, 4), (2, 2), (1, 3)]))
def test_runs_of_several_texts(texts, limits):
    arrays = [np.array(t, np.int64) for t in texts]
    assert [list(map(tuple, r.tolist())) for r in runs.runs_of(arrays, *limits)] == [plainly(t, *limits) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 4), min_size=1, max_size=9), st.integers(1, 9)), min_size=1, max_size=8))
def test_runs_in_runs(blocks):
    text = [w for block, times in blocks for w in block * times]
    assert [tuple(r) for r in runs.runs_of([np.array(text)])[0].tolist()] == plainly(text)


def test_parts_by_definition():
    draw = np.random.default_rng(3)
    for n in (1, 2, 40, 300):
        symbols, _ = runs._joined([draw.integers(0, 3, n), draw.integers(0, 2, n)])
        order = sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())
        ranks = runs.suffix_ranks(symbols)
        assert np.argsort(ranks).tolist() == order and sorted(ranks) == list(range(len(symbols)))
        same = lambda a, b: next((k for k in range(len(symbols)) if b + k >= len(symbols) or a + k >= len(symbols) or symbols[a + k] != symbols[b + k]), 0)
        assert runs.common_prefixes(symbols, ranks).tolist() == [0, *(same(a, b) for a, b in zip(order, order[1:], strict=False))]
        for smaller in (True, False):
            beyond = [next((j for j in range(i + 1, len(ranks)) if (ranks[j] < ranks[i]) == smaller), len(ranks)) for i in range(len(ranks))]
            assert runs.next_beyond(ranks, smaller).tolist() == beyond


def made():
    draw = random.Random(5)
    small = [r for r in rows() if r[1] is None or len(r[1]) < 5000]
    loops = [(200 + k, " ".join(draw.choices("ab c dé".split(), k=draw.randrange(40))), "en", "a", 1) for k in range(120)]
    return small + loops + [(400, "a " * 5000 + "b", "en", "a", 1), (401, "x y\t" * 900 + "x", "en", "a", 1), (402, "q " + "a " * 7 + "b c " * 5 + "d " * 6 + "x y " * 3, "en", "a", 1)]


def test_query(spark, tmp_path):
    table(spark, made()).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted([told(m[0], m[1]) for m in made()], key=repr)
    assert any(w[1] > 2 for w in want)
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert ordered(queries.op13_runs(spark, str(tmp_path)), *names) == want
    assert dict(queries.op13_runs(spark, str(tmp_path)).dtypes)["exponent_milli"] == "bigint"


def test_a_very_long_text_and_clashing_names(spark):
    draw = random.Random(2)
    text = " ".join(["".join(draw.choices("abcdefgh", k=2)) for _ in range(150_000)] + ["end of it"] * 50_000)
    docs = extra(spark, [(1, text, "en", "a", 1), (2, "p q " * 4, None, None, None)]).selectExpr("*", "1 AS runs", "2 AS collapsed")
    found = {r.doc_id: r for r in runs.detect(docs).collect()}
    assert [tuple(r) for r in found[2].runs] == [(0, 8, 2)] and found[2].collapsed == "p q" and found[2].size == "s"
    assert (150_000, 150_000, 3) in [tuple(r) for r in found[1].runs]
    assert found[1].collapsed.endswith("end of it") and len(found[1].collapsed) < len(text)


def test_no_rows_and_no_power(spark):
    assert runs.digests(runs.detect(spark.createDataFrame([], SCHEMA))).count() == 0
    with pytest.raises(ValueError):
        runs.detect(spark.createDataFrame([], SCHEMA), power=1)
