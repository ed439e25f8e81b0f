import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import SCHEMA, rows, table
from hypothesis import given
from hypothesis import strategies as st

from loomtrace.llm import eliasfano, lm, queries


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), ""]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def brute(made):
    one, two = Counter(), Counter()
    for m in made:
        if not held(m[0]):
            t = tokens(m[1])
            one.update(t)
            two.update(zip(["", *t], t, strict=False))
    n, v = sum(one.values()), len(one)
    out = []
    for m in made:
        t = tokens(m[1])
        single = [(one[w] + 0.1) / (n + 0.1 * (v + 1)) for w in t]
        pair = [two[u, w] / (one[u] + lm.PRIOR) + lm.PRIOR / (one[u] + lm.PRIOR) * p for u, w, p in zip(["", *t], t, single, strict=False)]
        out.append((m[0], held(m[0]), len(t), sum(one[w] > 0 for w in t), n, sum(map(math.log10, single)), sum(map(math.log10, pair))))
    return out


@pytest.mark.parametrize("size", [lm.BLOCK, 2000])
def test_scores(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(lm, "BLOCK", size)
    monkeypatch.setattr(lm, "FAN", 50)
    made = rows()
    table(spark, made).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(tuple, queries.op9_lm(spark, str(tmp_path)).collect()), key=repr)
    want = sorted(brute(made), key=repr)
    order = lambda r: (repr(r[0]), *r[1:5], round(r[5], 5))
    for a, b in zip(sorted(found, key=order), sorted(want, key=order), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5])) and abs(a[6] - b[6]) < 0.002 * b[2]


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    draw = np.random.default_rng(3)
    phrases = [["red", "green", "blue"], ["one", "two", "three"], ["a", "b", "c", "d"]]
    made = [(n, " ".join(w for k in draw.integers(0, 3, 60) for w in phrases[k]), "en", "a", 1) for n in range(500)]
    found = [r for r in lm.scores(table(spark, made)).collect() if r.held_out]
    assert found and all(r.score > r.base_score for r in found)


def test_empty_tables(spark):
    assert lm.scores(spark.createDataFrame([], SCHEMA)).count() == 0
    only = [(None, "no training text", "en", "a", 1)]
    assert [tuple(r)[1:] for r in lm.scores(table(spark, only)).collect()] == [(True, 4, 0, 0, 0.0, 0.0)]


@given(st.lists(st.integers(0, 2**40), max_size=300), st.lists(st.integers(0, 2**40), max_size=50))
def test_successors(values, asked):
    values = np.array(sorted(values), np.uint64)
    sequence = eliasfano.Monotone(eliasfano.Monotone.write(values))
    asked = np.array([*asked, *values.tolist()], np.uint64)
    index, equal = sequence.successor(asked)
    assert index.tolist() == np.searchsorted(values, asked).tolist()
    assert equal.tolist() == [a in set(values.tolist()) for a in asked.tolist()]
    assert sequence.at_places(np.arange(len(values))).tolist() == values.tolist()


@given(st.sets(st.tuples(st.integers(0, 9), st.integers(0, 10**6)), max_size=200), st.lists(st.tuples(st.integers(0, 11), st.integers(0, 10**6 + 5)), max_size=50))
def test_trie(pairs, asked):
    pairs = sorted(pairs)
    trie = eliasfano.Trie(eliasfano.Trie.write(np.array([u for u, _ in pairs], np.uint64), np.array([w for _, w in pairs], np.uint64), np.array([1 / (2 + u + w) for u, w in pairs])))
    asked = asked + pairs
    codes = trie.find(np.array([u for u, _ in asked], np.uint64), np.array([w for _, w in asked], np.uint64))
    for (u, w), got in zip(asked, eliasfano.weight(codes), strict=True):
        assert abs(got * (2 + u + w) - 1) < 0.003 if (u, w) in set(pairs) else got == 0
    assert trie.count(np.arange(12, dtype=np.uint64)).tolist() == [sum(u == k for u, _ in pairs) for k in range(12)]
