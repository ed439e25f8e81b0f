import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from fixtures import SCHEMA, extra, ordered, rows, table

from loomtrace.llm import suffix

NAMES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(given):
    texts = [(r[1] or "").encode() for r in given]
    seen = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    out = []
    for row, text in zip(given, texts, strict=True):
        gone = np.zeros(len(text), bool)
        for k in range(len(text) - 199):
            if seen[text[k : k + 200]] > 1:
                gone[k : k + 200] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        left = bytes(np.frombuffer(text, np.uint8)[~gone])
        out.append((row[0], len(text), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def passages(seed=3):
    """Texts that share passages of 150 to 400 bytes, near copies, periods and edges of 199 and 200 bytes."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghié") for _ in range(draw.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60)[:n] for n in (150, 199, 200, 201, 260, 400)]
    made = []
    for _ in range(40):
        made.append(prose(draw.randint(0, 80)) + draw.choice(shared) + prose(draw.randint(0, 80)) + draw.choice(["", draw.choice(shared)]))
    base = prose(120)
    for _ in range(40):  # near copies
        at = draw.randrange(len(base))
        made.append(base[:at] + draw.choice("XYZ") + base[at + 1 :])
    made += ["ab" * 400, "x" * 199, "x" * 199, "x" * 200, "x" * 5000, "q" * 200, "w" * 201, ("0123456789" * 7 + "-") * 20, "\x00" * 300]
    return [(k, t, "en", "a", len(t)) for k, t in enumerate(made)]


@pytest.mark.parametrize("hot", [2000, 3])
def test_against_every_window(spark, hot):
    given = passages()
    assert ordered(suffix.digests(table(spark, given), hot=hot), *NAMES) == brute(given)


def test_odd_rows_and_extra_columns(spark):
    given = [r for r in rows() if len(r[1] or "") < 3000]
    assert ordered(suffix.digests(table(spark, given)), *NAMES) == brute(given)
    assert ordered(suffix.digests(extra(spark, given)), *NAMES) == brute(given)
    assert suffix.digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_kept_bytes(spark):
    given = passages(5)
    found = {r.doc_id: hashlib.sha256(bytes(r.kept)).hexdigest() for r in suffix.kept(table(spark, given)).collect()}
    assert found == {r[0]: r[4] for r in brute(given)}


def test_parts_of_a_hot_gram():
    """A block whose grams are all hot gives the same windows, each once, in more strings."""
    whole = "".join(r[1] for r in passages()).encode()
    buffer, size = np.frombuffer(whole, np.uint8), len(whole)
    starts, counts, places, grams = suffix.block_runs(buffer, [size])
    row = {"doc_ids": suffix._zip(np.zeros(1, "<i8")), "present": suffix._zip(np.ones(1, "u1")), "sizes": suffix._zip(np.array([size], "<u4")), "text": suffix._zip(whole), "starts": suffix._zip(np.diff(starts, prepend=np.uint32(0))), "counts": suffix._zip(counts), "places": suffix._zip(places), "grams": grams.tobytes()}
    distinct = np.unique(grams)
    windows = []
    for kind in (1, 2):
        answers = pa.table({"shard": [k for k, _ in suffix._by_shard(suffix._dealt(distinct, np.zeros(1), 5), 5)], "kinds": [suffix._zip(np.full(len(at), kind, "u1")) for _, at in suffix._by_shard(suffix._dealt(distinct, np.zeros(1), 5), 5)]})
        block = suffix.Block(row, answers, 5)
        windows.append(sorted(w for a, n in zip(block.starts.tolist(), block.counts.tolist(), strict=True) for w in range(a, a + n)))
        for a, p in zip(block.starts.tolist(), block.places.tolist(), strict=True):
            assert 0 <= p < suffix.PLACES and a + p + suffix.GRAM <= size
    assert windows[0] == windows[1] == list(range(size - 199))


def test_columns_against_brute_force():
    draw = random.Random(1)
    base = bytes(draw.choice(b"abc") for _ in range(336))
    strings, places = set(), {}
    while len(strings) < 60:
        text = bytearray(base)
        for _ in range(draw.randint(0, 3)):
            text[draw.randrange(336)] = draw.choice(b"xyz")
        a = draw.randint(0, 100)
        cut = bytes(text[a : draw.randint(a + 200, 336)])
        strings.add(cut)
        places[cut] = suffix.PLACES - 1 - a
    strings = sorted(strings)
    spot = np.array([places[s] for s in strings])
    found = suffix.compare(strings, spot, np.zeros(len(strings), np.uint64), batch=10)
    seen = Counter((s[k : k + 200], p - k) for s, p in zip(strings, spot.tolist(), strict=True) for k in range(len(s) - 199))
    for s, p, got in zip(strings, spot.tolist(), found, strict=True):
        assert got.tolist() == [seen[s[k : k + 200], p - k] > 1 for k in range(len(s) - 199)]
