"""The pipeline on small rows, each stage against brute force on what the stage before kept."""

import random
import re
from collections import defaultdict

import corpus_pipeline
import pytest
import xxhash
from fixtures import SCHEMA, rows, table
from pyspark.sql import functions as F

from loomtrace.llm import bpe

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(seed, words):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 9))) for _ in range(words))


def corpus():
    """Clean prose with copies, copies in capitals, near copies, junk and short texts, and the odd rows of all tests."""
    made = [(1000 + k, prose(k, 120), "en", f"s{k % 3}", 1) for k in range(240)]
    made += [(2000 + k, prose(k, 120), "en", "s0", 1) for k in range(12)] + [(2100 + k, prose(k, 120).upper(), "en", "s1", 1) for k in range(12)]
    made += [(2200 + k, prose(k, 120) + " tail", "en", "s2", 1) for k in range(12)]
    made += [(3000 + k, "spam " * 80, "en", "s0", 1) for k in range(5)] + [(3100 + k, prose(k, 9), "en", "s0", 1) for k in range(5)] + [(3200, "### %%% " * 40 + prose(7, 60), "en", "s0", 1)]
    return made + rows(count=20)


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.fixture(scope="module")
def stages(spark):
    docs, found = table(spark, corpus()), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, None).cache()
        found.append(docs)
    yield found
    for docs in found:
        docs.unpersist()


def test_columns_and_names(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    assert all(docs.columns == COLUMNS for docs in stages[:-1]) and stages[-1].columns == [*COLUMNS, "ids"]


def test_quality_keeps_clean_texts_and_rejects_junk(stages):
    kept = {r.doc_id for r in stages[0].collect()}
    assert not kept & {*range(3000, 3005), *range(3100, 3105), 3200, 100, 101, 102}
    assert {*range(1000, 1240), *range(2000, 2012), *range(2200, 2212)} <= kept


def test_exact_dedup(stages):
    groups = defaultdict(list)
    for r in stages[0].collect():
        groups[re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")].append(r.doc_id)
    want = sorted(max(ids, key=lambda i: (i is not None, i or 0)) for ids in groups.values())
    assert sorted(r.doc_id for r in stages[1].collect()) == want


def test_near_dedup(stages):
    given = stages[1].collect()
    prints = {r.doc_id: fingerprint(r.text) for r in given}
    left, roots = sorted(prints), set()
    while left:
        reached, todo = {left[0]}, [left[0]]
        while todo:
            a = todo.pop()
            new = {b for b in left if b not in reached and (prints[a] ^ prints[b]).bit_count() <= 2}
            reached |= new
            todo += new
        roots.add(min(reached))
        left = [d for d in left if d not in reached]
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(roots)


def test_mix(stages):
    sizes, taken, most = defaultdict(int), defaultdict(int), 0
    for r in stages[2].collect():
        sizes[r.source] += len((r.text or "").split())
        most = max(most, len((r.text or "").split()))
    for r in stages[3].collect():
        taken[r.source] += len((r.text or "").split())
    # Sources by code point, null last, weigh 3, 1, 2; targets stop at twice a source's size.
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        rest = total - sum(target.values())
        full = {s for s in free if rest * weights[s] / sum(weights[x] for x in free) > 2 * sizes[s]}
        if not full:
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        free -= full
    target |= {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
    assert all(abs(taken[s] - target[s]) <= most for s in names)


def test_tokens_decode_to_the_text(stages):
    got = sorted((r.doc_id, bytes(r.decoded)) for r in bpe.decode(stages[4]).collect())
    assert got == sorted((r.doc_id, (r.text or "").encode()) for r in stages[3].collect())


def test_a_text_that_does_not_come_back_stops_the_run(spark, monkeypatch):
    docs, stage, encode = table(spark, rows(count=20)), corpus_pipeline.STAGES[-1][1], bpe.encode
    assert stage(spark, docs, None).count() == docs.count() and len(stage(spark, docs, None).collect()) == docs.count()
    monkeypatch.setattr(bpe, "encode", lambda docs, **more: encode(docs, **more).withColumns({name: F.lit(b"other") for name in more.values()}))
    with pytest.raises(Exception, match="decode to their text"):
        stage(spark, docs, None).collect()


def test_run_and_an_empty_table(spark, tmp_path):
    table(spark, corpus()).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() > 200
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
