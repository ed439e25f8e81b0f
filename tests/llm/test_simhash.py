import random
import re

import numpy as np
import xxhash
from fixtures import SCHEMA, extra, ordered, rows, table

from loomtrace.llm import graph, queries, simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(ids_and_fingerprints):
    """Components by comparing all pairs."""
    nodes = sorted({f for _, f in ids_and_fingerprints})
    root = {f: f for f in nodes}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    values = np.array(nodes, np.uint64)
    for f in nodes:
        for k in np.flatnonzero(np.bitwise_count(values ^ np.uint64(f)) <= 2):
            root[find(f)] = find(nodes[k])
    least = {}
    for d, f in ids_and_fingerprints:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return sorted(((d, f"{f:016x}", least.get(find(f))) for d, f in ids_and_fingerprints), key=repr)


def near_copies(count=150):
    draw = random.Random(11)
    words = ["w%d" % k for k in range(400)]
    made = []
    for n in range(count):
        if n % 5 == 0:
            base = [draw.choice(words) for _ in range(300)]
        copy = list(base)
        for _ in range(n % 3):
            copy[draw.randrange(300)] = draw.choice(words)
        made.append((1000 + n, " ".join(copy), "en", "a", 1))
    return made


def test_query(spark, tmp_path):
    made = rows() + near_copies()
    table(spark, made).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_groups([(m[0], brute_fingerprint(m[1])) for m in made])
    assert ordered(queries.op6_simhash(spark, str(tmp_path)), "doc_id", "fingerprint", "component_id") == want


def planted(count=3000, seed=5):
    """Fingerprints around a few centres, so that many link, at every distance from the code."""
    draw = random.Random(seed)
    centres = [draw.getrandbits(64) for _ in range(40)] + [0]
    made = set()
    for _ in range(count):
        f = draw.choice(centres)
        for _ in range(draw.randrange(6)):
            f ^= 1 << draw.randrange(64)
        made.add(f)
    return sorted(made)


def components_of(spark, values, parts=5):
    distinct = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fingerprint long").repartition(parts)
    found = graph.components(simhash.links(distinct)).collect()
    by = {}
    for r in found:
        by.setdefault(r.root, set()).add(r.node)
    return sorted(sorted(int(np.int64(n).view(np.uint64)) for n in s) for s in by.values())


def brute_components(values):
    by = {}
    for f, digits, c in brute_groups(list(enumerate(values))):
        by.setdefault(c, []).append(int(digits, 16))
    return sorted(sorted(s) for s in by.values() if len(s) > 1)


def test_no_link_is_missed(spark):
    values = planted()
    assert components_of(spark, values) == brute_components(values)


def test_tiles_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 3)
    values = planted(700, 6)
    assert components_of(spark, values) == brute_components(values)


def test_the_code_covers():
    parts, table_, counts, least = simhash.code()
    assert least.max() == 3 and np.bincount(least).tolist() == [1, 23, 253, 1771]
    draw = np.random.default_rng(1)
    values = draw.integers(0, 2**64, 2000, dtype=np.uint64)
    index, anchors = simhash.visits(values)
    assert (index[:2000] == np.arange(2000)).all()
    words = (values[index] & np.uint64((1 << 23) - 1)).astype(int) << 23 | (values[index] >> np.uint64(23) & np.uint64((1 << 23) - 1)).astype(int)
    distance = np.bitwise_count(words ^ anchors)
    assert distance[:2000].max() <= 6 and (distance <= distance[:2000][index] + 2).all()
    assert len(set(zip(index.tolist(), anchors.tolist(), strict=True))) == len(index)


def test_a_path_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (502, 501), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in graph.components(edges).collect()}
    assert found == {**{k: 0 for k in range(201)}, 500: 500, 501: 500, 502: 500}


def test_one_document_of_each_group_stays(spark):
    made = [r for r in rows() if r[0] is not None] + near_copies(40)
    docs = extra(spark, made)
    want = {d for d, _, c in brute_groups([(m[0], brute_fingerprint(m[1])) for m in made]) if d == c}
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    assert simhash.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
