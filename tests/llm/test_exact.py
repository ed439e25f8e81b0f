import hashlib
from collections import defaultdict

from fixtures import SCHEMA, extra, ordered, rows, table
from hypothesis import given
from hypothesis import strategies as st

from loomtrace.llm import exact, queries


def brute(made):
    by = defaultdict(list)
    for m in made:
        by[(m[1] or "").encode().lower()].append(m[0])
    want = []
    for text, ids in by.items():
        keep = max(ids, key=lambda d: (d is not None, d or 0))
        want += [(d, keep, len(ids), d == keep, hashlib.sha256(text).hexdigest()) for d in ids]
    return sorted(want, key=repr)


def test_query(spark, tmp_path):
    table(spark, rows()).write.parquet(f"{tmp_path}/documents.parquet")
    assert ordered(queries.op5_exact(spark, str(tmp_path)), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute(rows())


def test_one_row_of_each_group_stays(spark):
    made = rows()
    kept = exact.dedup(extra(spark, made))
    assert kept.columns == extra(spark, made[:1]).columns
    assert sorted(((r.text or "").encode().lower() for r in kept.collect())) == sorted({(m[1] or "").encode().lower() for m in made})
    assert exact.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    assert exact.groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_spill_changes_nothing(spark):
    made = [(n, ["a" * 2000, f"text {n % 40} " * 50, "B" * 999][n % 3], "en", "a", 1) for n in range(600)]
    owners = exact.owners(table(spark, made, 5), budget=3000)
    assert ordered(owners, "doc_id", "_size", "_sha256") == sorted({(k, n, s) for _, k, n, _, s in brute(made)}, key=repr)


@given(st.lists(st.binary(max_size=12)))
def test_trie_has_each_key_once(keys):
    trie = exact.Patricia()
    for key in keys:
        terminal = trie.terminal(key)
        assert terminal[0] == key
        terminal[1] = (terminal[1] or 0) + 1
    assert sorted((k, n) for k, n in trie.terminals()) == sorted((k, keys.count(k)) for k in set(keys))
