"""Exact dedup: owners of equal texts, found in compressed radix (Patricia) tries.

Texts are equal when identical after lower-casing A-Z; a null text counts as
empty. Of equal texts the row with the largest doc_id stays (a null doc_id is
the smallest; of repeated doc_ids the row with the largest text, bytewise,
stays, and of fully repeated rows one).

Each input task first inserts its texts into a trie of its own and sends on one
row for each distinct text, so a text that fills a third of the table arrives
at its owner once for each task. Owners are dealt by length and content hash;
full byte strings decide, never hashes. An owner's rows come sorted by length
and hash (Spark's external sort spills them), so at each boundary between two
keys the subtrees before it are complete: once `BUDGET` bytes are resident they
are given out and dropped. A key that fills the budget alone is compacted to
its terminal rows.

`groups` tells each row its owner by the digest of its text: a text that a third
of the rows have is then one row on the owners' side, and its members are never
together in one task, as they would be in its terminal.

Very long texts are keys like others; an empty table gives no rows; columns of
the input keep their names and values whatever they are called.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow

#: Bytes of input that a task holds before it gives out its complete subtrees.
BUDGET = 32 << 20


def first_difference(a: bytes, b: bytes) -> int:
    """The first index at which a and b differ, at most the shorter length."""
    low, step, most = 0, 64, min(len(a), len(b))
    while low < most and a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    if low >= most:
        return most
    high = min(low + step, most)
    while low < high:
        middle = (low + high) // 2
        if a[low : middle + 1] == b[low : middle + 1]:
            low = middle + 1
        else:
            high = middle
    return low


class Patricia:
    """Byte strings to terminals. An inner node is (index, {byte or -1 at the end: child}); paths are compressed."""

    def __init__(self):
        self.root = None

    def terminal(self, key: bytes) -> list:
        """The terminal [key, payload] of `key`, with payload None if it is new."""
        if self.root is None:
            self.root = [key, None]
            return self.root
        node = self.root
        while isinstance(node, tuple):
            index, children = node
            node = children.get(key[index] if index < len(key) else -1) or next(iter(children.values()))
        if node[0] == key:
            return node
        place = first_difference(key, node[0])
        leaf, own = [key, None], key[place] if place < len(key) else -1
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < place:
            parent, node = node, node[1][key[node[0]]]
        if isinstance(node, tuple) and node[0] == place:
            node[1][own] = leaf
            return leaf
        sample = node
        while isinstance(sample, tuple):
            sample = next(iter(sample[1].values()))
        other = sample[0][place] if place < len(sample[0]) else -1
        branch = (place, {other: node, own: leaf})
        if parent is None:
            self.root = branch
        else:
            parent[1][key[parent[0]]] = branch
        return leaf

    def terminals(self):
        """All terminals, one subtree after another."""
        stack = [] if self.root is None else [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += node[1].values()
            else:
                yield node


def normalised(column: pa.Array) -> list[bytes]:
    return [(text or b"").lower() for text in column.cast(pa.binary()).to_pylist()]


def _winners(batches, at: dict[str, int], names: list[str], sorted_keys: bool, budget: int):
    """One row for each distinct text of what has been read, with the number of rows it stands for."""
    trie, held, resident, last = Patricia(), [], 0, None

    def give():
        rows: dict[int, list] = {}
        for key, payload in trie.terminals():
            rows.setdefault(payload[1], []).append((payload[2], payload[3], key))
        for number, found in sorted(rows.items()):
            taken = held[number].take(pa.array([row for row, _, _ in found]))
            yield _with_keys(taken, names, [size for _, size, _ in found], [key for _, _, key in found])

    for batch in batches:
        keys, ids = normalised(batch.column(at["text"])), batch.column(at["doc_id"]).to_pylist()
        raw = batch.column(at["text"]).cast(pa.binary()).to_pylist()
        sizes = batch.column(at["_size"]).to_pylist() if sorted_keys else [1] * batch.num_rows
        marks = list(zip(batch.column(at["_length"]).to_pylist(), batch.column(at["_hash"]).to_pylist(), strict=True)) if sorted_keys else None
        held.append(batch)
        for row, key in enumerate(keys):
            if sorted_keys and marks[row] != last:
                if resident > budget:
                    yield from give()
                    trie, held, resident = Patricia(), [batch], 0
                last = marks[row]
            resident += len(key) + 64
            rank = (ids[row] is not None, ids[row] or 0, raw[row] or b"")
            terminal = trie.terminal(key)
            if terminal[1] is None:
                terminal[1] = [rank, len(held) - 1, row, sizes[row]]
            else:
                terminal[1][3] += sizes[row]
                if rank > terminal[1][0]:
                    terminal[1][:3] = [rank, len(held) - 1, row]
        if not sorted_keys and resident > budget:
            yield from give()
            trie, held, resident = Patricia(), [], 0
        elif sorted_keys and resident > 2 * budget:
            held, resident = _compacted(trie, held), sum(len(t[0]) + 64 for t in trie.terminals())
    yield from give()


def _compacted(trie: Patricia, held: list) -> list:
    """Only the rows that terminals point to; payloads are renumbered."""
    kept = []
    for _, payload in trie.terminals():
        kept.append(held[payload[1]].take(pa.array([payload[2]])))
        payload[1:3] = [len(kept) - 1, 0]
    return kept


def _with_keys(taken: pa.RecordBatch, names: list[str], sizes: list[int], keys: list[bytes]) -> pa.RecordBatch:
    added = {
        "_size": pa.array(sizes, pa.int64()),
        "_length": pa.array([len(key) for key in keys], pa.int64()),
        "_hash": pa.array([xxhash.xxh64_intdigest(key) - (1 << 63) for key in keys], pa.int64()),
        "_sha256": pa.array([hashlib.sha256(key).hexdigest() for key in keys], pa.string()),
    }
    return pa.RecordBatch.from_arrays([taken.column(i) for i in range(len(names))] + list(added.values()), names=[*names, *added])


def owners(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The rows of `docs` that stay: doc_id, text, rest (their other columns, as one struct, so that no name clashes),
    _size (rows of the group), _length, _hash and _sha256 of the normalised text."""
    others = [F.col(f"`{name}`") for name in docs.columns if name not in ("doc_id", "text")]
    docs = docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(None).cast("string")).alias("rest"))
    names = docs.columns
    at = {name: i for i, name in enumerate([*names, "_size", "_length", "_hash"])}
    schema = T.StructType([*docs.schema.fields, T.StructField("_size", T.LongType()), T.StructField("_length", T.LongType()), T.StructField("_hash", T.LongType()), T.StructField("_sha256", T.StringType())])
    local = map_arrow(docs, lambda batches: _winners(batches, at, names, False, budget), schema)
    dealt = local.repartition("_length", "_hash").sortWithinPartitions("_length", "_hash")
    return map_arrow(dealt, lambda batches: _winners(batches, at, names, True, budget), schema)


def dedup(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with the columns of `docs`."""
    return owners(docs).select(*[F.col(name) if name in ("doc_id", "text") else F.col(f"rest.`{name}`") for name in docs.columns])


def groups(docs: DataFrame) -> DataFrame:
    """Each row's doc_id, keep_id, group_size, kept and text_sha256; a repeated row repeats."""
    docs = docs.select("doc_id", "text")

    def digest(batches):
        for batch in batches:
            shas = [hashlib.sha256(text).hexdigest() for text in normalised(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.string())], names=["doc_id", "text_sha256"])

    members = map_arrow(docs, digest, T.StructType([docs.schema["doc_id"], T.StructField("text_sha256", T.StringType())]))
    own = owners(docs).select(F.col("doc_id").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_sha256").alias("text_sha256"))
    return members.join(own, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
