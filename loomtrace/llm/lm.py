"""Scores of an interpolated bigram model held in Elias-Fano tries.

Texts are lower-cased (A-Z); tokens are words and one end. Documents whose
crc32(doc_id as text, a null one as empty) mod 10 is not 0 train. With c for
training counts, N training tokens and V distinct ones:

    P1(w)   = (c(w) + 0.1) / (N + 0.1 (V + 1))
    P(w | u) = c(u w) / (c(u) + m) + m / (c(u) + m) * P1(w)

The first token's context is the end. Both sum to 1 over the vocabulary and one
unknown word. The first term of P is what a trie stores, quantised to 1/128
octave; counts of words and P1 are exact. The score is the sum of log10 P.

Nothing of the corpus is held whole anywhere. Documents are packed into blocks
of about `BLOCK` bytes. A block asks each vocabulary shard for the counts of
its distinct words, then each trie shard for its distinct bigrams, giving its
own training counts with the question. A shard adds up what all blocks give,
builds its part of the trie, and answers each block. So a word or bigram that
is everywhere comes once from each block, and contexts with over `FAN`
occurrences are dealt over several shards by successor. The answers meet the
block's tokens, which gives its documents' scores.

Null and empty texts are the end alone. Repeated rows count and are scored one
by one. Without training documents every token is unknown.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow
from .eliasfano import Trie, weight

BLOCK = 8 << 20
#: Entries that a shard takes at most on average, occurrences above which a context is spread.
SHARD, FAN = 3_000_000, 100_000
PRIOR = 1000.0
ADDED = 0.1


def _zip(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def _unzip(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


BLOCKS = "block long, n_tokens long, doc_ids binary, present binary, sizes binary, tokens binary, words binary, train binary"


def blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """Documents packed into blocks: tokens are numbers of the block's own words; the end is the word 0."""

    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        ids, sizes, pieces, resident = [], [], [], 0
        words: defaultdict[bytes, int] = defaultdict()
        words.default_factory = words.__len__
        words[b""]

        def give():
            tokens = np.concatenate(pieces)
            training = np.repeat([not held_out(d) for d in ids], sizes)
            train = np.bincount(tokens[training], minlength=len(words)).astype("<u4")
            row = [(part << 24) + number, len(tokens), _zip(np.array([d or 0 for d in ids], "<i8")), _zip(np.array([d is not None for d in ids], "u1")), _zip(np.array(sizes, "<u4")), _zip(tokens), zstandard.ZstdCompressor(level=1).compress(b" ".join(words)), _zip(train)]
            kinds = [pa.int64()] * 2 + [pa.binary()] * 6
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[f.split()[0] for f in BLOCKS.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                text = (text.as_py() or b"").lower()
                found = text.split()
                found.append(b"")
                pieces.append(np.fromiter(map(words.__getitem__, found), "<u4", len(found)))
                ids.append(doc_id)
                sizes.append(len(found))
                resident += len(text) + 64
                if resident >= size:
                    yield give()
                    number, resident = number + 1, 0
                    ids, sizes, pieces = [], [], []
                    words = defaultdict()
                    words.default_factory = words.__len__
                    words[b""]
        if ids:
            yield give()

    return map_arrow(docs.select("doc_id", "text"), run, BLOCKS)


def _by_shard(shard: np.ndarray, shards: int):
    """(shard, places of its entries) of the shards that have some."""
    order = np.argsort(shard, kind="stable")
    ends = np.cumsum(np.bincount(shard, minlength=shards))
    for k in np.flatnonzero(np.diff(ends, prepend=0)):
        yield int(k), order[ends[k - 1] if k else 0 : ends[k]]


def vocabulary(packed: DataFrame, shards: int) -> DataFrame:
    """For each block and shard: places of words in the block, their training counts and numbers (-1 for unknown words)."""

    def ask(batches):
        for batch in batches:
            for block, words, train in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words, train = zstandard.ZstdDecompressor().decompress(words).split(b" "), _unzip(train, "<u4")
                shard = np.fromiter((xxhash.xxh64_intdigest(w) % shards for w in words), np.int64, len(words))
                rows = [(k, block, _zip(at.astype("<u4")), zstandard.ZstdCompressor(level=1).compress(b" ".join([words[i] for i in at.tolist()])), _zip(train[at])) for k, at in _by_shard(shard, shards)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["shard", "block", "places", "words", "train"])

    def answer(key, table):
        shard = key[0].as_py()
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        asked, given = [], []
        for words, train in zip(table["words"], table["train"], strict=True):
            words = zstandard.ZstdDecompressor().decompress(words.as_py()).split(b" ")
            asked.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            given.append(_unzip(train.as_py(), "<u4"))
        counts = np.bincount(np.concatenate(asked), np.concatenate(given), len(numbers)).astype("<i8")
        ids = np.where(counts > 0, (np.cumsum(counts > 0) - 1) * shards + shard, -1).astype("<i8")
        total, distinct = int(counts.sum()), int((counts > 0).sum())
        return pa.table({
            "block": table["block"], "shard": table["shard"], "places": table["places"],
            "counts": pa.array([_zip(counts[a]) for a in asked], pa.binary()), "ids": pa.array([_zip(ids[a]) for a in asked], pa.binary()),
            "total": pa.array([total] * len(asked), pa.int64()), "known": pa.array([distinct] * len(asked), pa.int64()),
        })

    asked = map_arrow(packed.select("block", "words", "train"), ask, "shard int, block long, places binary, words binary, train binary")
    return asked.groupBy("shard").applyInArrow(answer, "block long, shard int, places binary, counts binary, ids binary, total long, known long")


class Block:
    """A block with the counts and numbers of its words: its documents, tokens and distinct bigrams."""

    def __init__(self, row: dict, answers: pa.Table, shards: int):
        self.doc_ids, self.present, self.sizes, tokens = _unzip(row["doc_ids"], "<i8"), _unzip(row["present"], "u1"), _unzip(row["sizes"], "<u4"), _unzip(row["tokens"], "<u4")
        ends = np.cumsum(self.sizes.astype(np.int64))
        self.first = ends - self.sizes
        self.held = np.array([held_out(int(d) if p else None) for d, p in zip(self.doc_ids, self.present, strict=True)], bool)
        size = int(tokens.max()) + 1
        counts, ids = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        for places, some, numbers in zip(answers["places"], answers["counts"], answers["ids"], strict=True):
            at = _unzip(places.as_py(), "<u4")
            counts[at], ids[at] = _unzip(some.as_py(), "<i8"), _unzip(numbers.as_py(), "<i8")
        before = np.concatenate([[0], tokens[:-1]])
        before[self.first] = 0
        self.count, self.context_count = counts[tokens], counts[before]
        u, w = ids[before], ids[tokens]
        self.both = (u >= 0) & (w >= 0)
        keys = (u[self.both].astype(np.uint64) << np.uint64(32)) | w[self.both].astype(np.uint64)
        self.entries, first, self.entry_of = np.unique(keys, return_index=True, return_inverse=True)
        self.entry_context_count = self.context_count[self.both][first]
        fan = (self.entry_context_count // FAN + 1).astype(np.uint64)
        mixed = (self.entries >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) + (self.entries & np.uint64(0xFFFFFFFF)) % fan * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        self.by_shard = list(_by_shard(((mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(shards)).astype(np.int64), shards))

    def train(self) -> np.ndarray:
        """Training occurrences of each distinct bigram."""
        training = np.repeat(~self.held, self.sizes)[self.both]
        return np.bincount(self.entry_of[training], minlength=len(self.entries)).astype("<u4")


def scores(docs: DataFrame, prior: float = PRIOR) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of `docs`."""
    packed = cut(blocks(docs))
    size = packed.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD))
    words = cut(vocabulary(packed, shards))
    totals = words.groupBy("shard").agg(F.first("total").alias("total"), F.first("known").alias("known")).agg(F.sum("total"), F.sum("known"), F.max("known")).first()
    tokens, known = totals[0] or 0, totals[1] or 0
    if (totals[2] or 0) * shards >= 1 << 32:
        raise ValueError(f"{known} different words can't be numbered in 32 bits")
    state = packed.drop("words", "train", "n_tokens")

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left.to_pylist()[0], right, shards)
        train, number = block.train(), left["block"][0].as_py()
        rows = [(k, number, _zip(np.diff(block.entries[at], prepend=np.uint64(0))), _zip(train[at]), _zip(block.entry_context_count[at].astype("<i8"))) for k, at in block.by_shard]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["shard", "block", "entries", "train", "context"])

    def answer(table: pa.Table) -> pa.Table:
        entries = [np.cumsum(_unzip(x.as_py(), "<u8"), dtype=np.uint64) for x in table["entries"]]
        train = [_unzip(x.as_py(), "<u4") for x in table["train"]]
        everything, first, place = np.unique(np.concatenate(entries), return_index=True, return_inverse=True)
        counts = np.bincount(place, np.concatenate(train), len(everything))
        context = np.concatenate([_unzip(x.as_py(), "<i8") for x in table["context"]])[first]
        there = counts > 0
        trie = Trie(Trie.write(everything[there] >> np.uint64(32), everything[there] & np.uint64(0xFFFFFFFF), counts[there] / (context[there] + prior)))
        codes = [trie.find(e >> np.uint64(32), e & np.uint64(0xFFFFFFFF)).astype("<u2") for e in entries]
        return pa.table({"block": table["block"], "shard": table["shard"], "codes": pa.array(map(_zip, codes), pa.binary())})

    asked = state.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(ask, "shard int, block long, entries binary, train binary, context binary")
    codes = asked.groupBy("shard").applyInArrow(answer, "block long, shard int, codes binary")
    # What the vocabulary and the tries answer comes to the block together.
    answers = words.select("block", "shard", "places", "counts", "ids", F.lit(None).cast("binary").alias("codes")).unionByName(codes, allowMissingColumns=True)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        own = right.filter(pc.is_valid(right["places"]))
        block = Block(left.to_pylist()[0], own, shards)
        places, found = dict(block.by_shard), np.zeros(len(block.entries), np.uint16)
        for shard, some in zip(right["shard"].to_pylist(), right["codes"].to_pylist(), strict=True):
            if some is not None:
                found[places[shard]] = _unzip(some, "<u2")
        own_weight = np.zeros(len(block.count))
        own_weight[block.both] = weight(found)[block.entry_of]
        single = (block.count + ADDED) / (tokens + ADDED * (known + 1))
        pair = own_weight + prior / (block.context_count + prior) * single
        total = lambda values: np.add.reduceat(values, block.first)  # noqa: E731  every document has a token
        return pa.table({
            "doc_id": pa.array(block.doc_ids, mask=block.present == 0), "held_out": pa.array(block.held), "n_tokens": pa.array(block.sizes.astype(np.int64)),
            "n_known": pa.array(total((block.count > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(block.sizes), tokens)),
            "base_score": pa.array(total(np.log10(single))), "score": pa.array(total(np.log10(pair))),
        })

    return state.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
