"""Suffix-array dedup: bytes of strings of 200 bytes that start anywhere else too.

The construction is column-wise over many strings: each round puts one symbol
before every string of the collection, which updates the order of their
suffixes (the collection's Burrows-Wheeler order) and the common prefixes of
neighbours; two neighbours with 200 bytes in common are a repeat. Rounds over
whole documents would be as many as the longest text has bytes and each would
pass over the whole collection, so Spark first deals the work out:

* Every window of 200 bytes has an anchor, its least 64-byte gram by hash (the
  first of equal ones). Equal windows have equal anchors at equal places, so the
  consecutive windows of one anchor are a string of at most 336 bytes that needs
  comparing only with strings of the same gram, aligned at it.
* Texts are packed into blocks. A block asks for the counts of its grams; grams
  found once are done. Strings of the others, equal ones of a block sent once,
  meet by gram in shards. There the columns are inserted from the right to the
  left, aligned at the anchor, so a round needs the order of one column only.
* A gram with over `hot` strings is dealt by the anchor's place in the window
  too, over many shards, with shorter strings of which more are equal.

A window start belongs to one string, so neighbours are always two places. Both
answers come back to the block as bits. Nothing is held whole anywhere; blocks
are written to the shared folder, so lost executors cost only running tasks.

Null texts are empty; texts under 200 bytes keep all bytes; a text that repeats
loses all of them if it has 200 bytes or more. Repeated rows repeat each other.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow

WINDOW, GRAM = 200, 64
#: Grams of a window; the most bytes of a string.
PLACES = WINDOW - GRAM + 1
COLUMNS = WINDOW + PLACES - 1
BLOCK, CHUNK = 4 << 20, 1 << 19
#: Text for which there is a shard, strings of one gram from which it is dealt by place too, and places of a part.
SHARD, HOT, PART = 16 << 20, 2000, 8
#: Strings whose columns are inserted together.
BATCH = 4000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _zip(data) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes())


def _unzip(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """A random 64-bit number for each byte."""
    return np.random.default_rng(200).integers(0, 1 << 64, 256, np.uint64)


def runs_of(buffer: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """The strings of texts that lie one after another in `buffer`: first window, number of windows, place of the anchor in the first, gram."""
    if len(buffer) < WINDOW:
        return tuple(np.empty(0, k) for k in ("<u4", "u1", "u1", "<u8"))
    hashes, width = symbols()[buffer], 1
    while width < GRAM:
        both = hashes[:-width] * MULTIPLIER
        both += hashes[width:]
        both ^= both >> np.uint64(29)
        hashes, width = both, 2 * width
    hashes *= MULTIPLIER
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= PLACES:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (PLACES - width)], least[PLACES - width :])
    begins = np.concatenate([[0], ends[:-1]])
    long = ends - begins >= WINDOW
    inside = np.zeros(len(buffer) + 1, np.int8)
    inside[begins[long]] += 1
    inside[ends[long] - WINDOW + 1] -= 1
    windows = np.flatnonzero(np.cumsum(inside, dtype=np.int8)[: len(least)])
    anchors = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(windows):
        return tuple(np.empty(0, k) for k in ("<u4", "u1", "u1", "<u8"))
    first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    starts, counts = windows[first], np.diff(first, append=len(windows))
    return starts.astype("<u4"), counts.astype("u1"), (anchors[first] - starts).astype("u1"), hashes[anchors[first]].astype("<u8")


def block_runs(buffer: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, ...]:
    """`runs_of` for a block, over some texts at a time."""
    found, begin, held = [], 0, []
    for k, size in enumerate(sizes):
        held.append(size)
        if sum(held) >= CHUNK or k == len(sizes) - 1:
            stop = begin + sum(held)
            starts, *rest = runs_of(buffer[begin:stop], np.cumsum(held))
            found.append((starts + np.uint32(begin), *rest))
            begin, held = stop, []
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else runs_of(buffer, np.empty(0, np.int64))


BLOCKS = "block long, n_bytes long, doc_ids binary, present binary, sizes binary, text binary, starts binary, counts binary, places binary, grams binary"


def blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """Documents packed into blocks, with the strings of their windows."""

    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        ids, texts, resident = [], [], 0

        def give():
            whole, sizes = b"".join(texts), list(map(len, texts))
            starts, counts, places, grams = block_runs(np.frombuffer(whole, np.uint8), sizes)
            row = [(part << 24) + number, len(whole), _zip(np.array([d or 0 for d in ids], "<i8")), _zip(np.array([d is not None for d in ids], "u1")), _zip(np.array(sizes, "<u4")), _zip(whole), _zip(np.diff(starts, prepend=np.uint32(0))), _zip(counts), _zip(places), grams.tobytes()]
            kinds = [pa.int64()] * 2 + [pa.binary()] * 8
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[f.split()[0] for f in BLOCKS.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                text = text.as_py() or b""
                ids.append(doc_id)
                texts.append(text)
                resident += len(text) + 64
                if resident >= size:
                    yield give()
                    number, ids, texts, resident = number + 1, [], [], 0
        if ids:
            yield give()

    return map_arrow(docs.select("doc_id", "text"), run, BLOCKS)


def _by_shard(shard: np.ndarray, shards: int):
    """(shard, places of its entries) of the shards that have some."""
    order = np.argsort(shard, kind="stable")
    ends = np.cumsum(np.bincount(shard, minlength=shards))
    for k in np.flatnonzero(np.diff(ends, prepend=0)):
        yield int(k), order[ends[k - 1] if k else 0 : ends[k]]


def _dealt(grams: np.ndarray, parts: np.ndarray, shards: int) -> np.ndarray:
    mixed = (grams ^ (parts.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * MULTIPLIER
    return ((mixed >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def _table(rows: list[tuple], names: str, binaries: int) -> pa.Table:
    kinds = [pa.int32(), pa.int64()] + [pa.binary()] * binaries
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names.split())


def gram_counts(packed: DataFrame, shards: int, hot: int = HOT) -> DataFrame:
    """For each block and shard, how often its distinct grams (in order) occur: 0 once, 1 more often, 2 over `hot` times."""

    def ask(batches):
        for batch in batches:
            for block, grams in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                distinct, counts = np.unique(np.frombuffer(grams, "<u8"), return_counts=True)
                rows = [(k, block, distinct[at].tobytes(), _zip(counts[at].astype("<u4"))) for k, at in _by_shard(_dealt(distinct, np.zeros(1), shards), shards)]
                yield from _table(rows, "shard block grams counts", 2).to_batches()

    def answer(table: pa.Table) -> pa.Table:
        grams = [np.frombuffer(x.as_py(), "<u8") for x in table["grams"]]
        counts = np.concatenate([_unzip(x.as_py(), "<u4") for x in table["counts"]])
        distinct, place = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(place, counts, len(distinct))
        kind = ((total > 1).astype("u1") + (total > hot))[place]
        ends = np.cumsum([len(g) for g in grams])
        return pa.table({"shard": table["shard"], "block": table["block"], "kinds": pa.array([_zip(kind[e - len(g) : e]) for g, e in zip(grams, ends, strict=True)], pa.binary())})

    asked = map_arrow(packed.select("block", "grams"), ask, "shard int, block long, grams binary, counts binary")
    return asked.groupBy("shard").applyInArrow(answer, "shard int, block long, kinds binary")


class Block:
    """A block with the kinds of its grams: its strings that have to be compared, by shard."""

    def __init__(self, row: dict, answers: pa.Table, shards: int):
        self.doc_ids, self.present, self.sizes = _unzip(row["doc_ids"], "<i8"), _unzip(row["present"], "u1"), _unzip(row["sizes"], "<u4").astype(np.int64)
        self.whole = zstandard.ZstdDecompressor().decompress(row["text"])
        starts, counts = np.cumsum(_unzip(row["starts"], "<u4"), dtype=np.int64), _unzip(row["counts"], "u1").astype(np.int64)
        places, grams = _unzip(row["places"], "u1").astype(np.int64), np.frombuffer(row["grams"], "<u8")
        distinct, place = np.unique(grams, return_inverse=True)
        kinds, by_shard = np.zeros(len(distinct), np.uint8), dict(_by_shard(_dealt(distinct, np.zeros(1), shards), shards))
        for shard, some in zip(answers["shard"].to_pylist(), answers["kinds"].to_pylist(), strict=True):
            kinds[by_shard[shard]] = _unzip(some, "u1")
        kind = kinds[place]
        some, hot = kind == 1, kind == 2
        made = [(starts[some], counts[some], places[some], grams[some], np.zeros(some.sum(), np.int64))]
        if hot.any():
            # One entry for each window, then one string for each part of the places.
            at = np.repeat(np.flatnonzero(hot), counts[hot])
            inside = np.arange(len(at)) - np.repeat(np.cumsum(counts[hot]) - counts[hot], counts[hot])
            own, part = places[at] - inside, (places[at] - inside) // PART
            first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (part[1:] != part[:-1])]))
            made.append((starts[at[first]] + inside[first], np.diff(first, append=len(at)), own[first], grams[at[first]], part[first] + 1))
        self.starts, self.counts, self.places, self.grams, parts = (np.concatenate(c) for c in zip(*made, strict=True))
        # (shard, distinct strings as (start, size, place, gram), number of the distinct string of each entry, entries)
        self.shards = []
        for shard, at in _by_shard(_dealt(self.grams, parts, shards), shards):
            numbers: dict[bytes, int] = {}
            of = [numbers.setdefault(self.whole[a : a + n], len(numbers)) for a, n in zip(self.starts[at].tolist(), (self.counts[at] + WINDOW - 1).tolist(), strict=True)]
            self.shards.append((shard, at, np.array(of, np.int64), list(numbers)))


def _insert(strings: list[bytes], places: np.ndarray, bucket: np.ndarray) -> list[np.ndarray]:
    """For each string, which of its windows another string of its bucket has at the same place of the anchor.

    `bucket` is ascending. Column by column from the right, one symbol is put before each string: a stable
    sort by (bucket, symbol) gives the new order, and neighbours with one symbol have one more byte in
    common than the least common prefix between their old places.
    """
    size = len(strings)
    lengths = np.array([len(s) for s in strings])
    # Symbols by column, from 1; 0 where a string has none.
    columns = np.zeros((size, COLUMNS), np.int16)
    for k, (string, place) in enumerate(zip(strings, (PLACES - 1 - places).tolist(), strict=True)):
        columns[k, place : place + len(string)] = np.frombuffer(string, np.uint8)
        columns[k, place : place + len(string)] += 1
    columns = np.ascontiguousarray(columns.T)
    keys = bucket.astype(np.int32) * 257
    order, common = np.arange(size), np.zeros(size + 1, np.int16)
    repeated = np.zeros((PLACES, size), bool)
    for column in range(COLUMNS - 1, -1, -1):
        symbol = columns[column]
        key = (keys + symbol)[order]
        moved = np.argsort(key, kind="stable")
        key = key[moved]
        same = np.flatnonzero((key[1:] == key[:-1]) & (symbol[order[moved[1:]]] > 0)) + 1
        low, high = moved[same - 1] + 1, moved[same] + 1
        least = common[high - 1]
        apart = np.flatnonzero(high - low > 1)
        if len(apart):
            least[apart] = np.minimum.reduceat(common, np.stack([low[apart], high[apart]], axis=1).ravel())[::2]
        common = np.zeros(size + 1, np.int16)
        common[same] = least + 1
        order = order[moved]
        if column < PLACES:
            pairs = np.flatnonzero(common[:size] >= WINDOW)
            repeated[column, order[pairs]] = True
            repeated[column, order[pairs - 1]] = True
    return [repeated[PLACES - 1 - p : PLACES - p + n - WINDOW, k] for k, (p, n) in enumerate(zip(places.tolist(), lengths.tolist(), strict=True))]


def compare(strings: list[bytes], places: np.ndarray, grams: np.ndarray, batch: int = BATCH) -> list[np.ndarray]:
    """For each of different strings, which of its windows other strings have; strings of few grams at a time."""
    order = np.argsort(grams, kind="stable")
    _, begin, size = np.unique(grams[order], return_index=True, return_counts=True)
    lone = [np.zeros(len(s) - WINDOW + 1, bool) for s in strings]
    held: list[int] = []
    bucket: list[np.ndarray] = []
    some = np.flatnonzero(size > 1)
    for k, (a, n) in enumerate(zip(begin[some].tolist(), size[some].tolist(), strict=True)):
        held += order[a : a + n].tolist()
        bucket.append(np.full(n, len(bucket)))
        if len(held) >= batch or k == len(some) - 1:
            for place, found in zip(held, _insert([strings[i] for i in held], places[held], np.concatenate(bucket)), strict=True):
                lone[place] = found
            held, bucket = [], []
    return lone


def _met(table: pa.Table) -> pa.Table:
    """What a shard answers each block: the windows of its strings that are repeated, as bits."""
    numbers: dict[bytes, int] = {}
    own, places, grams, again = [], [], [], []
    for k in range(table.num_rows):
        lengths, text = _unzip(table["lengths"][k].as_py(), "<u2").astype(np.int64), zstandard.ZstdDecompressor().decompress(table["text"][k].as_py())
        ends = np.cumsum(lengths)
        size = len(numbers)
        of = np.array([numbers.setdefault(text[a:b], len(numbers)) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)], np.int64)
        new = of >= size  # the strings of a block differ, so new ones come in order
        places.append(_unzip(table["places"][k].as_py(), "u1")[new].astype(np.int64))
        grams.append(np.frombuffer(table["grams"][k].as_py(), "<u8")[new])
        again.append(_unzip(table["again"][k].as_py(), "u1"))
        own.append(of)
    times = np.bincount(np.concatenate(own), np.concatenate(again) + 1.0, len(numbers))
    strings = list(numbers)
    windows = compare(strings, np.concatenate(places), np.concatenate(grams))
    for k in np.flatnonzero(times > 1).tolist():
        windows[k] = np.ones(len(windows[k]), bool)
    bits = [_zip(np.packbits(np.concatenate([windows[i] for i in of.tolist()]))) for of in own]
    return pa.table({"shard": table["shard"], "block": table["block"], "bits": pa.array(bits, pa.binary())})


def _covered(block: Block, answers: pa.Table) -> np.ndarray:
    """Which bytes of a block a repeated window covers."""
    change = np.zeros(len(block.whole) + WINDOW + 1, np.int32)
    bits = dict(zip(answers["shard"].to_pylist(), answers["bits"].to_pylist(), strict=True))
    for shard, at, of, strings in block.shards:
        counts = np.array([len(s) - WINDOW + 1 for s in strings])
        flags = np.unpackbits(_unzip(bits[shard], "u1"), count=int(counts.sum())).astype(bool)
        ends = np.cumsum(counts)
        for start, number in zip(block.starts[at].tolist(), of.tolist(), strict=True):
            found = flags[ends[number] - counts[number] : ends[number]]
            if found.any():
                places = np.flatnonzero(found) + start
                change[places] += 1
                change[places + WINDOW] -= 1
    return np.cumsum(change)[: len(block.whole)] > 0


def _repeats(docs: DataFrame, give, schema: str, hot: int) -> DataFrame:
    """`give(block, covered)` for each block of documents."""
    packed = cut(blocks(docs))
    size = packed.agg(F.sum("n_bytes")).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD))
    kinds = cut(gram_counts(packed, shards, hot))

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        block, rows = Block(left.to_pylist()[0], right, shards), []
        for shard, at, of, strings in block.shards:
            first = np.unique(of, return_index=True)[1]
            again = (np.bincount(of) > 1).astype("u1")
            rows.append((shard, left["block"][0].as_py(), _zip(b"".join(strings)), _zip(np.array(list(map(len, strings)), "<u2")), _zip(block.places[at][first].astype("u1")), block.grams[at][first].tobytes(), _zip(again)))
        return _table(rows, "shard block text lengths places grams again", 5)

    asked = packed.groupBy("block").cogroup(kinds.groupBy("block")).applyInArrow(ask, "shard int, block long, text binary, lengths binary, places binary, grams binary, again binary")
    met = asked.groupBy("shard").applyInArrow(_met, "shard int, block long, bits binary")
    answers = cut(kinds.withColumn("bits", F.lit(None).cast("binary")).unionByName(met, allowMissingColumns=True))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left.to_pylist()[0], right.filter(pc.is_valid(right["kinds"])), shards)
        return give(block, _covered(block, right.filter(pc.is_valid(right["bits"]))))

    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)


def _places(block: Block):
    ends = np.cumsum(block.sizes)
    return zip((ends - block.sizes).tolist(), ends.tolist(), strict=True)


def _doc_ids(block: Block) -> pa.Array:
    return pa.array(block.doc_ids, mask=block.present == 0)


def digests(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of `docs`."""

    def give(block: Block, covered: np.ndarray) -> pa.Table:
        text, rises = np.frombuffer(block.whole, np.uint8), np.diff(covered, prepend=False) & covered
        rows = []
        for a, b in _places(block):
            own = covered[a:b]
            spans = int(rises[a:b].sum()) + int(b > a and own[0] and not rises[a])
            rows.append((int(own.sum()), spans, hashlib.sha256(text[a:b][~own].tobytes()).hexdigest()))
        removed, spans, shas = zip(*rows, strict=True)
        return pa.table({"doc_id": _doc_ids(block), "n_bytes": pa.array(block.sizes), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(shas, pa.string())})

    return _repeats(docs, give, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", hot)


def kept(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id and the bytes that are left of each row of `docs`; a cut may fall inside a character."""

    def give(block: Block, covered: np.ndarray) -> pa.Table:
        text = np.frombuffer(block.whole, np.uint8)
        return pa.table({"doc_id": _doc_ids(block), "kept": pa.array([text[a:b][~covered[a:b]].tobytes() for a, b in _places(block)], pa.binary())})

    return _repeats(docs, give, "doc_id long, kept binary", hot)
