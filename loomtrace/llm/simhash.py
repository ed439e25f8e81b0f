"""SimHash near-dedup by anchor-point covering.

A fingerprint has 64 bits: a bit is 1 if set in over half of the XXH64 hashes
(seed 42) of a text's 3-word shingles, repeats included, in lower case (A-Z).
Fewer words are one shingle; no words (null, empty, white space) give zero,
which is linked like any other. Fingerprints link at 2 or fewer differing bits.

Anchors are the words of a covering code on 46 of the bits: two binary Golay
codes side by side, each of length 23 and covering radius 3. Each distinct
fingerprint is at home with its nearest anchor. For two linked fingerprints of
which the first is no farther from home, the second is within (its own distance
to the code + 2) of that home; so each visits the anchors up to that distance,
about 40 of 16.7 million, and is compared, over all 64 bits, with those at home
there. Nothing is missed and no bits are left out.

Only distinct fingerprints travel, however many rows share one. An anchor with
over `TILE` fingerprints at home is compared in tiles of its homes and visitors
over many tasks, and each task gives a spanning forest instead of its pairs.

Rows are identified by their doc_id; a null doc_id is never a component's id
unless all of its rows have none. Repeated rows get equal results; very long
texts are hashed whole, some thousand shingles at a time; an empty table gives no
rows; `dedup` keeps all columns, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, packed_row
from .graph import components, local_forest

SEED, SHINGLE, NEAR = 42, 3, 2
#: Generator polynomial of the binary Golay code of length 23.
GOLAY, LENGTH, PARITY = 0b110001110101, 23, 11
#: Fingerprints at home with one anchor, above which it is compared in tiles.
TILE = 4096
#: Pairs compared at once in a task.
PAIRS = 1 << 19


def _signed(fingerprints: np.ndarray) -> np.ndarray:
    return fingerprints.view(np.int64)


def shingles(text: bytes) -> list[bytes]:
    words = text.lower().split()
    if len(words) < SHINGLE:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
    ends = (starts[SHINGLE:] - 1).tolist()
    return [joined[a:b] for a, b in zip(starts.tolist(), ends, strict=False)]


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """Unsigned fingerprints. Hashes become bits some thousand at a time, however long a text is."""
    digest, found = xxhash.xxh64_intdigest, np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        hashes = np.array([digest(s, SEED) for s in shingles(text)], ">u8")
        ones = np.zeros(64, np.int64)
        for start in range(0, len(hashes), 8192):
            part = hashes[start : start + 8192]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        if len(hashes):
            found[k] = np.packbits(2 * ones > len(hashes)).view(">u8")[0]
    return found


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (a signed long) of each row."""
    docs = docs.select("doc_id", "text")

    def run(batches):
        for batch in batches:
            texts = [text or b"" for text in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_signed(fingerprints_of(texts)))], names=["doc_id", "fingerprint"])

    return map_arrow(docs, run, "doc_id long, fingerprint long")


@lru_cache(maxsize=1)
def code() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For words of a Golay block: the syndromes of their three bytes; for each
    syndrome the error patterns in order of weight, the number with a weight up
    to 0, 1 and 2 above the least, and the least weight."""
    def remainder(word: int) -> int:
        for bit in range(LENGTH - 1, PARITY - 1, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - PARITY)
        return word

    bits = np.array([remainder(1 << k) for k in range(24)])
    parts = np.array([[np.bitwise_xor.reduce(bits[8 * b : 8 * b + 8][[byte >> k & 1 == 1 for k in range(8)]]) for byte in range(256)] for b in range(3)])
    # All error patterns of up to 5 bits, with their syndromes.
    patterns, syndromes, weights = [np.array([0])], [np.array([0])], [np.array([0])]
    for weight in range(1, 6):
        highest = np.array([int(p).bit_length() for p in patterns[-1]])
        new = [(patterns[-1][highest <= k] | 1 << k, syndromes[-1][highest <= k] ^ bits[k]) for k in range(LENGTH)]
        patterns.append(np.concatenate([p for p, _ in new]))
        syndromes.append(np.concatenate([s for _, s in new]))
        weights.append(np.full(len(patterns[-1]), weight))
    patterns, syndromes, weights = map(np.concatenate, (patterns, syndromes, weights))
    order = np.lexsort((patterns, weights, syndromes))
    patterns, syndromes, weights = patterns[order], syndromes[order], weights[order]
    first = np.searchsorted(syndromes, np.arange(1 << PARITY))
    least = weights[first]
    above = weights - least[syndromes]
    counts = np.stack([np.bincount(syndromes[above <= k], minlength=1 << PARITY) for k in range(NEAR + 1)], axis=1)
    table = np.zeros((1 << PARITY, counts.max()), np.int64)
    place = np.arange(len(patterns)) - first[syndromes]
    inside = above <= NEAR
    table[syndromes[inside], place[inside]] = patterns[inside]
    return parts, table, counts, least


def visits(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor) of each visit; the visit home is the first of each fingerprint."""
    parts, table, counts, _ = code()
    rows, anchors = [], []
    words = [(fingerprints >> np.uint64(LENGTH * b)).astype(np.int64) & ((1 << LENGTH) - 1) for b in range(2)]
    syndromes = [parts[0][w & 255] ^ parts[1][w >> 8 & 255] ^ parts[2][w >> 16] for w in words]
    index = np.arange(len(fingerprints))
    # (extra distance in the first block, in the second), two at most together.
    for one in range(NEAR + 1):
        for two in range(NEAR + 1 - one):
            low = [counts[s, e - 1] if e else np.zeros(len(s), np.int64) for s, e in zip(syndromes, (one, two), strict=True)]
            size = [counts[s, e] - a for s, e, a in zip(syndromes, (one, two), low, strict=True)]
            total = size[0] * size[1]
            at = np.repeat(index, total)
            inside = np.arange(len(at)) - np.repeat(np.cumsum(total) - total, total)
            choice = [low[0][at] + inside // np.maximum(size[1][at], 1), low[1][at] + inside % np.maximum(size[1][at], 1)]
            found = [words[b][at] ^ table[syndromes[b][at], choice[b]] for b in range(2)]
            rows.append(at)
            anchors.append(found[0] << LENGTH | found[1])
    return np.concatenate(rows), np.concatenate(anchors)


def _replicas(distinct: DataFrame) -> DataFrame:
    """anchor, home, fingerprint: each fingerprint at home once and as a visitor everywhere, its home included."""

    def run(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(0, len(values), 8192):
                part = values[start : start + 8192]
                rows, anchors = visits(part)
                homes = np.concatenate([np.ones(len(part), bool), np.zeros(len(rows), bool)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([anchors[: len(part)], anchors])), pa.array(homes), pa.array(_signed(np.concatenate([part, part[rows]])))],
                    names=["anchor", "home", "fingerprint"],
                )

    return map_arrow(distinct.select("fingerprint"), run, "anchor long, home boolean, fingerprint long")


def _tiled(replicas: DataFrame, homes: DataFrame) -> DataFrame:
    """With the columns row and column of tiles: an anchor with many homes is a square of tiles."""
    hot = cut(homes.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > TILE).select("anchor", F.ceil(F.col("n") / TILE).cast("int").alias("side")))
    side = F.coalesce(F.col("side"), F.lit(1))
    own, every = F.pmod(F.xxhash64("fingerprint"), side).cast("int"), F.sequence(F.lit(0), side - 1)
    met = replicas.join(hot, "anchor", "left")
    cells = F.when(F.col("home"), F.transform(every, lambda k: F.struct(own.alias("row"), k.alias("column")))).otherwise(F.transform(every, lambda k: F.struct(k.alias("row"), own.alias("column"))))
    return met.withColumn("cell", F.explode(cells)).select("anchor", "cell.row", "cell.column", "home", "fingerprint")


def _links(batches):
    """A spanning forest of the links between homes and visitors of each (anchor, row, column); these come together."""

    def compare(keys: np.ndarray, home: np.ndarray, values: np.ndarray):
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        group = np.cumsum(np.isin(np.arange(len(keys)), starts)) - 1
        homes, visitors = np.flatnonzero(home), np.flatnonzero(~home)
        first = np.searchsorted(group[homes], group[visitors], "left")
        count = np.searchsorted(group[homes], group[visitors], "right") - first
        forest_a, forest_b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        some = np.flatnonzero(count)
        visitors, first, count = visitors[some], first[some], count[some]
        ends = np.cumsum(count)
        done = 0
        while done < len(visitors):
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, "right")))
            c = count[done:upto]
            left = values[np.repeat(visitors[done:upto], c)]
            place = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[done:upto], c)
            right = values[homes[place]]
            near = (np.bitwise_count(left ^ right) <= NEAR) & (left != right)
            a, b = local_forest(left[near], right[near])
            forest_a.append(a)
            forest_b.append(b)
            done = upto
        a, b = local_forest(np.concatenate(forest_a), np.concatenate(forest_b))
        return pa.RecordBatch.from_arrays([pa.array(_signed(a)), pa.array(_signed(b))], names=["a", "b"])

    keys, home, values = np.empty((0, 3), np.int64), np.empty(0, bool), np.empty(0, np.uint64)
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        keys = np.concatenate([keys, np.stack([c.astype(np.int64) for c in columns[:3]], axis=1)])
        home, values = np.concatenate([home, columns[3].astype(bool)]), np.concatenate([values, columns[4].view(np.uint64)])
        if len(keys) < 100_000:
            continue
        # The last group may go on in the next batch.
        last = np.flatnonzero((keys != keys[-1]).any(axis=1))
        if len(last):
            stop = last[-1] + 1
            yield compare(keys[:stop], home[:stop], values[:stop])
            keys, home, values = keys[stop:], home[stop:], values[stop:]
    if len(keys):
        yield compare(keys, home, values)


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between linked fingerprints of `distinct` that connect whatever is linked."""
    replicas = _replicas(distinct)
    cells = _tiled(replicas, replicas.where("home"))
    dealt = cells.repartition("anchor", "row", "column").sortWithinPartitions("anchor", "row", "column")
    return map_arrow(dealt, _links, "a long, b long")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each row of `docs`."""
    marked = cut(fingerprints(docs))
    distinct = cut(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    roots = cut(components(links(distinct)).select(F.col("node").alias("fingerprint"), "root"))
    # The least doc_id of each root; roots are fingerprints, so a hot one is one row of many here.
    least = cut(roots.join(distinct, "fingerprint").groupBy("root").agg(F.min("first").alias("component_id")))
    own = cut(roots.join(least, "root").select("fingerprint", "component_id"))
    named = cut(distinct.join(own.withColumn("linked", F.lit(True)), "fingerprint", "left").select("fingerprint", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first")).alias("component_id")))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return marked.join(named, "fingerprint").select("doc_id", digits.alias("fingerprint"), "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is that of their component; rows of one doc_id stay or go together."""
    stay = groups(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stays")).distinct()
    rows = packed_row(docs, "doc_id")
    return rows.join(stay, F.col("doc_id").eqNullSafe(F.col("stays")), "left_semi").select("row.*")
