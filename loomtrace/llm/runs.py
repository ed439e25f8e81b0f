"""Periodic runs of words, by the runs theorem.

A run is a longest stretch of words that repeats with its smallest period. Every run holds, from some place on, the
longest Lyndon word of that place under the order of words or under the reversed order, and that word is one period long.
So the words of a text are ranked by suffix; the next smaller rank (next greater, for the reversed order) ends the longest
Lyndon word of a place; and the longest common prefix of a place and the place one such word later, a range minimum over
the common prefixes of neighbouring suffixes, tells how far the period goes on. Few places are left where it goes on for
long; only their texts are ranked backwards too, to extend these runs to the left.

Several texts are ranked together; their words differ by text, so nothing is shared and no run crosses texts. A text
is in one task with some 300 bytes for each of its words (a text of 10^6 words takes 300 MB). Null, empty and blank
texts have no words and no runs. Rows that repeat stay repeated, extra columns stay; columns named as the result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, map_arrow

#: A run is at least so long, in words and in periods.
LEAST, POWER = 6, 4
#: Words that are ranked together, unless one text has more.
WORDS = 1 << 17
RUN = T.StructType([T.StructField(name, T.LongType(), False) for name in ("start", "length", "period")])


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """The rank of the suffix at each place, by prefix doubling: places whose rank isn't theirs alone are sorted anew by the rank twice as far on."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranks = _grouped(order, symbols[order], np.zeros(n, np.int64), np.arange(n), np.empty(n, np.int64))
    heads = ranks[order]
    step = 1
    while True:
        shared = np.concatenate([heads[1:] == heads[:-1], [False]])
        shared[1:] |= shared[:-1]
        order, heads = order[shared], heads[shared]
        if not len(order):
            return ranks
        # The last place of all has a symbol of its own, so no shared place is nearer to the end than `step`.
        key = heads * n + ranks[order + step]
        by = np.argsort(key, kind="stable")
        order, key, heads = order[by], key[by], heads[by]
        ranks = _grouped(order, key, heads, None, ranks)
        heads = ranks[order]
        step *= 2


def _grouped(order: np.ndarray, key: np.ndarray, heads: np.ndarray, base: np.ndarray | None, ranks: np.ndarray) -> np.ndarray:
    """`ranks`, where each group of equal keys gets the rank of its first place: the head of the group it was in, and how many of that come before."""
    n = len(order)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    if base is None:
        outer = np.concatenate([[True], heads[1:] != heads[:-1]])
        first = np.maximum.accumulate(np.where(outer, np.arange(n), 0))
        base = heads + np.arange(n) - first
    ranks[order] = base[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
    return ranks


def common_prefixes(symbols: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """By rank, the common prefix of a suffix and the one before it.

    Where both are preceded by the same word, the value is that of the place before less one; others are compared word
    by word, which is n log n words at most in all.
    """
    n = len(symbols)
    by_rank = np.empty(n, np.int64)
    by_rank[ranks] = np.arange(n)
    before = np.full(n, -1)
    before[by_rank[1:]] = by_rank[:-1]
    place = np.arange(n)
    follows = (before > 0) & (place > 0)
    follows[follows] = symbols[place[follows] - 1] == symbols[before[follows] - 1]
    compare = place[~follows & (before >= 0)]
    lengths = np.zeros(n, np.int64)
    padded = np.concatenate([symbols, [-1] * 65])
    left, right, width = compare, before[compare], 1
    while len(left):
        span = np.arange(width)
        differ = padded[left[:, None] + span] != padded[right[:, None] + span]
        found = differ.any(axis=1)
        add = np.where(found, differ.argmax(axis=1), width)
        lengths[compare] += add
        compare, left, right = compare[~found], left[~found] + width, right[~found] + width
        width = min(64, 2 * width) if len(left) * width < n else width
    start = np.maximum.accumulate(np.where(follows, 0, place))
    lengths = np.where(follows, lengths[start] - (place - start), lengths)
    return lengths[by_rank]


def sparse(values: np.ndarray, least: bool = True) -> list[np.ndarray]:
    """For each power of two the extreme of so many values from each place on."""
    tables, width, extreme = [values.astype(np.int32)], 1, np.minimum if least else np.maximum
    while 2 * width <= len(values):
        tables.append(extreme(tables[-1][:-width], tables[-1][width:]))
        width *= 2
    return tables


def next_beyond(ranks: np.ndarray, smaller: bool) -> np.ndarray:
    """For each place the next one with a smaller (else greater) rank, len(ranks) if there is none."""
    tables, n = sparse(ranks, smaller), len(ranks)
    found, own = np.arange(1, n + 1), ranks
    for level in range(len(tables) - 1, -1, -1):
        table = tables[level]
        inside = found < len(table)
        extreme = table[np.where(inside, found, 0)]
        found = found + ((inside & (extreme > own if smaller else extreme < own)).astype(np.int64) << level)
    return found


class Extensions:
    """Longest common prefixes of any two places."""

    def __init__(self, symbols: np.ndarray):
        self.ranks = suffix_ranks(symbols)
        self.tables = sparse(common_prefixes(symbols, self.ranks))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.minimum(self.ranks[a], self.ranks[b]) + 1, np.maximum(self.ranks[a], self.ranks[b]) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        found = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            own = level == k
            found[own] = np.minimum(self.tables[k][low[own]], self.tables[k][high[own] - (1 << k)])
        return found


def runs_of(words: list[np.ndarray], least: int = LEAST, power: int = POWER) -> list[np.ndarray]:
    """For each text, given as the numbers of its words (from 0), its runs as rows (start, length, period), by start, then period.

    `power` is 2 at least: only then each run has a Lyndon word of its own.
    """
    found = [np.empty((0, 3), np.int64) for _ in words]
    kept = [k for k, own in enumerate(words) if len(own) >= least]
    if not kept:
        return found
    symbols, starts = _joined([words[k] for k in kept])
    ends = starts + np.array([len(words[k]) for k in kept])
    text = np.repeat(np.arange(len(kept)), ends - starts + 1)
    forward = Extensions(symbols)
    places, periods, ahead = [], [], []
    for smaller in (True, False):
        word_end = next_beyond(forward.ranks, smaller)
        place = np.arange(len(symbols))
        period = word_end - place
        # The first Lyndon word of a run begins in its first period, so a period less than `power` of them, and a word, follow.
        fits = place + (power - 1) * period < ends[text]
        place, period = place[fits], period[fits]
        same = symbols[place] == symbols[place + period]
        place, period = place[same], period[same]
        length = forward(place, place + period) if len(place) else place
        long = length > (power - 2) * period
        places.append(place[long]), periods.append(period[long]), ahead.append(length[long])
    place, period, ahead = map(np.concatenate, (places, periods, ahead))
    if not len(place):
        return found
    # Backwards, over the texts that have any such place.
    some = np.unique(text[place])
    back_symbols, back_starts = _joined([words[kept[k]][::-1] for k in some])
    backward = Extensions(back_symbols)
    at = np.searchsorted(some, text[place])
    mirrored = back_starts[at] + (ends[text[place]] - 1 - place)
    behind = np.zeros(len(place), np.int64)
    inner = place > starts[text[place]]
    behind[inner] = backward(mirrored[inner] + 1, mirrored[inner] + 1 - period[inner])
    start = place - behind
    length = behind + period + ahead
    good = length >= np.maximum(least, power * period)
    rows = np.unique(np.stack([text[place], start - starts[text[place]], period, length], axis=1)[good], axis=0)
    own, first = np.unique(rows[:, 0], return_index=True)
    for k, part in zip(own.tolist(), np.split(rows[:, [1, 3, 2]], first[1:]), strict=False):
        found[kept[k]] = part
    return found


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One row of symbols, and where each text starts in it. A text ends with a symbol below its own words; the words of one text are below those of the next."""
    lengths = np.array([len(t) for t in texts])
    most = np.array([int(t.max()) + 2 for t in texts])
    base = np.cumsum(most) - most
    joined = np.concatenate([part for t, b in zip(texts, base.tolist(), strict=True) for part in (t.astype(np.int64) + (b + 1), [b])])
    return joined, np.cumsum(lengths + 1) - lengths - 1


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words but those after the first period of a run, joined by spaces."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def detect(docs: DataFrame, least: int = LEAST, power: int = POWER, runs: str = "runs", text: str = "collapsed", keep_text: bool = True) -> DataFrame:
    """`docs` with the runs of `text` (start and length in words, period; by start, then period) and the text without repetitions of a run."""
    if power < 2:
        raise ValueError("a run has two periods at least")
    docs = docs.drop(runs, text)
    at = docs.columns.index("text")
    rest = [k for k in range(len(docs.columns)) if k != at or keep_text]

    def told(part: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
        numbers = []
        for words in texts:
            numbers.append(pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy() if len(words) >= least else np.empty(0, np.int32))
        found = runs_of(numbers, least, power)
        offsets = np.cumsum([0, *map(len, found)])
        flat = np.concatenate([np.empty((0, 3), np.int64), *found])
        rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=[pa.field(f.name, pa.int64(), False) for f in RUN])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)
        left = pa.array([collapsed(w, r) for w, r in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([*(part.column(k) for k in rest), lists, left], names=[*(part.schema.names[k] for k in rest), runs, text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, texts = 0, 0, []
            for k, value in enumerate(batch.column(at)):
                words = (value.as_py() or "").encode().split()
                if texts and held + len(words) > WORDS:
                    yield told(batch.slice(start, k - start), texts)
                    start, held, texts = k, 0, []
                texts.append(words)
                held += len(words)
            if texts:
                yield told(batch.slice(start), texts)

    added = [T.StructField(runs, T.ArrayType(RUN, False), False), T.StructField(text, T.StringType(), False)]
    return map_arrow(docs, run, T.StructType([*(docs.schema.fields[k] for k in rest), *added]))


def looped(id_: Column, text: Column) -> Column:
    """The text, of which by the rule of the query one in ten goes round in a loop from some word on (an id that is null: none)."""
    h = F.crc32(id_.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def turn(words: Column) -> Column:
        n = F.size(words).cast("long")
        start = g % n
        period = 1 + F.floor((n - start) / (3 + g % 8))
        place = lambda i: F.when(i < start, i).otherwise(start + (i - start) % period)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i).cast("int"))), " ")

    # The words are named once, so they are found once.
    parts = F.transform(F.array(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)), lambda words: F.when(F.size(words) > 0, turn(words)).otherwise(""))
    return F.when(h % 10 == 0, parts[0]).otherwise(text)


def digests(docs: DataFrame, runs: str = "runs", text: str = "collapsed") -> DataFrame:
    """doc_id, the number of runs, the run of most periods (earlier and shorter ones first), and digests of all runs and of the collapsed text."""
    more = lambda a, b: a["length"] * b["period"] - b["length"] * a["period"]
    before = lambda a, b: (more(a, b) > 0) | (more(a, b) == 0) & ((a["start"] < b["start"]) | (a["start"] == b["start"]) & (a["period"] < b["period"]))
    top = F.reduce(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(before(r, best), r).otherwise(best))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = docs.select("doc_id", F.size(runs).cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(text, 256).alias("collapsed_sha256"))
    milli = F.floor(1000 * F.col("top.length") / F.col("top.period"))
    return found.select("doc_id", "n_runs", "top.start", "top.length", "top.period", milli.cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
