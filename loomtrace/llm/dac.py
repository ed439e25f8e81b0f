"""Token ids as files of directly addressable codes.

Every document is encoded with the tokenizers library and gets the end id. Ids
are split into chunks of 8 bits. A segment stores the first chunk of all its
ids, a bitmap of the ids that go on, the second chunks of those, and so on; a
rank directory (set bits before each 512) leads from an id to its next chunk,
so any token is read without decoding others.

A file is Parquet written by Spark: one row for a segment, in ascending doc_id
order (null first, equal ids by text). A segment ends with the document that
fills it. Spark's commit protocol keeps attempts of lost tasks out, and any
store that Spark writes will do. Null and empty texts are the end id alone;
very long texts are encoded whole; a token that the vocabulary adds to its own
(such as a text's end) has its id where a text spells it, as in the library; repeated rows are documents of their own; an
empty table writes no segment and reads as no rows. Only doc_id and text are
read, so other columns can't clash.
"""

from __future__ import annotations

import gc
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, ship

MAGIC = b"DAC1"
BLOCK_BITS = 512
#: Ids after which a segment is closed.
SEGMENT = 1 << 18
#: Words whose ids a Python worker keeps; beyond it the half that was learnt last and those needed at once stay.
CACHE = 1_000_000
#: Bytes of text whose words are looked up together.
AT_ONCE = 3 << 20
SEGMENT_SCHEMA = "part int, segment int, part_start long, n_docs long, n_tokens long, payload binary"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of many texts, as little-endian 32-bit integers, with the ids of words kept.

    No merge crosses a space that follows anything but white space, so such a
    space and the word after it have ids of their own. The new words of a batch
    are encoded as one text; in it a word begins where a token begins with a
    space. A text with other spaces (at its end, or two together) or with a token
    that the vocabulary adds to its own (in `added`) is encoded whole.
    """

    def __init__(self, path: str, cache: int = CACHE):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Texts without added tokens have the same ids either way, and looking for none of them takes half the time.
        self.tokenizer.encode_special_tokens = True
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.path, self.plain_library = path, None
        space = self.tokenizer.pre_tokenizer.pre_tokenize_str(" ")[0][0]
        self.begins = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.begins[[number for token, number in self.tokenizer.get_vocab().items() if token.startswith(space)]] = True
        self.cache, self.known = cache, {}

    def each(self, texts: list[str]) -> list[bytes]:
        return [np.array(found.ids, "<u4").tobytes() for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def with_added(self, text: str) -> bytes:
        """The ids of a text that has added tokens, by the library as it comes."""
        from tokenizers import Tokenizer

        self.plain_library = self.plain_library or Tokenizer.from_file(self.path)
        return np.array(self.plain_library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        buffer = self.each([" " + " ".join(words)])[0]
        starts = (4 * np.flatnonzero(self.begins[np.frombuffer(buffer, "<u4")])).tolist()
        self.known.update(zip(words, map(buffer.__getitem__, map(slice, starts, [*starts[1:], len(buffer)])), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of texts. Lists of words hold no cycles, and looking for some in them would take a fifth of the time."""
        gc.disable()
        try:
            return self._encoded(texts)
        finally:
            gc.enable()

    def _encoded(self, texts: list[str]) -> list[bytes]:
        # Nothing of a text with an added token is learnt: its words may be parts of the token.
        plain = [not any(token in text for token in self.added) for text in texts]
        split = [text.split(" ") if alone else [""] for text, alone in zip(texts, plain, strict=True)]
        # First words have no space before them and are no words here.
        firsts = [words.pop(0) for words in split]
        words = set().union(*split)
        new = words - self.known.keys()
        if len(self.known) + len(new) > self.cache:
            # The half that was learnt last stays, and what is needed now; words that come often are soon learnt again.
            later = {word: self.known[word] for word in islice(self.known, len(self.known) // 2, None)}
            self.known = later | {word: self.known[word] for word in words - new}
        # A word that ends with white space is not one; texts that have it are encoded whole.
        new = [word for word in new if word and not word[-1].isspace()]
        for start in range(0, len(new), 10_000):
            self.learn(new[start : start + 10_000])
        out, ids = [], self.known.__getitem__
        for text, alone, first, start, rest in zip(texts, plain, firsts, self.each(firsts), split, strict=True):
            if not alone:
                out.append(self.with_added(text))
                continue
            try:
                if first[-1:].isspace() or (rest and not first):
                    raise KeyError(first)
                out.append(start + b"".join(map(ids, rest)))
            except KeyError:
                out += self.each([text])
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, loaded once by each Python worker."""
    return Encoder(path)


class Segment:
    """A read segment: documents and random access to tokens."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        docs, size, levels = struct.unpack_from("<QQI", payload, 4)
        at = 24

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(payload, kind, count, at)
            at += found.nbytes
            return found

        self.size, self.doc_ids, self.present, self.lengths, self.levels = size, take("<i8", docs), take("u1", docs), take("<u8", docs), []
        for _ in range(levels):
            (count,) = struct.unpack_from("<Q", payload, at)
            at += 8
            self.levels.append((take("u1", count), take("u1", -(-count // 8)), take("<u4", count // BLOCK_BITS + 1)))

    def access(self, index: int | np.ndarray) -> np.ndarray:
        """The ids at one or many places."""
        places = np.atleast_1d(np.asarray(index, np.int64))
        values, rows, shift = np.zeros(len(places), np.uint32), np.arange(len(places)), 0
        for chunks, bits, directory in self.levels:
            values[rows] |= chunks[places].astype(np.uint32) << np.uint32(shift)
            on = (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
            rows, places = rows[on], self._rank(bits, directory, places[on])
            shift += 8
        return values

    @staticmethod
    def _rank(bits: np.ndarray, directory: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Set bits before each place: the directory's count, then at most 512 bits."""
        block = places // BLOCK_BITS
        padded = np.concatenate([bits, np.zeros(BLOCK_BITS // 8, np.uint8)])
        counts = np.zeros(len(places), np.int64)
        for k in range(0, len(places), 1 << 14):
            part = slice(k, k + (1 << 14))
            window = padded[(block[part] * (BLOCK_BITS // 8))[:, None] + np.arange(BLOCK_BITS // 8)]
            ahead = np.clip((places[part] % BLOCK_BITS)[:, None] - np.arange(0, BLOCK_BITS, 8), 0, 8).astype(np.uint8)
            mask = ((1 << ahead.astype(np.uint16)) - 1).astype(np.uint8)
            counts[part] = np.bitwise_count(window & mask).sum(axis=1)
        return directory[block] + counts

    def tokens(self) -> np.ndarray:
        """All ids: the same codes read in order, where ranks are running counts."""
        values = None
        for level in range(len(self.levels) - 1, -1, -1):
            chunks, bits, _ = self.levels[level]
            own = chunks.astype(np.uint32)
            if values is not None:
                on = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
                own[on] |= values << np.uint32(8)
            values = own
        return np.empty(0, np.uint32) if values is None else values


def pack(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    out = [b"", np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is not None for d in doc_ids], "u1").tobytes(), np.array(lengths, "<u8").tobytes()]
    rest, levels = ids.astype(np.uint32), 0
    while len(rest):
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        blocks = np.zeros(len(rest) // BLOCK_BITS + 1, np.int64)
        ends = np.add.reduceat(more, np.arange(0, len(rest), BLOCK_BITS), dtype=np.int64)
        blocks[1:] = np.cumsum(ends)[: len(blocks) - 1]
        out += [struct.pack("<Q", len(rest)), (rest & 255).astype("u1").tobytes(), bits.tobytes(), blocks.astype("<u4").tobytes()]
        rest, levels = rest[more] >> np.uint32(8), levels + 1
    out[0] = MAGIC + struct.pack("<QQI", len(doc_ids), len(ids), levels)
    return b"".join(out)


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """The ids and texts of a batch, some `AT_ONCE` bytes of text at a time, as their words are held meanwhile."""
    at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) // AT_ONCE
    edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), batch.num_rows]
    for start, end in zip(edges, edges[1:], strict=False):
        some = batch.slice(start, end - start)
        yield some.column(0).to_pylist(), [text or "" for text in some.column(1).to_pylist()]


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = 0, segment: int = SEGMENT) -> None:
    """Encode `docs` and write their ids to `path`, which must not exist."""
    vocabulary = vocabulary or default_vocabulary()
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        part, number, start = TaskContext.get().partitionId(), 0, 0
        held, lengths, texts, size = [], [], [], 0

        def give():
            payload = pack(held, lengths, np.frombuffer(b"".join(texts), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), *(pa.array([n], pa.int64()) for n in (start, len(held), size)), pa.array([payload], pa.binary())], names=["part", "segment", "part_start", "n_docs", "n_tokens", "payload"])

        last = struct.pack("<I", end)
        for doc_ids, some in (part for batch in batches for part in pieces(batch)):
            for doc_id, ids in zip(doc_ids, encoder(vocabulary).encode(some), strict=True):
                ids += last
                held.append(doc_id)
                lengths.append(len(ids) // 4)
                texts.append(ids)
                size += len(ids) // 4
                if size >= segment:
                    yield give()
                    number, start, size = number + 1, start + size, 0
                    held, lengths, texts = [], [], []
        if held:
            yield give()

    map_arrow(ordered, run, SEGMENT_SCHEMA).write.parquet(path)


def starts(segments: DataFrame) -> DataFrame:
    """Ids before each part: one row for each part, not for each document or segment."""
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the files at `path`: doc_id, start, n_tokens, ids."""
    return _documents(spark, path, "ids array<int>", lambda ids: pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """As `read`, with the CRC-32 of the ids as little-endian 32-bit integers in place of the ids."""
    return _documents(spark, path, "ids_crc32 long", lambda ids: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()))


def _documents(spark: SparkSession, path: str, column: str, give) -> DataFrame:
    segments = spark.read.parquet(path)
    name = column.split()[0]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part, begin, payload = (batch.column(k)[row].as_py() for k in range(3))
                segment = Segment(payload)
                ids = segment.tokens()
                ends = np.cumsum(segment.lengths.astype(np.int64))
                first = ends - segment.lengths.astype(np.int64)
                # Random access by rank has to agree with reading in order, at the first id of each document.
                some = np.flatnonzero(segment.lengths)
                if not np.array_equal(segment.access(first[some]), ids[first[some]]):
                    raise ValueError(f"a segment of part {part} gives other ids by its rank directory")
                for k in range(0, len(ends), 1024):
                    some = slice(k, k + 1024)
                    found = [ids[a:b] for a, b in zip(first[some], ends[some], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(found), pa.int32()), pa.array(segment.doc_ids[some], mask=segment.present[some] == 0), pa.array(begin + first[some]), pa.array(segment.lengths[some].astype(np.int64)), give(found)],
                        names=["part", "doc_id", "inside", "n_tokens", name],
                    )

    found = map_arrow(segments.select("part", "part_start", "payload"), run, f"part int, doc_id long, inside long, n_tokens long, {column}")
    return found.join(starts(segments), "part").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", name)


def lookup(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """`places` (a column `place` of positions in the whole file) with the id there, reading single codes only.

    Places first find their segment by its range alone; then each segment with its different places, at most as many as it
    has ids, is read once. Places outside of the file give no row, repeated ones repeat.
    """
    segments = spark.read.parquet(path)
    ranges = segments.select("part", "segment", "part_start", "n_tokens").join(starts(segments), "part").select("part", "segment", (F.col("before") + F.col("part_start")).alias("low"), "n_tokens")
    # Positions and segments meet on a grid of SEGMENT ids; a segment lies in a few cells.
    cells = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / SEGMENT), F.floor((F.col("low") + F.col("n_tokens") - 1) / SEGMENT))))
    inside = (F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + F.col("n_tokens"))
    met = places.select("place").distinct().withColumn("cell", F.floor(F.col("place") / SEGMENT)).join(cells, "cell").where(inside).select("part", "segment", "place", "low")

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({"place": pa.array([], pa.int64()), "token": pa.array([], pa.int64())})
        inside = asked["place"].to_numpy() - asked["low"].to_numpy()
        return pa.table({"place": asked["place"], "token": pa.array(Segment(held["payload"][0].as_py()).access(inside).astype(np.int64))})

    ship(spark)
    held = spark.read.parquet(path).select("part", "segment", "payload")
    found = met.groupBy("part", "segment").cogroup(held.groupBy("part", "segment")).applyInArrow(run, "place long, token long")
    return places.select("place").join(found, "place")
