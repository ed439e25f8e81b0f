"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Null and empty texts have no tokens. Texts longer than `PIECE` characters are
cut where a space, tab or newline follows a letter or digit. No match of the
splitting pattern crosses such a place and none looks behind it, so the ids are
those of the whole text. Rows that repeat stay repeated; extra columns stay.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_arrow

#: Characters from which a text is cut before it is encoded.
PIECE = 1 << 16
#: Rows of a batch that are given out together.
ROWS = 256
SAFE = re.compile(r"(?<=[^\W_])(?=[ \n\t])")


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The encoder of a rank file, loaded once by each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE) -> list[str]:
    """`text` cut at safe places at least `size` characters apart."""
    pieces, start = [], 0
    while len(text) - start > size:
        place = SAFE.search(text, start + size)
        if not place:
            break
        pieces.append(text[start : place.start()])
        start = place.start()
    return [*pieces, text[start:]]


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, ids: str = "ids", decoded: str | None = None, keep_text: bool = True) -> DataFrame:
    """`docs` with the token ids of `text` in the column `ids` (replaced if it is there).

    With `decoded`, the bytes that the ids decode to are in that column, from the same pass over the rows.
    """
    path, split = ranks or default_ranks()[0], pattern or default_ranks()[1]
    docs = docs.drop(ids, *filter(None, [decoded]))
    at = docs.columns.index("text")
    rest = [k for k in range(len(docs.columns)) if k != at or keep_text]

    def run(batches):
        codec = encoding(path, split)
        for batch in batches:
            # Few rows at a time: the ids of a batch are never all in memory at once.
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                values, offsets, texts = [], [0], []
                for text in part.column(at):
                    tokens = [token for piece in safe_pieces(text.as_py() or "") for token in codec.encode_ordinary(piece)]
                    values.append(np.array(tokens, np.int32))
                    offsets.append(offsets[-1] + len(tokens))
                    if decoded:
                        texts.append(codec.decode_bytes(tokens))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*values, np.empty(0, np.int32)])))
                more = {ids: lists} | ({decoded: pa.array(texts, pa.binary())} if decoded else {})
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in rest), *more.values()], names=[*(part.schema.names[k] for k in rest), *more])

    added = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)] + [T.StructField(d, T.BinaryType()) for d in [decoded] if d]
    return map_arrow(docs, run, T.StructType([*(docs.schema.fields[k] for k in rest), *added]))


def decode(encoded: DataFrame, ranks: str | None = None, pattern: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`encoded` with the bytes of its ids in the column `decoded`; null ids give no bytes."""
    path, split = ranks or default_ranks()[0], pattern or default_ranks()[1]
    encoded = encoded.drop(decoded)
    at = encoded.columns.index(ids)

    def run(batches):
        codec = encoding(path, split)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                texts = [codec.decode_bytes(tokens.as_py() or []) for tokens in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, decoded])

    return map_arrow(encoded, run, T.StructType([*encoded.schema.fields, T.StructField(decoded, T.BinaryType(), True)]))
