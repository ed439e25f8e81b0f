import zlib

import numpy as np
import public_tokenizers
from fixtures import SCHEMA, extra, ordered, rows, table
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomtrace.llm import dac, queries


#: The library as it comes, not the operator's encoder.
FRESH = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ADDED = ["see <|endoftext|> here", "<|endoftext|>", " <|endoftext|><|endoftext|>  x", "a <|endoftext|", "of<|endoftext|>of of", "of of"]


def whole(text):
    return [*FRESH.encode(text or "", add_special_tokens=False).ids, 0]


def test_query(spark, tmp_path):
    made = rows() + [(700 + k, text, "en", "a", 1) for k, text in enumerate(ADDED)]
    table(spark, made).write.parquet(f"{tmp_path}/documents.parquet")
    want, start = [], 0
    for m in sorted(made, key=lambda m: (m[0] is not None, m[0] or 0, m[1] is not None, (m[1] or "").encode())):
        ids = whole(m[1])
        want.append((m[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert ordered(queries.op10_dac(spark, str(tmp_path)), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)


def test_files_and_random_access(spark, tmp_path):
    made = [r for r in rows() if r[0] is not None][:50]
    path = f"{tmp_path}/ids"
    dac.write(extra(spark, made), path, segment=500)
    read = dac.read(spark, path).orderBy("start").collect()
    assert [(r.doc_id, r.ids) for r in read] == [(m[0], whole(m[1])) for m in sorted(made)]
    flat = [t for r in read for t in r.ids]
    places = spark.createDataFrame([(k,) for k in range(0, len(flat), 97)], "place long")
    assert sorted(map(tuple, dac.lookup(spark, path, places).collect())) == [(k, flat[k]) for k in range(0, len(flat), 97)]
    dac.write(spark.createDataFrame([], SCHEMA), f"{tmp_path}/none")
    assert dac.checksums(spark, f"{tmp_path}/none").count() == 0


@given(st.lists(st.integers(0, 2**32 - 1), max_size=3000))
def test_codes(ids):
    segment = dac.Segment(dac.pack([1], [len(ids)], np.array(ids, np.uint32)))
    assert segment.tokens().tolist() == ids
    assert segment.access(np.arange(len(ids))).tolist() == ids


@settings(deadline=None)  # the first texts wait for the vocabulary
@given(st.lists(st.text(st.sampled_from("ab'ts 1é\n\t.,#\u00a0\u200b\x1c数"), max_size=40), max_size=8))
def test_words_have_the_ids_of_the_whole_text(texts):
    encoder = dac.encoder(dac.default_vocabulary())
    for some in (texts, [*texts, *ADDED]):
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(some)] == [whole(t)[:-1] for t in some]
