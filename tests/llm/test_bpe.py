import hashlib

from fixtures import SCHEMA, extra, ordered, rows, table

from loomtrace.llm import bpe, queries


def whole(text):
    return bpe.encoding(*bpe.default_ranks()).encode_ordinary(text or "")


def test_ids_and_bytes_of_every_row(spark):
    made = rows()
    coded = bpe.decode(bpe.encode(table(spark, made))).collect()
    assert sorted((repr((r.doc_id, r.text)), r.ids) for r in coded) == sorted((repr((m[0], m[1])), whole(m[1])) for m in made)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in coded)


def test_pieces_change_nothing():
    text = "don't stop, 12 apples\n\n  and  spaces\tétait là… 😀 " * 40
    assert [t for piece in bpe.safe_pieces(text, 50) for t in whole(piece)] == whole(text)
    assert "".join(bpe.safe_pieces(text, 50)) == text and len(bpe.safe_pieces(text, 50)) > 20


def test_extra_columns_and_empty_table(spark):
    coded = bpe.decode(bpe.encode(extra(spark, rows()[:9])))
    assert coded.columns.count("ids") == 1 and coded.count() == 9
    assert bpe.decode(bpe.encode(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query(spark, tmp_path):
    made = rows()
    table(spark, made).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for m in made:
        ids = whole(m[1])
        want.append((m[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((m[1] or "").encode()).hexdigest()))
    assert ordered(queries.op4_bpe(spark, str(tmp_path)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
