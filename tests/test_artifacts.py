from pyspark.sql import functions as F

from loomtrace.sources import artifacts, store


def test_bodies_by_reference(spark, tmp_path):
    root = f"{tmp_path}/bodies"
    made = [(1, b'{"a": 1}', None), (2, b'{"a": 1}', "application/json"), (3, "line é\n\nline".encode(), "text/plain"), (4, b"\x00\xff\n", None), (5, b"", None), (6, None, "application/json"), (7, b"nothing", "application/json"), (8, b" [1]", "text/plain"), (9, b"x" * 100_000, None)]
    df = artifacts.exchanged(spark.createDataFrame(made, "id long, body binary, content_type string"))
    for _ in range(2):
        artifacts.keep(df, root)
    assert store.catalogue(spark, root).count() == 7 == store.read(spark, root).count()
    events = df.select("id", F.coalesce("raw_ref", "artifact").alias("raw_ref"), F.to_json("payload").alias("payload"))
    got = {r.id: (r.body if r.body is None else bytes(r.body), (r.raw_ref or "").split("/")[0], r.payload) for r in artifacts.fetched(events, root).collect()}
    assert got == {
        1: (b'{"a": 1}', "raw", '{"a":1}'), 2: (b'{"a": 1}', "raw", '{"a":1}'), 3: ("line é\n\nline".encode(), "artifacts", None), 4: (b"\x00\xff\n", "artifacts", None),
        5: (None, "", None), 6: (None, "", None), 7: (b"nothing", "artifacts", None), 8: (b" [1]", "raw", "[1]"), 9: (b"x" * 100_000, "artifacts", None),
    }
    assert artifacts.fetched(events.where("id = 3"), root).count() == 1


def test_references_that_lead_nowhere(spark, tmp_path):
    events = spark.createDataFrame([(1, "raw/" + "0" * 64 + ".json"), (2, "raw/x.json"), (3, None)], "id long, raw_ref string")
    assert [r.body for r in artifacts.fetched(events, f"{tmp_path}/none").collect()] == [None] * 3
