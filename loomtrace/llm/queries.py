"""One query for each operator, over its whole table with production settings, and SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.session import table

from . import balltree, bpe, dac, exact, lloyd, lm, mix, quality, quotes, runs, secrets, simhash, suffix
from .common import documents, scratch


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(documents(spark, sf_dir))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mix.copies(documents(spark, sf_dir))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(documents(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), decoded="decoded", keep_text=False)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(documents(spark, sf_dir))


def op7_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = quotes.conversations(table(spark, sf_dir, "conversations"))
    return linked.select("conv_id", "turn", "role", "text", "reply_to", "thread", "depth", "n_quotes", "n_linked", "n_elsewhere")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, secrets.BASE)
    return scanned.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(documents(spark, sf_dir))


def op10_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/token-ids-{uuid.uuid4().hex}"
    dac.write(documents(spark, sf_dir), path)
    return dac.checksums(spark, path)


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.top_k(table(spark, sf_dir, "embeddings"))


def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.clusters(table(spark, sf_dir, "embeddings"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", runs.looped(F.col("doc_id"), F.col("text")).alias("text"))
    return runs.digests(runs.detect(docs, keep_text=False))


QUERIES = {q.__name__: q for q in (op1_suffix, op2_mix, op3_quality, op4_bpe, op5_exact, op6_simhash, op7_quotes, op8_secrets, op9_lm, op10_dac, op11_topk, op12_lloyd, op13_runs)}
ORACLES = {
    "op5_exact": """
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
        FROM (SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, sha256(key) AS text_sha256
              FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM documents)
              WINDOW same AS (PARTITION BY key))
    """,
    "op7_quotes": quotes.SQL,
}
