"""A training-corpus pipeline: five operators of the llm subpackage, one after another.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and
returns the columns of `documents`; the last adds the token ids. A stage is
written as Parquet in the shared folder and read again before the next one.
Null texts fail the quality rules. Rows that repeat become one in exact dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm import bpe, exact, mix, quality, simhash
from loomtrace.llm.common import cut, documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.dedup(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix.mixed(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, decoded again in the same pass; a text that doesn't come back from its ids stops the run."""
    both = bpe.encode(docs, decoded="_decoded")
    back = F.col("_decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return both.withColumn("ids", F.when(back, F.col("ids")).otherwise(F.raise_error(F.lit("token ids don't decode to their text")))).drop("_decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]
#: The robust covariance estimate and the cube method are iterative; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
