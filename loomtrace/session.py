"""Session helpers that the whole library uses."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Bytes of an Arrow batch that goes to a Python worker, where the session sets none: rows can be long texts.
BATCH, DEFAULT_BATCH, OWN_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b"


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started, and bound what they get at once."""
    if spark.conf.get(BATCH, OWN_BATCH) == DEFAULT_BATCH:
        spark.conf.set(BATCH, OWN_BATCH)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


#: Bytes of a generated method beyond which HotSpot never compiles it, but interprets it for good; Spark's own limit is what a class file can hold.
HUGE, COMPILED = "spark.sql.codegen.hugeMethodLimit", "8000"


def compiled(spark: SparkSession) -> SparkSession:
    """Let wide expressions run as several methods that the JVM compiles, where the session doesn't set this itself."""
    if spark.conf.get(HUGE, "65535") == "65535":
        spark.conf.set(HUGE, COMPILED)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, of spark.checkpoint.dir.

    Only where that is unset and everything runs on one machine (tests, a laptop) a local folder takes its place.
    """
    context = ship(spark).sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomtrace-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Write `df` as a table in the shared folder and go on from the written copy.

    The lineage ends there, so a lost executor costs only the tasks at work; the
    copy has no partitioning of its own, so Spark may split skewed keys of joins on it.
    The copy `instead_of` which it was made, if any, is removed: a round of a loop follows the one before.
    """
    path = f"{scratch(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if instead_of is not None:
        remove(df.sparkSession, instead_of.cut_path)
    copy = df.sparkSession.read.schema(df.schema).parquet(path)
    copy.cut_path = path
    return copy


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
