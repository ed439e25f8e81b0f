"""What several operators share: reading, cutting lineage, row-wise Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomtrace.session import cut, remove, scratch, ship, table  # noqa: F401  for the operators

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def packed_row(df: DataFrame, *names: str) -> DataFrame:
    """These columns of `df` by their names, and `row`: all columns of it as one struct, so that no name of its own can clash."""
    return df.select(*names, F.struct(*[f"`{name}`" for name in df.columns]).alias("row"))


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def lower_ascii(text: str) -> str:
    """Lower-case A-Z only."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
