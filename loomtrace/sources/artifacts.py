"""Bodies, texts and snapshots kept by the digest of their bytes, and events that hold only a reference to them.

A reference says what the artifact is (`raw`, `artifacts` or `snapshots`) and names its digest, so equal bodies are kept
once however many events refer to them, and writing one again changes nothing. They are lines of a store (see `store`),
whose index leads to each of them; a digest takes the place of a session. Bodies may be text or bytes of any length that a
row can have; null bodies have no reference, empty ones are bodies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .bodies import json_body

DIGEST = r"/([0-9a-f]{64})\.[a-z]+$"


def reference(body: Column, kind: str = "raw", suffix: str | Column = "json") -> Column:
    """What an event holds in place of a body; null for none."""
    return F.concat(F.lit(f"{kind}/"), F.sha2(body.cast("binary"), 256), F.lit("."), suffix if isinstance(suffix, Column) else F.lit(suffix))


def keep(bodies: DataFrame, root: str, body: str = "body", commit: str | None = None) -> None:
    """Keep the bodies of a table that aren't kept yet."""
    found = bodies.where(F.col(body).isNotNull()).select(F.sha2(F.col(body).cast("binary"), 256).alias("session_id"), F.translate(F.base64(F.col(body).cast("binary")), "\r\n", "").alias("value")).dropDuplicates(["session_id"])
    there = store.entries(bodies.sparkSession, root).select("session_id")
    store.write(found.join(there, "session_id", "left_anti").select("session_id", F.lit(0).alias("at"), "value"), root, commit)


def fetched(events: DataFrame, root: str, ref: str = "raw_ref", body: str = "body") -> DataFrame:
    """`events` with the bytes that they refer to, null where there are none. Only what is referred to is read, once each."""
    named = events.withColumn("_digest", F.regexp_extract(F.coalesce(ref, F.lit("")), DIGEST, 1))
    wanted = named.where("_digest <> ''").select(F.col("_digest").alias("session_id"))
    kept = store.read(events.sparkSession, root, only=wanted).where("line_index = 0").select(F.col("session_id").alias("_of"), F.unbase64("value").alias(body))
    return named.drop(body).join(kept, F.col("_digest") == F.col("_of"), "left").drop("_digest", "_of")


def exchanged(messages: DataFrame) -> DataFrame:
    """Requests or responses (body, content_type, and any other columns) with raw_ref of those that are JSON, artifact of
    those that are not, and payload, the parsed body: by its type, or by its first character."""
    text = F.col("body").cast("string")
    found = messages.withColumn("payload", json_body(text, F.col("content_type")))
    there = F.octet_length(F.col("body").cast("binary")) > 0
    return found.withColumns({"raw_ref": F.when(F.col("payload").isNotNull(), reference(F.col("body"))), "artifact": F.when(F.col("payload").isNull() & there, reference(F.col("body"), "artifacts", "bin"))})
