"""Bodies of HTTP messages: JSON or server-sent events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_body(body: Column, content_type: Column) -> Column:
    """The body as a variant if its type says JSON or it starts like JSON; else null."""
    like = F.coalesce(F.contains(F.lower(content_type), F.lit("json")), F.lit(False)) | body.rlike(r"^\s*[{\[]")
    return F.when(like, F.try_parse_json(body))


def blocks(body: Column) -> Column:
    """The event blocks of a stream as an array of (event, raw_data); line ends may be LF or CRLF."""

    def block(text: Column) -> Column:
        lines = F.split(text, "\n")
        name = lambda line: F.trim(F.substr(line, F.lit(7)))
        events = F.transform(F.filter(lines, lambda line: F.startswith(line, F.lit("event:"))), name)
        data = F.transform(F.filter(lines, lambda line: F.startswith(line, F.lit("data:"))), lambda line: F.trim(F.substr(line, F.lit(6))))
        return F.struct(F.element_at(F.when(F.size(events) > 0, events), -1).alias("event"), F.trim(F.array_join(data, "\n")).alias("raw_data"))

    parts = F.filter(F.split(F.regexp_replace(body, "\r\n", "\n"), "\n\n"), lambda part: part.rlike(r"\S"))
    return F.transform(parts, block)


def stream_events(bodies: DataFrame, body: str = "body") -> DataFrame:
    """One row for each block: the other columns, block, event, raw_data and data (a variant where the text is JSON)."""
    rest = [f"`{name}`" for name in bodies.columns if name != body]
    found = bodies.select(*rest, F.posexplode(blocks(F.col(body))).alias("block", "_b"))
    return found.select(*rest, "block", "_b.event", "_b.raw_data", F.try_parse_json("_b.raw_data").alias("data"))
