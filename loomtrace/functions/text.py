"""Text and resource expressions; all of them stay in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as V


def normal(text: Column) -> Column:
    """White space as single spaces, trimmed; null is empty."""
    return F.coalesce(F.trim(F.regexp_replace(text, V.SPACES, " ")), F.lit(""))


def cut_to(text: Column, limit: int) -> Column:
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 3), F.lit("...")))


def preview(text: Column, limit: int = 280) -> Column:
    return cut_to(normal(text), limit)


def line(text: Column, limit: int = 240) -> Column:
    """A preview without terminal escapes."""
    return preview(F.regexp_replace(text, V.ANSI, ""), limit)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def first_filled(*texts: Column) -> Column:
    """The first text that isn't blank, stripped; else empty."""
    return F.coalesce(*(F.nullif(strip(t), F.lit("")) for t in texts), F.lit(""))


def urls(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(V.URL), 1))


def paths(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(V.PATH), 1), lambda p: F.regexp_replace(p, r"""['".,)]+$""", "")))


def clean(resource: Column) -> Column:
    """Without blanks and quotes around it, slashes at its end and one `/*`."""
    bare = F.regexp_replace(F.regexp_replace(strip(resource), r"""^['"]+|['"]+$""", ""), "/+$", "")
    return F.when(bare.endswith("/*"), F.regexp_replace(F.regexp_replace(bare, r"/\*$", ""), "/+$", "")).otherwise(bare)


def has_any(text: Column, words: list[str]) -> Column:
    """Whether any of the words is a part of the text, in either case."""
    lowered = F.lower(text)
    return reduce(Column.__or__, [F.contains(lowered, F.lit(word.lower())) for word in words])


def starts_with_any(command: Column, prefixes: list[str]) -> Column:
    """Whether the stripped command starts with any prefix, word ends or not."""
    return strip(F.lower(command)).rlike("^(?:" + "|".join(map(re.escape, prefixes)) + ")")


def widens(user_paths: Column, action_paths: Column) -> Column:
    """Whether an action's path is a shorter beginning of one that the user named."""
    user, action = F.transform(user_paths, clean), F.transform(action_paths, clean)
    wider = lambda a: F.exists(user, lambda u: (u != "") & (a != u) & F.startswith(u, a) & (F.char_length(a) + 1 < F.char_length(u)))
    return F.exists(action, lambda a: (a != "") & wider(a))


def crosses(user_urls: Column, user_paths: Column, action_urls: Column, action_paths: Column) -> Column:
    """Whether an action's resources are others than the user named."""
    uu, up, au, ap = (F.transform(c, clean) for c in (user_urls, user_paths, action_urls, action_paths))
    inside = lambda a, b: F.startswith(a, F.concat(F.regexp_replace(b, "/+$", ""), F.lit("/")))
    apart = F.exists(ap, lambda a: ~F.exists(up, lambda u: inside(a, u) | inside(u, a)))
    return ((F.size(au) > 0) & ~F.arrays_overlap(au, uu)) | ((F.size(up) > 0) & (F.size(ap) > 0) & ~F.arrays_overlap(up, ap) & apart)


def redact(headers: Column) -> Column:
    """A map of headers with secret values replaced."""
    return F.transform_values(headers, lambda name, value: F.when(F.lower(name).isin(V.SECRET_HEADERS), F.lit("<redacted>")).otherwise(value))


def end_to_end(headers: Column) -> Column:
    """A map of headers without those of one hop."""
    return F.map_filter(headers, lambda name, _: ~F.lower(name).isin(V.HOP_HEADERS))


def seconds(iso: Column) -> Column:
    """Epoch seconds of an ISO timestamp, null if it is none."""
    return F.try_to_timestamp(iso).cast("double")


def iso_millis(epoch: Column) -> Column:
    utc = F.to_utc_timestamp(F.timestamp_millis(F.round(epoch * 1000).cast("long")), F.current_timezone())
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+00:00"))


def option(arguments: Column, flag: str) -> Column:
    """The value of `flag v` or `flag=v` in an array of arguments, the first of either."""
    place = F.array_position(F.transform(arguments, lambda a: (a == flag) | F.startswith(a, F.lit(f"{flag}="))), F.lit(True))
    found = F.get(arguments, (place - 1).cast("int"))
    return F.when(place == 0, None).when(found == flag, F.get(arguments, place.cast("int"))).otherwise(F.substring(found, F.lit(len(flag) + 2), F.char_length(found)))
