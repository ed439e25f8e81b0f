"""Values of any JSON type: variants, and JSON text as Python writes it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FALSY = ['""', "false", "0", "[]", "{}", "null"]


def keep(value: Column, test: Callable[[Column], Column]) -> Column:
    """The value where the test holds, else null. The value is named twice, so it should be a column or one field of it."""
    return F.when(test(value), value)


def field(value: Column | str, path: str) -> Column:
    """A field as a variant; null where it is missing or JSON's null."""
    return keep(F.try_variant_get(value, path, "variant"), lambda v: ~F.is_variant_null(v))


def parts(value: Column | str, *names: str) -> Column:
    """These fields of an object as a struct of variants, read in one pass; null for what is no object."""
    return F.try_variant_get(value, "$", "struct<" + ", ".join(f"`{name}`: variant" for name in names) + ">")


def opened(rows: DataFrame, value: str, name: str, *fields: str) -> DataFrame:
    """`rows` with the fields of the variant column `value` in the struct column `name`, where JSON's null is null too.
    A value that is no object has no struct."""
    read = [f"`{c}`" for c in rows.columns if c != name]
    found = rows.select(*read, parts(value, *fields).alias(name))
    some = F.struct(*[keep(F.col(f"{name}.`{f}`"), lambda v: ~F.is_variant_null(v)).alias(f) for f in fields])
    return found.select(*read, F.when(F.col(name).isNotNull(), some).alias(name))


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def text_of(value: Column) -> Column:
    """A variant that is a string; null for other types, which a plain cast would turn into text."""
    return F.when(kind(value) == "STRING", value.cast("string"))


def string(value: Column | str, path: str = "$") -> Column:
    return text_of(F.try_variant_get(value, path, "variant"))


def filled(value: Column | str, path: str = "$") -> Column:
    return F.nullif(string(value, path), F.lit(""))


def truthy(value: Column) -> Column:
    """The variant, null if it counts as false."""
    return keep(value, lambda v: ~F.to_json(v).isin(FALSY))


def items(value: Column, path: str = "$") -> Column:
    """A list field as an array of variants; null for other types."""
    return F.try_variant_get(value, path, "array<variant>")


def is_object(value: Column) -> Column:
    # A schema would be made of all that is in it.
    return parts(value, "type").isNotNull()


def parsed(value: Column) -> Column:
    """A string that is JSON as what it says; everything else as it is."""
    return F.coalesce(F.try_parse_json(text_of(value)), value)


def shown_or_null(value: Column) -> Column:
    """A value as a template shows it: text as it is, True and False; other values as JSON."""
    return F.coalesce(text_of(value), F.when(kind(value) == "BOOLEAN", F.initcap(F.to_json(value))), F.to_json(value))


def shown(value: Column) -> Column:
    return F.coalesce(shown_or_null(value), F.lit("None"))


def or_mark(value: Column, mark: str = "?") -> Column:
    return F.coalesce(shown_or_null(truthy(value)), F.lit(mark))


#: A whole string of a JSON text; parts of it are never tried again, so texts of any length are read in one pass.
STRING = r'"(?:[^"\\]++|\\.)*+"'
#: A number that Spark would write in another way: with a point or an exponent, or longer than any long.
ODD = rf'(?s)^(?:[^"0-9]++|{STRING}|[0-9]{{1,18}}+(?![.eE0-9]))*+[0-9]'
NUMBER = "-?[0-9]+(?:[.][0-9]+)?(?:[eE][-+]?[0-9]+)?"
#: How such numbers are kept as strings meanwhile, as JSON text has it.
MARK = "\\u0001"


def python_float(text: Column) -> Column:
    """A number's text as Python writes the float it means: the fewest digits that give the same float again."""
    value = text.cast("double")
    # Subnormal floats may need fewer than 15 digits; of others no two numbers of 15 digits are the same float.
    places = F.sequence(F.when(F.abs(value) < 2.3e-308, 0).otherwise(14), F.lit(16))
    tried = F.filter(F.transform(places, lambda k: F.call_function("format_string", F.concat(F.lit("%."), k.cast("string"), F.lit("e")), value)), lambda t: t.cast("double") == value)
    short = F.regexp_replace(F.get(tried, F.lit(0)), "[.]?0+e", "e")
    plain = F.regexp_replace(short.cast("decimal(38,21)").cast("string"), "([.][0-9]+?)0+$", "$1")
    size = F.regexp_extract(short, "e(.*)", 1).cast("int")
    whole = F.when(size.between(-4, 15), plain).otherwise(short)
    zero = F.when(F.startswith(text, F.lit("-")), "-0.0").otherwise("0.0")
    infinite = F.when(value > 0, "Infinity").otherwise("-Infinity")
    return F.when(value == 0, zero).when(F.abs(value) == float("inf"), infinite).otherwise(whole)


def marked(text: Column) -> Column:
    """JSON text in which numbers that Spark would write in another way than Python are strings that hold Python's form."""
    number = lambda t: F.when(t.rlike("[.eE]"), python_float(t)).otherwise(t)
    odd = lambda t: t.rlike("^-?[0-9]") & (t.rlike("[.eE]") | (F.length(t) > 18))
    parts = F.regexp_extract_all(text, F.lit(rf'(?s){STRING}|{NUMBER}|[^"0-9-]++|.'), F.lit(0))
    told = F.transform(parts, lambda t: F.when(odd(t), F.concat(F.lit(f'"{MARK}'), number(t), F.lit(f'{MARK}"'))).otherwise(t))
    return F.when(text.rlike(ODD), F.array_join(told, "")).otherwise(text)


def wide(text: Column) -> Column:
    """Compact JSON text with Python's space after commas and colons."""
    return F.regexp_replace(text, rf'(?s)\G((?:[^",:]++|{STRING})*+[,:])', "$1 ")


def escaped(text: Column) -> Column:
    """JSON text with numbers that are `marked` as numbers, and with Python's escapes: in small letters, and none for
    characters beyond 16 bits. The text is named twice."""
    pair = r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}"
    pieces = F.regexp_extract_all(F.regexp_replace(text, r'"\\u0001([-+.0-9eInfity]++)\\u0001"', "$1"), F.lit(rf"(?s){pair}|\\u[0-9A-Fa-f]{{4}}|\\.|[^\\]++"), F.lit(0))
    sign = lambda t: F.get_json_object(F.concat(F.lit('{"a":"'), t, F.lit('"}')), "$.a")
    own = F.transform(pieces, lambda t: F.when(t.rlike(pair), sign(t)).when(F.startswith(t, F.lit("\\u")), F.lower(t)).otherwise(t))
    return F.when(F.contains(text, F.lit("\\u")), F.array_join(own, "")).otherwise(text)


def python_json(text: Column) -> Column:
    """Compact JSON text as Python's json.dumps without ensure_ascii writes its value, keys in the order they have."""
    return escaped(wide(marked(text)))


def with_texts(rows: DataFrame, raw: str = "raw", name: str = "json", only: Column | dict[str, Column] | None = None, value: str | None = None) -> DataFrame:
    """`rows` with what to_json can't say in the struct column `name`: parts of the content of an event line with Python's
    separators and numbers, in the line's order (arguments, targets, result, output) and with sorted keys (sorted_arguments, key, sorted_output).

    `key` is the identity of an action without a call id, `output` the result or else the whole content. A null line
    and a content that is no object count as empty. Keys are sorted by UTF-16 units. A string that holds nothing but a
    number between two U+0001 is shown as that number; of a key that an object has twice, the line's order shows both.
    Texts are made of rows for which `only` holds; others have nulls. `only` may name the texts that are wanted, each with its rows; then there are no others.
    `value` is the line parsed, if there is one: it isn't parsed again but for numbers that Spark would write in another way. It goes.
    """
    every = ("arguments", "sorted_arguments", "targets", "result", "output", "sorted_output", "key")
    wanted = only if isinstance(only, dict) else dict.fromkeys(every, F.lit(True) if only is None else only)
    rows = rows.withColumns({f"_only_{field}": F.coalesce(test, F.lit(False)) for field, test in wanted.items()})
    own = [f"`{c}`" for c in rows.columns if c != name]
    part = lambda field: F.col(f"_c.`{field}`")
    nested = lambda value: F.coalesce(kind(value).rlike("^(OBJECT|ARRAY)"), F.lit(False))
    there = lambda value: F.coalesce(F.to_json(value), F.lit("null"))
    told = lambda field: F.when(nested(part(field)), F.get_json_object("_line", f"$.content.{field}")).otherwise(there(part(field)))
    # No number that counts as false is marked but zeros.
    true = lambda value: keep(value, lambda v: ~F.to_json(v).isin([*FALSY, *(f'"{MARK}{zero}{MARK}"' for zero in ("0.0", "-0.0"))]))
    some = reduce(Column.__or__, [F.col(f"_only_{field}") for field in wanted])
    own = [c for c in own if c != f"`{value}`"]
    lines = rows.select(*own, *([value] if value else []), marked(F.when(some, F.col(raw))).alias("_line"))
    whole = F.try_parse_json("_line")
    if value:
        whole = F.when(F.col("_line") != F.col(raw), whole).otherwise(F.when(F.col("_line").isNotNull(), F.col(value)))
    fields = ("arguments", "tool_name", "output", "text", "error", "result", "targets")
    if wanted.keys() & {"output"}:
        read = lines.select(*own, "_line", parts(whole, "content", "event_type").alias("_e"))
        read = read.select(*own, "_line", F.col("_e.event_type").alias("_type"), F.col("_e.content").alias("_content"), is_object(F.col("_e.content")).alias("_object"))
        read = opened(read, "_content", "_c", *fields)
    else:
        read = lines.select(*own, "_line", F.try_variant_get(whole, "$", f"struct<event_type: variant, content: struct<{', '.join(f'{f}: variant' for f in fields)}>>").alias("_e"), F.lit(False).alias("_object"))
        read = read.select(*own, "_line", "_object", F.col("_e.event_type").alias("_type"), F.struct(*[keep(F.col(f"_e.content.{f}"), lambda v: ~F.is_variant_null(v)).alias(f) for f in fields]).alias("_c"))
    whole = F.when(F.col("_object"), F.get_json_object("_line", "$.content")).otherwise("{}")
    texts = {
        "arguments": told("arguments"), "sorted_arguments": there(part("arguments")), "targets": told("targets"), "result": told("result"), "_type": there(F.col("_type")), "_tool": there(part("tool_name")),
        "output": F.when(true(part("result")).isNotNull(), told("result")).otherwise(whole), "sorted_output": there(F.coalesce(*[true(part(field)) for field in ("output", "text", "error")], part("result"))),
    }
    # What a text is wanted for: the key is made of three.
    of = lambda field: reduce(Column.__or__, [F.col(f"_only_{w}") for w in wanted if w == field or w == "key" and field in ("sorted_arguments", "_type", "_tool")])
    texts = {field: text for field, text in texts.items() if field in wanted or "key" in wanted and field in ("sorted_arguments", "_type", "_tool")}
    # Each step names texts more than once, so that each is a step of its own.
    made = read.select(*own, *[F.when(of(field), wide(text)).alias(f"_t_{field}") for field, text in texts.items()])
    made = made.select(*own, *[escaped(F.col(f"_t_{field}")).alias(f"_t_{field}") for field in texts])
    shown = {field: F.col(f"_t_{field}") for field in texts if field in wanted}
    if "key" in wanted:
        shown["key"] = F.when(F.col("_only_key"), F.concat(F.lit('{"arguments": '), "_t_sorted_arguments", F.lit(', "event_type": '), "_t__type", F.lit(', "tool_name": '), "_t__tool", F.lit("}")))
    return made.select(*own, F.struct(*[text.alias(field) for field, text in shown.items()]).alias(name)).drop(*[f"_only_{field}" for field in wanted])
