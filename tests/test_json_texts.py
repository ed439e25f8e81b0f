"""JSON text of expressions against Python's json.dumps."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from loomtrace.functions import values as J
from loomtrace.plans import cases, queries, report

LETTERS = ["a", "b", " ", ",", ":", '"', "\\", "/", "{", "[", "\n", "\t", "\x00", "\x0b", "\x1f", "\x7f", "é", " ", "\U0001f600", "1.50", "\\u001F", "u001F", "'", "$1"]


def number(draw):
    kinds = [
        lambda: draw.randrange(-100, 100), lambda: draw.randrange(-(10**45), 10**45), lambda: draw.uniform(-1000, 1000), lambda: float(draw.randrange(-20, 20)),
        lambda: struct.unpack("<d", struct.pack("<Q", draw.getrandbits(64) & ~(1 << 62)))[0], lambda: draw.choice([0.0, -0.0, 1e22, 1e23, 2e23, 1e16, 9999999999999998.0, 1e-4, 1e-5, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 123456789012345680.0, 0.1, 2e-3]),
        lambda: 10.0 ** draw.randrange(-30, 30) * draw.randrange(1, 1000),
    ]
    return draw.choice(kinds)()


def word(draw):
    return "".join(draw.choices(LETTERS, k=draw.randrange(6)))


def value(draw, depth=3):
    kind = draw.randrange(8 if depth else 5)
    if kind == 7:
        return {word(draw): value(draw, depth - 1) for _ in range(draw.randrange(4))}
    if kind >= 5:
        return [value(draw, depth - 1) for _ in range(draw.randrange(4))]
    return draw.choice([None, True, False, word(draw), word(draw), number(draw)])


def written(draw, value):
    """A value as some writer may have put it down."""
    return json.dumps(value, ensure_ascii=draw.random() < 0.5, separators=draw.choice([None, (",", ":")]))


def expected(line):
    plain = lambda v: json.dumps(v, ensure_ascii=False)
    ordered = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True)
    event = json.loads(line) if line else {}
    content = event.get("content") if isinstance(event.get("content"), dict) else {}
    get = content.get
    key = {"tool_name": get("tool_name"), "arguments": get("arguments"), "event_type": event.get("event_type")}
    said = get("output") or get("text") or get("error") or get("result")
    return {
        "arguments": plain(get("arguments")), "sorted_arguments": ordered(get("arguments")), "key": ordered(key), "output": plain(get("result") or content),
        "sorted_output": ordered(said), "targets": plain(get("targets")), "result": plain(get("result")),
    }


def finite(value):
    text = json.dumps(value)
    return "NaN" not in text and "Infinity" not in text


@pytest.mark.parametrize("seed", [1, 2])
def test_texts_of_event_lines(spark, seed):
    draw, lines = random.Random(seed), [None, "{}", '{"content": null}', '{"content": [1.0]}', '{"content": {}}', '{"content": {"result": 0.0, "output": -0.0}}', '{"content":{"arguments":1E400,"result":[-1e999]}}']
    while len(lines) < 1500:
        content = {name: value(draw) for name in ("arguments", "output", "text", "error", "result", "targets", "tool_name", "z", "a") if draw.random() < 0.6}
        event = {"event_type": value(draw, 0), "content": content if draw.random() < 0.95 else value(draw)}
        if finite(event):
            lines.append(written(draw, event))
    rows = spark.createDataFrame(list(enumerate(lines)), "n int, raw string")
    found = {n: texts.asDict() for n, texts in J.with_texts(rows).select("n", "json").collect()}
    for n, line in enumerate(lines):
        assert found[n] == expected(line), line


def test_floats(spark):
    draw = random.Random(7)
    values = [x for x in (float(number(draw)) for _ in range(4000)) if abs(x) < float("inf")] + [k * 5e-324 for k in range(1, 50)]
    texts = [draw.choice(["%r", "%.17e", "%.20f" if abs(x) > 1e-3 else "%r", "%.16E"]) % x for x in values]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts) if set(t) & set(".eE")], "n int, t string")
    for n, text, got in df.select("n", "t", J.python_float(F.col("t"))).collect():
        assert got == repr(float(text)), text
        assert texts[n] == text


def test_long_texts(spark):
    """Strings and lists of millions of characters are read in one pass, without recursion."""
    long = {"a": 'x\\",:"' * 400_000, "b": [1.5, "y:z"] * 50_000}
    got = spark.createDataFrame([(json.dumps(long, separators=(",", ":")),)], "t string").select(J.python_json(F.col("t"))).first()[0]
    assert got == json.dumps(long)


@pytest.mark.parametrize("name", ["case_extraction", "case_review", "session_report"])
def test_no_python_for_texts(spark, data, name, monkeypatch):
    """Neither in the plan of a query nor in those of the tables that it writes on its way."""
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().toString())
    for module in (cases, report):
        monkeypatch.setattr(module, "cut", lambda df, *more, written=module.cut: plan(df) or written(df, *more))
    plan(queries.QUERIES[name](spark, data))
    assert len(plans) > 1
    assert not [p for p in plans if "EvalPython" in p]
