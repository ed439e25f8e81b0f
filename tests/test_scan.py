"""The segmented scans against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import events as E
from loomtrace.operators import scan


def logs(seed, sessions=6, most=120):
    draw, made = random.Random(seed), []
    for s in (*range(sessions), None):
        for k in range(draw.randrange(most)):
            made.append((None if s is None else f"s{s}", k, draw.choice("mpax"), draw.choice(["a", "b", "c", "d", "e", None])))
    return made


def plainly(made, most):
    found, held = [], {}
    for s, k, kind, key in sorted(made, key=lambda r: (repr(r[0]), r[1])):
        if kind == "a":
            for name in "mp":
                last = held.get((s, name), [])
                found += [(s, k, name, place, at) for place, (_, at) in enumerate(reversed(last[-most:]), 1)]
        if kind in "mp":
            last = held.setdefault((s, kind), [])
            last[:] = [x for x in last if x[0] != key] + [(key, k)]
    return sorted(found, key=repr)


@pytest.mark.parametrize(("seed", "chunk", "levels", "most"), [(1, 4, 1, 2), (2, 3, 3, 4), (3, 1000, 1, 3), (4, 2, 0, 1), (5, 5, 2, 9)])
def test_last_different(spark, seed, chunk, levels, most):
    made = logs(seed)
    df = spark.createDataFrame(made, "session string, pos long, what string, key string").repartition(5)
    rows = df.select("session", "pos", F.when(F.col("what").isin("m", "p"), F.col("what")).alias("kind"), "key", (F.col("what") == "a").alias("asks"))
    found = scan.last_different(rows, most, chunk, levels).select("session", "asked", "kind", "place", "pos").collect()
    assert sorted(map(tuple, found), key=repr) == plainly(made, most)


def test_rows_that_ask_and_are_asked_for(spark):
    """A row finds what is before it, not itself."""
    df = spark.createDataFrame([("s", k, "m", str(k % 3)) for k in range(20)], "session_id string, event_index long, event_type string, key string")
    every = F.col("event_type") == "m"
    found = sorted((r.asked, r.place, r.event_index) for r in E.recent_unique(df, every, every, "key", [], 2, chunk=4).collect())
    assert found == sorted((k, place, k - place) for k in range(20) for place in (1, 2) if k >= place)
    since = df.withColumn("since", F.when(F.col("event_index") > 10, F.lit(10)))
    near = sorted((r.asked, r.event_index) for r in E.latest_since(since, every, F.col("event_index") % 6 == 0, "since", ["key"], 3, chunk=4).collect())
    assert near == [(6, 3), (6, 4), (6, 5), (12, 11), (18, 15), (18, 16), (18, 17)]


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_carry(spark, chunk):
    draw, made = random.Random(chunk), []
    for s in ("a", "b", None):
        made += [(s, k, draw.choice([None, None, None, k]), draw.choice([None, None, str(k)])) for k in range(draw.randrange(5, 50))]
    df = spark.createDataFrame(made, "s string, k long, v long, w string").repartition(4)
    got = {(r.s, r.k): (r.last_v, r.last_w, r.first_v) for r in scan.carry(df, {"last_v": F.col("v"), "last_w": F.col("w")}, {"first_v": F.col("v")}, ("s",), "k", chunk).collect()}
    want, held = {}, {}
    for s, k, v, w in made:
        last_v, last_w, first_v = held.get(s, (None, None, None))
        held[s] = want[s, k] = (last_v if v is None else v, last_w if w is None else w, v if first_v is None else first_v)
    assert got == want


def test_no_rows(spark):
    none = spark.createDataFrame([], "session_id long, event_index long, event_type string, key string")
    assert E.recent_unique(none, F.col("event_type") == "m", F.col("event_type") == "a", "key", ["key"], 4).count() == 0


def test_one_long_session_takes_linear_time_and_many_tasks(spark):
    """Messages of three texts and as many actions, all in one session: twice the rows take about twice the time."""

    def seconds(n):
        rows = spark.range(n).select(F.lit("s").alias("session_id"), F.col("id").alias("event_index"), F.when(F.col("id") % 2 == 0, "m").otherwise("a").alias("event_type"), (F.col("id") % 3).cast("string").alias("key"))
        found = scan.last_different(rows.select(F.col("session_id").alias("session"), F.col("event_index").alias("pos"), F.when(F.col("event_type") == "m", "").alias("kind"), "key", (F.col("event_type") == "a").alias("asks")), 4)
        began = time.time()
        told = found.agg(F.count("*").alias("n"), F.max("place").alias("place"), F.sum(F.col("asked") - F.col("pos")).alias("gap")).first()
        assert told.n == 3 * (n // 2) - 3 and told.place == 3
        return time.time() - began

    seconds(1000)
    small, large = seconds(100_000), seconds(400_000)
    assert large < 8 * small + 5
