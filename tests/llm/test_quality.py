import re

import numpy as np
from fixtures import SCHEMA, extra, ordered, rows, table

from pyspark.sql import functions as F

from loomtrace.llm import quality, queries


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    covered = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def prose(draw, size):
    return " ".join("".join(draw.choice(list("etaoinshrd"), draw.integers(2, 9))) for _ in range(size))


def test_base_statistics(spark, tmp_path):
    made = rows()
    table(spark, made).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for m in made:
        s = brute(m[1])
        want.append((m[0], *s, s[0] < 50 or 100 * s[4] > 50 * s[0]))
    found = queries.op3_quality(spark, str(tmp_path))
    assert ordered(found, "doc_id", *quality.STATISTICS, "base_failed") == sorted(want, key=repr)
    assert found.where("base_failed and kept").count() == 0 and found.where("kept is null").count() == 0


def test_outliers_go_and_clean_texts_stay(spark):
    draw = np.random.default_rng(5)
    made = []
    for n in range(900):
        text = prose(draw, 200)
        junk = n % 6 == 5
        made.append((n, text.replace(" ", "### ") if junk else text, ["en", "de"][n % 2], "a" if n % 5 else f"rare{n}", 1))
    found = quality.verdicts(table(spark, made)).collect()
    assert all(r.kept == (r.doc_id % 6 != 5) for r in found)
    again = quality.verdicts(table(spark, made, 7)).collect()
    assert sorted(found) == sorted(again)
    good = quality.good(extra(spark, made))
    assert good.columns == extra(spark, made[:1]).columns
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in found if r.kept)


def brute_mcd(x):
    """The starts, steps and the least determinant over all vectors of a cell at once, in numpy."""
    ridge = np.diag(np.array(list(quality.FLOORS.values()), float) ** 2)
    q = np.percentile(x, [25, 50, 75], axis=0)
    median, scale = q[1], np.sqrt(((q[2] - q[0]) / 1.349) ** 2 + ridge.diagonal())
    z = (x - median) / scale
    tanh, sign = np.round(1000 * np.tanh(z)), np.round(1000 * z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None])
    held = []
    for matrix in (np.eye(4), np.cov(tanh.T, bias=True), sign.T @ sign / len(x), np.eye(4)):
        spread = np.sqrt(np.maximum(np.diag(matrix), 1e-6))
        held.append((np.inf, median, np.linalg.inv(np.outer(scale, scale) * matrix / np.outer(spread, spread) + 1e-6 * ridge)))
    for start, now in enumerate(held, 1):
        falls, step = True, -1
        while falls:
            (last, mean, inverse), step = now, step + 1
            d = np.round(16 * np.log2(1 + np.maximum(np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean), 0)))
            share = quality.HALF if start == 4 and step == 0 else quality.KEEP
            near = x[d <= np.sort(d)[int(np.ceil(share * len(x) - 1e-9)) - 1]]
            covariance = np.cov(near.T, bias=True) + ridge
            new = (np.linalg.det(covariance), near.mean(0), np.linalg.inv(covariance))
            falls = new[0] < last
            now = new if falls else now
        held[start - 1] = now
    return [(now, start, mean) for start, (now, mean, _) in enumerate(held, 1)]


def cell_of(x, parts=1):
    rows = [("c", *map(int, row)) for row in x]
    return rows, ["cell", *quality.FLOORS]


def test_the_least_determinant_wins(spark):
    """A third of the texts are a far and narrow group that medians alone are drawn to: starts end apart, and the least determinant wins, as in brute force."""
    draw = np.random.default_rng(6)
    main = draw.multivariate_normal([1500, -3000, -2900, -2900], np.diag([200, 700, 500, 600]) ** 2, 500)
    other = draw.multivariate_normal([3500, 500, 800, -400], np.diag([30, 40, 40, 30]) ** 2, 420)
    x = np.round(np.concatenate([main, other])).astype(int)
    found = sorted(brute_mcd(x.astype(float)))
    assert found[-1][0] > 1.01 * found[0][0]
    rows, names = cell_of(x)
    df = spark.createDataFrame(rows, names).repartition(5)
    quartiles = df.groupBy("cell").agg(F.array(*(F.percentile(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) for n in quality.FLOORS)).alias("quartiles"))
    best = quality.minimum_determinant(quality.packed(df), quartiles).collect()[0]
    assert abs(best.determinant / found[0][0] - 1) < 0.02 and np.allclose(best.mean, found[0][2], rtol=0.02, atol=20)


def test_a_hot_cell_is_many_parts(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 16)
    monkeypatch.setattr(quality, "PART", 2)
    draw = np.random.default_rng(7)
    x = np.round(draw.normal(0, 500, (1000, 4))).astype(int)
    rows, names = cell_of(x)
    df = spark.createDataFrame(rows, names).repartition(3)
    blocks = quality.packed(df)
    assert blocks.select("part").distinct().count() > 8 and blocks.agg(F.sum(F.octet_length("vectors"))).first()[0] == 16 * len(x)
    quartiles = df.groupBy("cell").agg(F.array(*(F.percentile(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) for n in quality.FLOORS)).alias("quartiles"))
    best = quality.minimum_determinant(blocks, quartiles).collect()[0]
    assert abs(best.determinant / min(brute_mcd(x.astype(float)))[0] - 1) < 0.01


def test_columns_with_names_of_our_own(spark):
    docs = spark.createDataFrame([(k, prose(np.random.default_rng(k), 80), "en", "a", "m", "r", "i") for k in range(30)], "doc_id long, text string, lang string, source string, kept string, row string, mean string")
    good = quality.good(docs)
    assert good.columns == docs.columns and {(r.kept, r.row, r.mean) for r in good.collect()} == {("m", "r", "i")}


def test_repetition_below_the_base_rule_goes(spark):
    """45 % of the words are one repeated line of five words, or a repeated passage within one line."""
    draw = np.random.default_rng(8)
    made = []
    for n in range(400):
        lines = [prose(draw, 5) for _ in range(40)]
        if n % 10 == 3:
            lines[:18] = [lines[0]] * 18
        if n % 10 == 7:
            lines = [" ".join([lines[0]] * 18 + lines[18:])]
        made.append((n, "\n".join(lines), "en", "a", 1))
    found = quality.verdicts(table(spark, made)).collect()
    assert not any(r.base_failed for r in found)
    assert [r.doc_id for r in found if r.kept != (r.doc_id % 10 not in (3, 7))] == []


def test_rare_languages_and_sources_have_estimates_of_their_own(spark):
    """Words of a rare language, and of a rare source of a common one, are twice as long; three texts of the language are not its own."""
    draw = np.random.default_rng(9)
    long = lambda: " ".join("".join(draw.choice(list("etaoinshrd"), draw.integers(7, 14))) for _ in range(120))
    made = [(n, prose(draw, 120), "en", "a", 1) for n in range(400)] + [(1000 + n, long(), "fi", "rare", 1) for n in range(30)]
    made += [(2000 + n, prose(draw, 120), "fi", "rare", 1) for n in range(3)] + [(3000 + n, long(), "en", "rare", 1) for n in range(20)]
    found = quality.verdicts(table(spark, made)).collect()
    assert [r.doc_id for r in found if r.kept != (not 2000 <= r.doc_id < 3000)] == []


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.verdicts(empty).count() == 0 and quality.good(empty).count() == 0
