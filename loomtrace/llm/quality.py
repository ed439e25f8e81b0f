"""Quality rules: robust multivariate outliers among texts of one language and source.

Base statistics count words, their code points, symbols, repeated lines and
repeated 3-word windows; a text with fewer than 50 words, or with more than
half of its words in repeated windows, fails at once. The others get a vector
of transformed statistics. For each cell (a language and source, and a whole
language) the minimum covariance determinant is estimated over all of the
cell's documents, from four deterministic starts:

1. medians and quartile ranges;
2. the correlation of hyperbolic tangents of standardised values;
3. the correlation of spatial signs;
4. the half of the documents that is nearest to the medians.

From each, concentration steps keep the 60% of documents with the least
Mahalanobis distance and estimate mean and covariance again, as long as the
determinant falls at all, which ends as there are finitely many sets to keep. The least determinant of the four wins. It is
reweighted: mean and covariance of the documents within the 0.975 quantile.
The estimate of a language and source with n documents then weighs
n / (n + `PRIOR`), that of its language the rest, whatever the sizes; other
languages have no part in it. A document is rejected when its squared distance
passes `CUT` times a consistency factor (median distance over its expectation).

Vectors are packed by tasks into blocks of one cell each. A pass over the blocks
gives, for each cell and start, counts, sums and products by distance in steps
of 1/16 octave, summed in each task before the shuffle; limit and estimate of a
step both come from these. Blocks meet the estimates by cell and part, and a cell
has as many parts as it needs, so a hot cell is many tasks and nothing is
broadcast by force. Sums are of integers (statistics in thousandths), so results
don't depend on the order of rows.

Null texts count as empty and fail the base rule; very long texts are counted
whole; null languages and sources are values of their own; repeated rows get
equal verdicts, and each counts; a cell of one document is its own estimate with
the floors as spread; an empty table gives no rows. Columns of the input keep
their values whatever their names; `statistics` and `judge` replace columns that
are named like their results.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, cut, map_arrow, packed_row, ship

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Documents that the estimate of a language counts as beside those of one of its sources.
PRIOR = 200
#: Share of a cell's documents that concentration keeps, and that the fourth start takes.
KEEP, HALF = 0.6, 0.5
#: Quantiles of chi-square with four degrees of freedom: 0.975 for the reweighted estimate, 0.999 to reject.
WITHIN, CUT = 11.143, 18.467
#: Vectors of a block, and blocks of a cell that are one part.
BLOCK, PART = 4096, 64
#: The median of the squared distance of four normal variables.
MEDIAN = 3.357
#: The transformed statistics and the least standard deviation of each, in thousandths: most texts
#: of a cell have no symbol and no repetition, and their spread alone would be none. The base rule bounds
#: repeat_share to 2400 and line_share to 5300 over none, so their floors are small enough that each can pass `CUT`.
FLOORS = {"word_length": 80, "symbol_share": 300, "line_share": 400, "repeat_share": 400}
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WORDS = re.compile(WORD)


def statistics_of(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one text."""
    text = text or ""
    words = WORDS.findall(text)
    seen, repeated_lines = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\v\f\r"):
            repeated_lines += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = 0
    if len(windows) < len(words) - 2:
        reach = 0  # words before it are counted
        for k, window in enumerate(zip(words, words[1:], words[2:], strict=False)):
            if windows[window] > 1:
                covered += k + 3 - max(reach, k)
                reach = k + 3
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), repeated_lines, covered


def statistics(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """`docs` with the base statistics and base_failed (replacing columns of these names), without the text unless asked."""
    docs = docs.drop(*STATISTICS, "base_failed")
    at = docs.columns.index("text")
    rest = [k for k in range(len(docs.columns)) if k != at or keep_text]

    def run(batches):
        for batch in batches:
            found = np.array([statistics_of(text.as_py()) for text in batch.column(at)], np.int64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), *map(pa.array, found.T.copy())], names=[*(batch.schema.names[k] for k in rest), *STATISTICS])

    found = map_arrow(docs, run, T.StructType([*(docs.schema.fields[k] for k in rest), *(T.StructField(s, T.LongType()) for s in STATISTICS)]))
    return found.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def _vector() -> list[Column]:
    """The transformed statistics in thousandths, as integers."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    values = (F.log(chars / words), F.log(0.01 + F.col("n_symbols") / chars), F.log(0.05 + 10 * F.col("n_dup_lines") / words), F.log(0.05 + F.col("n_repeat_words") / words))
    return [F.round(1000 * value).cast("long").alias(name) for name, value in zip(FLOORS, values, strict=True)]


def _cells() -> list[Column]:
    """The two cells of a document. A null language and the language "null" differ, as JSON leaves null fields out."""
    return [F.to_json(F.struct(F.lit(1).alias("by"), "lang", "source")), F.to_json(F.struct(F.lit(2).alias("by"), "lang"))]


SIZE = len(FLOORS)
RIDGE = np.diag(np.array(list(FLOORS.values()), float) ** 2)
STARTS = "array<struct<start: int, mean: array<double>, inverse: array<double>, determinant: double>>"
ESTIMATES, STEPS = f"cell string, starts {STARTS}", f"cell string, starts {STARTS}, done {STARTS}"
SUMS = "cell string, start int, before double, bin int, n long, sums array<long>, products array<long>"
SHRUNK = "_lang string, _source string, mean array<double>, inverse array<double>, spread double"


def octaves(distance: np.ndarray) -> np.ndarray:
    return np.round(16 * np.log2(1 + np.maximum(distance, 0))).astype(np.int64)


def packed(vectors: DataFrame) -> DataFrame:
    """cell, part and vectors (32-bit integers): the vectors of each cell in blocks, packed by the task that has them."""

    def run(batches):
        held: dict[str, list[np.ndarray]] = {}

        def give(cells):
            blocks = [(cell, block) for cell in cells for whole in [np.concatenate(held.pop(cell))] for block in np.array_split(whole, -(-len(whole) // BLOCK))]
            return pa.RecordBatch.from_arrays([pa.array([cell for cell, _ in blocks], pa.string()), pa.array([block.astype("<i4").tobytes() for _, block in blocks], pa.binary())], names=["cell", "vectors"])

        resident = 0
        for batch in batches:
            values = np.stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(SIZE)], axis=1)
            names, place = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            order = np.argsort(place, kind="stable")
            for name, some in zip(names.tolist(), np.split(values[order], np.cumsum(np.bincount(place))[:-1]), strict=True):
                held.setdefault(name, []).append(some)
            resident += len(values)
            if resident > 64 * BLOCK:
                yield give(list(held))
                resident = 0
        if held:
            yield give(list(held))

    blocks = cut(map_arrow(vectors, run, "cell string, vectors binary"))
    parts = blocks.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    return cut(blocks.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("vectors", F.monotonically_increasing_id()), F.col("parts")).cast("int")))


def _with_estimates(blocks: DataFrame, estimates: DataFrame) -> DataFrame:
    parts = blocks.groupBy("cell").agg(F.max("parts").alias("parts"))
    every = estimates.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return blocks.join(every, ["cell", "part"])


def _by_distance(blocks: DataFrame, estimates: DataFrame) -> DataFrame:
    """For each cell and start: counts, sums and products of its vectors by distance."""

    def run(batches):
        found: dict[tuple, np.ndarray] = {}

        def give():
            rows = [(cell, start, before, k, int(row[0]), row[1 : SIZE + 1].tolist(), row[SIZE + 1 :].tolist()) for (cell, start, before), table in found.items() for k, row in table.items()]
            kinds = [pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in SUMS.split(", ")])

        for batch in batches:
            for cell, data, starts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                x = np.frombuffer(data, "<i4").reshape(-1, SIZE).astype(np.int64)
                rows = np.concatenate([np.ones((len(x), 1), np.int64), x, (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)], axis=1)
                for one in starts:
                    gap = x - np.array(one["mean"])
                    bins = octaves(np.einsum("ij,jk,ik->i", gap, np.array(one["inverse"]).reshape(SIZE, SIZE), gap))
                    order = np.argsort(bins, kind="stable")
                    distinct, first = np.unique(bins[order], return_index=True)
                    table = found.setdefault((cell, one["start"], one["determinant"]), {})
                    for k, row in zip(distinct.tolist(), np.add.reduceat(rows[order], first, axis=0), strict=True):
                        table[k] = table[k] + row if k in table else row
            if sum(map(len, found.values())) > 50_000:
                yield give()
                found = {}
        if found:
            yield give()

    partial = map_arrow(_with_estimates(blocks, estimates).select("cell", "vectors", "starts"), run, SUMS)
    summed = lambda name, size: F.array(*[F.sum(F.col(name)[k]) for k in range(size)]).alias(name)
    return partial.groupBy("cell", "start", "before", "bin").agg(F.sum("n").alias("n"), summed("sums", SIZE), summed("products", SIZE * SIZE))


def _estimate(n: float, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from sums; the floors keep each matrix regular."""
    mean = sums / n
    return mean, products.reshape(SIZE, SIZE) / n - np.outer(mean, mean) + RIDGE


def _up_to(pdf: pd.DataFrame, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _estimate(float(pdf["n"].to_numpy()[inside].sum()), np.stack(pdf["sums"].to_numpy())[inside].sum(axis=0).astype(float), np.stack(pdf["products"].to_numpy())[inside].sum(axis=0).astype(float))


def _reaching(pdf: pd.DataFrame, share: float) -> int:
    """The least distance within which this share of the documents lies."""
    counts = pdf["n"].to_numpy()
    return int(pdf["bin"].to_numpy()[np.searchsorted(np.cumsum(counts), share * counts.sum() - 1e-9)])


def _concentrated(pdf: pd.DataFrame) -> pd.DataFrame:
    """One step of each start of a cell. The fourth start takes a half of the documents first, and so begins nearer to the medians."""
    starts = []
    for (start, before), some in pdf.groupby(["start", "before"], sort=True):
        some = some.sort_values("bin")
        limit = _reaching(some, HALF if start == 4 and np.isinf(before) else KEEP)
        mean, covariance = _up_to(some, some["bin"].to_numpy() <= limit)
        starts.append((int(start), mean.tolist(), np.linalg.inv(covariance).ravel().tolist(), float(np.linalg.det(covariance))))
    return pd.DataFrame([(pdf["cell"].iloc[0], starts)], columns=["cell", "starts"])


def _settled(parts):
    """Each start goes on from its step if the determinant fell; else it has settled and stays as it was."""
    for pdf in parts:
        rows = []
        for cell, starts, done, new in zip(pdf["cell"], pdf["starts"], pdf["done"], pdf["new"], strict=True):
            plain = lambda s: (int(s["start"]), list(s["mean"]), list(s["inverse"]), float(s["determinant"]))
            old, on, over = {s["start"]: plain(s) for s in starts}, [], [plain(s) for s in done]
            for s in map(plain, new):
                falls = s[3] < old[s[0]][3]
                (on if falls else over).append(s if falls else old[s[0]])
            rows.append((cell, on, over))
        yield pd.DataFrame(rows, columns=["cell", "starts", "done"])


def _from_quartiles(quartiles: list) -> tuple[np.ndarray, np.ndarray]:
    """Medians, and scales from quartile ranges (at least the floors)."""
    q = np.array([list(x) for x in quartiles], float)
    return q[:, 1], np.sqrt(((q[:, 2] - q[:, 0]) / 1.349) ** 2 + RIDGE.diagonal())


def _first(blocks: DataFrame, quartiles: DataFrame) -> DataFrame:
    """The starts of each cell."""

    def transformed(batches):
        for batch in batches:
            cells, rows = [], []
            for cell, data, own in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                median, scale = _from_quartiles(own)
                z = (np.frombuffer(data, "<i4").reshape(-1, SIZE) - median) / scale
                # In whole thousandths, so that sums don't depend on the order of rows.
                flat, sign = np.round(1000 * np.tanh(z)).astype(np.int64), np.round(1000 * z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None]).astype(np.int64)
                cells.append(cell)
                rows.append([len(z), *flat.sum(axis=0).tolist(), *(flat.T @ flat).ravel().tolist(), *(sign.T @ sign).ravel().tolist()])
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.string()), pa.array(rows, pa.list_(pa.int64()))], names=["cell", "sums"])

    def made(parts):
        for pdf in parts:
            rows = []
            for cell, own, sums in zip(pdf["cell"], pdf["quartiles"], pdf["sums"], strict=True):
                (median, scale), sums = _from_quartiles(own), np.array(sums, float)
                n, flat, products, signs = sums[0], sums[1 : SIZE + 1], sums[SIZE + 1 : SIZE + 1 + SIZE * SIZE].reshape(SIZE, SIZE), sums[SIZE + 1 + SIZE * SIZE :].reshape(SIZE, SIZE)
                tanh = products / n - np.outer(flat / n, flat / n)
                starts = []
                for start, matrix in ((1, np.eye(SIZE)), (2, tanh), (3, signs / n), (4, np.eye(SIZE))):
                    spread = np.sqrt(np.maximum(matrix.diagonal(), 1e-6))
                    covariance = np.outer(scale, scale) * (matrix / np.outer(spread, spread)) + 1e-6 * RIDGE
                    starts.append((start, median.tolist(), np.linalg.inv(covariance).ravel().tolist(), float("inf")))
                rows.append((cell, starts, []))
            yield pd.DataFrame(rows, columns=["cell", "starts", "done"])

    met = _with_estimates(blocks, quartiles)
    partial = map_arrow(met.select("cell", "vectors", "quartiles"), transformed, "cell string, sums array<long>")
    size = 1 + SIZE + 2 * SIZE * SIZE
    summed = partial.groupBy("cell").agg(F.array(*[F.sum(F.col("sums")[k]) for k in range(size)]).alias("sums"))
    return quartiles.join(summed, "cell").mapInPandas(made, STEPS)


def minimum_determinant(blocks: DataFrame, quartiles: DataFrame) -> DataFrame:
    """cell, start, mean, inverse and determinant of the start of each cell that ends with the least determinant."""
    estimates = cut(_first(blocks, quartiles))
    while not (going := estimates.where(F.size("starts") > 0)).isEmpty():
        new = _by_distance(blocks, going).groupBy("cell").applyInPandas(_concentrated, ESTIMATES).withColumnRenamed("starts", "new")
        stepped = going.join(new, "cell").select("cell", "starts", "done", "new").mapInPandas(_settled, STEPS)
        estimates = cut(stepped.unionByName(estimates.where(F.size("starts") == 0)), instead_of=estimates)
    estimates = estimates.select("cell", F.concat("starts", "done").alias("starts"))
    best = F.array_sort(F.transform("starts", lambda s: F.struct(s["determinant"], s["start"], s["mean"], s["inverse"])))[0]
    return estimates.select("cell", best.alias("best")).select("cell", "best.start", "best.mean", "best.inverse", "best.determinant")


def _spread(pdf: pd.DataFrame) -> float:
    return max(1.0, (2 ** (_reaching(pdf, 0.5) / 16) - 1) / MEDIAN)


def _reweighted(pdf: pd.DataFrame) -> pd.DataFrame:
    """The estimate of the documents that lie within the 0.975 quantile, once the concentrated one is scaled to fit its median."""
    pdf = pdf.sort_values("bin")
    bins = pdf["bin"].to_numpy()
    inside = bins <= max(octaves(np.array([WITHIN * _spread(pdf)]))[0], _reaching(pdf, KEEP))
    mean, covariance = _up_to(pdf, inside)
    return pd.DataFrame([(pdf["cell"].iloc[0], [(1, mean.tolist(), np.linalg.inv(covariance).ravel().tolist(), float(np.linalg.det(covariance)))])], columns=["cell", "starts"])


def _spreads(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([(pdf["cell"].iloc[0], _spread(pdf.sort_values("bin")))], columns=["cell", "spread"])


def _shrunk(pdf: pd.DataFrame) -> pd.DataFrame:
    """The estimates of sources, each drawn towards that of its language: mean and covariance of the two mixed by weight."""
    rows = []
    for row in pdf.itertuples(index=False):
        weight = row.n / (row.n + PRIOR)
        own, whole = np.array(row.mean, float), np.array(row.mean_2, float)
        covariances = [np.linalg.inv(np.array(inverse, float).reshape(SIZE, SIZE)) for inverse in (row.inverse, row.inverse_2)]
        between = weight * (1 - weight) * np.outer(own - whole, own - whole)
        inverse = np.linalg.inv(weight * covariances[0] + (1 - weight) * covariances[1] + between)
        rows.append((row.lang, row.source, (weight * own + (1 - weight) * whole).tolist(), inverse.ravel().tolist(), weight * row.spread + (1 - weight) * row.spread_2))
    return pd.DataFrame(rows, columns=["_lang", "_source", "mean", "inverse", "spread"])


def vectors(counted: DataFrame) -> DataFrame:
    """cell and the vector of each text past the base rule, for both of its cells."""
    judged = counted.where(~F.col("base_failed")).select("lang", "source", *_vector())
    return judged.select(F.explode(F.array(*_cells())).alias("cell"), *FLOORS)


def fit(counted: DataFrame) -> DataFrame:
    """The estimates for each language and source of `counted` (statistics with lang and source): lang, source, mean, inverse, spread."""
    ship(counted.sparkSession)
    sizes = counted.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n")).withColumns(dict(zip(("cell", "cell_2"), _cells(), strict=True)))
    every = vectors(counted)
    blocks = packed(every)
    # Statistics are whole thousandths, so a cell has a bounded number of values.
    quartiles = cut(every.groupBy("cell").agg(F.array(*(F.percentile(name, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) for name in FLOORS)).alias("quartiles")))
    best = minimum_determinant(blocks, quartiles)
    only = lambda found: found.select("cell", F.array(F.struct("start", "mean", "inverse", "determinant")).alias("starts"))
    reweighted = cut(_by_distance(blocks, only(best)).groupBy("cell").applyInPandas(_reweighted, ESTIMATES))
    spreads = _by_distance(blocks, reweighted.select("cell", "starts")).groupBy("cell").applyInPandas(_spreads, "cell string, spread double")
    known = cut(reweighted.select("cell", F.col("starts")[0]["mean"].alias("mean"), F.col("starts")[0]["inverse"].alias("inverse")).join(spreads, "cell"))
    met = sizes.join(known, "cell").join(known.toDF("cell_2", "mean_2", "inverse_2", "spread_2"), "cell_2").drop("cell", "cell_2")
    return cut(met.mapInPandas(lambda parts: map(_shrunk, parts), SHRUNK))


def judge(counted: DataFrame, estimates: DataFrame) -> DataFrame:
    """`counted` with kept: neither failed by the base rule nor an outlier of its cell."""
    names = [f"`{name}`" for name in counted.columns if name != "kept"]
    met = counted.join(estimates, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    placed = met.select(*[F.col(name) for name in names], "mean", "inverse", "spread", F.struct(*_vector()).alias("_vector"))
    gap = [F.col(f"_vector.{name}") - F.col("mean")[i] for i, name in enumerate(FLOORS)]
    size = len(FLOORS)
    far = sum((F.col("inverse")[size * i + j] * gap[i] * gap[j] for i in range(size) for j in range(size)), F.lit(0.0))
    return placed.select(*names, F.when(F.col("base_failed"), False).otherwise(far <= CUT * F.col("spread")).alias("kept"))


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept of each row of `docs`."""
    counted = cut(statistics(docs.select("doc_id", "text", "lang", "source")))
    return judge(counted, fit(counted)).select("doc_id", *STATISTICS, "base_failed", "kept")


def good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, with their columns. Rows and their statistics are written once and judged from there."""
    counted = cut(statistics(packed_row(docs, "lang", "source", "text")))
    return judge(counted, fit(counted.select("lang", "source", *STATISTICS, "base_failed"))).where("kept").select("row.*")
