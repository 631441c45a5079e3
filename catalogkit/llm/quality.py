"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

Each text becomes a few document statistics. Standardised, they pass through
random cosines that approximate a Gaussian kernel. The normal equations of a
ridge regression on the labels are summed per partition, then over partitions,
and solved once. Scores of a calibration fold are counted in bins, and an
isotonic fit of the bins maps raw scores to probabilities.

Labelled rows are split by crc32 of the doc_id as text: remainder 0 of 5 is
held out, 1 to 3 fit the weights, 4 calibrates. The fit uses at most about
``TRAIN_ROWS`` labelled rows (chosen by hash); statistics of standardisation
cover all rows.

Defined results: null and empty texts have the statistics of an empty text and
get a score; a doc_id with several labels counts with their mean; null labels
are no labels; without labels of either kind in a fold, scores are the mean
label (0.5 without any); repeated rows are scored alike; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .arrowtext import map_rows, texts

#: Labelled rows of the fit, in expectation at most.
TRAIN_ROWS = 200_000
COSINES, RIDGE, SEED = 192, 1e-3, 11
BINS = 512
THRESHOLD = 0.3

_ALPHA = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGIT, _UPPER = bytes(range(48, 58)), bytes(range(65, 91))
_SYMBOL, _STOP = b"#$%&*+<=>@[\\]^_`{|}~/", b".!?"

FEATURES = (
    "log_words", "mean_word", "sd_word", "distinct_words", "distinct_pairs", "top_word", "letters", "digits", "upper",
    "symbols", "stops", "spaces", "word_lines", "distinct_lines", "short_words", "long_words", "symbol_words", "packed",
)


def statistics(text: bytes) -> list[float]:
    """The document statistics of one whole text."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    share = lambda chars: 1 - len(text.translate(None, chars)) / size
    lengths = np.fromiter(map(len, words), np.float64, n)
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x]
    pairs = len(set(zip(words, words[1:])))
    plain = text.translate(None, _SYMBOL).split()
    return [
        np.log1p(n), lengths.mean(), lengths.std(), len(counts) / n**0.8, (pairs + 1) / n, counts.most_common(1)[0][1] / n,
        share(_ALPHA), share(_DIGIT), share(_UPPER), share(_SYMBOL), share(_STOP) * 10, share(b" \t\r\n"), np.log1p(n / max(1, len(lines))),
        len(set(lines)) / max(1, len(lines)), float((lengths <= 2).mean()), float((lengths >= 14).mean()), 1 - len(plain) / n, len(zlib.compress(text, 1)) / size,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics in the order of FEATURES."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[float(v) for v in statistics(t)] for t in texts(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", run, "doc_id long, x array<double>")


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return np.asarray(batch.column(column).flatten()).reshape(batch.num_rows, -1)


class Cosines:
    """Standardises and maps to random Fourier features of a Gaussian kernel, with a constant."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, cosines: int = COSINES, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        self.w = draw.normal(size=(len(mean), cosines)) / np.sqrt(len(mean))
        self.b = draw.uniform(0, 2 * np.pi, cosines)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -6, 6)
        return np.concatenate((np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))), axis=1)


def normal_equations(rows: DataFrame, cosines: Cosines) -> np.ndarray:
    """[Z y]' [Z y] over rows of (x, y), summed per partition and then by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                z = np.concatenate((cosines(_matrix(batch, 0)), batch.column(1).to_numpy()[:, None]), axis=1)
                total = z.T @ z + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "v"])

    side = len(cosines.b) + 2
    out = np.zeros(side * side)
    sums = rows.select("x", "y").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    out[sums["cell"]] = sums["v"]
    return out.reshape(side, side)


def isotonic(low: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over bins in ascending order: (places, non-decreasing values)."""
    pools: list[list[float]] = []  # place sum, weight, ones
    for place, weight, one in zip(low, n, ones):
        pools.append([place * weight, weight, one])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[1] for p in pools]), np.array([(p[2] + 0.5) / (p[1] + 1) for p in pools])


class Model:
    """Weights of the cosines and the calibration; ``score`` gives probabilities."""

    def __init__(self, cosines: Cosines | None, weights: np.ndarray | None, places: np.ndarray, values: np.ndarray):
        self.cosines, self.weights, self.places, self.values = cosines, weights, places, np.maximum.accumulate(values)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x)) if self.weights is None else self.cosines(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.places, self.values), 0, 1)


def remainder(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit(statistics: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fits on ``statistics`` (doc_id, x) joined with ``labels`` (doc_id, quality)."""
    marks = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").cast("double").alias("y"))
    marks = marks.withColumn("fold", remainder(F.col("doc_id"))).where("fold <> 0")
    n = marks.count()
    if n > train_rows:
        marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(n)) < train_rows)
    rows = common.cut(marks.join(statistics, "doc_id").select("x", "y", "fold"))
    ones, n = rows.agg(F.sum("y"), F.count("*")).first()
    if not n:
        return Model(None, None, np.zeros(1), np.full(1, 0.5))
    plain = Model(None, None, np.zeros(1), np.full(1, ones / n))
    if not 0 < ones < n:
        return plain
    k = len(FEATURES)
    found = statistics.agg(*[F.avg(F.col("x")[i]) for i in range(k)], *[F.stddev_pop(F.col("x")[i]) for i in range(k)]).first()
    cosines = Cosines(np.array(found[:k], float), np.array(found[k:], float))
    sums = normal_equations(rows.where("fold < 4"), cosines)
    a, b, n_fit = sums[:-1, :-1], sums[:-1, -1], sums[-2, -2]
    if not n_fit:
        return plain
    weights = np.linalg.solve(a + RIDGE * n_fit * np.eye(len(a)), b)
    model = Model(cosines, weights, np.zeros(1), np.zeros(1))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch, 0))), batch.column(1)], ["raw", "y"])

    scored = rows.where("fold = 4").select("x", "y").mapInArrow(raw, "raw double, y double")
    bins = scored.groupBy(F.floor(F.least(F.greatest("raw", F.lit(-1.0)), F.lit(2.0)) * (BINS / 3)).alias("bin"))
    held = bins.agg(F.avg("raw").alias("place"), F.count("*").alias("n"), F.sum("y").alias("ones")).orderBy("bin").toPandas()
    if not len(held):
        return plain
    places, values = isotonic(held["place"].to_numpy(), held["n"].to_numpy(), held["ones"].to_numpy())
    return Model(cosines, weights, places, values)


def apply(statistics: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of ``statistics``."""
    shared = statistics.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(_matrix(batch, 1)))], ["doc_id", "score"])

    return statistics.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id and score (0 to 1) of every row of ``docs``."""
    found = common.written(document_statistics(docs))
    return apply(found, fit(found, labels, train_rows))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    out = score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return out.select(
        "doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
