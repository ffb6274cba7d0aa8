"""Quality classifier: ridge scores on random Fourier features, calibrated.

A text becomes a vector of statistics. Random Fourier features of the standardised
vector approximate a Gaussian kernel; each partition sums its part of the normal
equations, which stay of one size whatever the input; ridge scores go through an
isotonic fit, on a fixed grid of score bins, of labelled rows that the ridge has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import column_of, map_arrow, texts_of, written

#: Number of random features, kernel width (in units of the statistics' dimension), ridge, bins of the calibration.
FEATURES, WIDTH, RIDGE, BINS = 256, 0.8, 1e-3, 400
SEED = 20240917
#: Share of the labelled rows that the calibration is fitted on; the ridge has the others.
CALIBRATION = 0.2
#: Partitions' sums are added up in so many groups before the driver sees them.
SUM_GROUPS = 8

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_sd", "upper", "digits", "points", "stops", "symbols", "bars",
    "spaces", "line_breaks", "outside_ascii", "distinct_words", "repeats", "line_words", "distinct_lines", "upper_words", "symbol_words", "end_marks",
)
_WORD_SYMBOLS = frozenset("!*%$&#@^~|<>{}[]=+_\\/")


def statistics(text: str) -> list[float]:
    """One text's statistics, in the order of STATISTICS; an empty text has zeros."""
    if not text:
        return [0.0] * len(STATISTICS)
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    hist = np.bincount(data, minlength=256)
    total = float(len(data))
    letters = max(float(hist[65:91].sum() + hist[97:123].sum()), 1.0)
    marks = float(hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum())
    stops = float(hist[46] + hist[44] + hist[59] + hist[58] + hist[63])
    words = text.split()
    n = len(words)
    if not n:
        words, n = [""], 1
    lengths = np.fromiter(map(len, words), np.float64, n)
    lines = text.split("\n")
    ends = [w[-1:] for w in words]
    return [
        np.log1p(len(text)), np.log1p(n), lengths.mean(), lengths.std(), hist[65:91].sum() / letters, hist[48:58].sum() / total, marks / total, stops / n,
        (marks - stops) / total, hist[124] / n, hist[32] / total, hist[10] / n, hist[128:].sum() / total, len(set(words)) / n, sum(map(eq, words, words[1:])) / n,
        np.log1p(n / len(lines)), len(set(lines)) / len(lines), sum(map(str.isupper, words)) / n, sum(map(_WORD_SYMBOLS.__contains__, ends)) / n, (ends.count(".") + ends.count(",")) / n,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stats of every row: whole texts, no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([column_of(batch, "doc_id"), pa.array([statistics(t) for t in texts_of(batch)], pa.list_(pa.float64()))], ["doc_id", "stats"])

    return map_arrow(docs, run, "doc_id long, stats array<double>")


class Features:
    """Random Fourier features of standardised statistics."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        self.waves = rng.normal(size=(len(mean), features)) / (width * np.sqrt(len(mean)))
        self.phase = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.sd, -6, 6)
        z = np.sqrt(2 / len(self.phase)) * np.cos(x @ self.waves + self.phase)
        return np.hstack([z, x / np.sqrt(len(self.mean)), np.ones((len(x), 1))])


def _stats_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(column_of(batch, "stats").to_pylist(), np.float64).reshape(-1, len(STATISTICS))


def _normal_equations(train: DataFrame, features: Features) -> tuple[np.ndarray, np.ndarray] | None:
    """Z'Z and Z'y over all training rows: summed in each partition, then in groups."""
    width = features(np.zeros((1, len(STATISTICS)))).shape[1]
    sent = train.sparkSession.sparkContext.broadcast(features)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        left, right = np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            z = sent.value(_stats_of(batch))
            left += z.T @ z
            right += z.T @ np.array(column_of(batch, "y").to_pylist(), np.float64)
        if left.any():
            yield pa.record_batch([pa.array([TaskContext.get().partitionId() % SUM_GROUPS]), pa.array([left.tobytes() + right.tobytes()])], ["g", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * (width + 1))
        for batch in batches:
            for data in column_of(batch, "sums").to_pylist():
                total += np.frombuffer(data)
        if total.any():
            yield pa.record_batch([pa.array([0]), pa.array([total.tobytes()])], ["g", "sums"])

    sums = train.mapInArrow(part, "g long, sums binary").repartition(SUM_GROUPS, "g").mapInArrow(add, "g long, sums binary")
    got = [np.frombuffer(r["sums"]) for r in sums.select("sums").toLocalIterator()]
    if not got:
        return None
    total = np.sum(got, axis=0)
    return total[: width * width].reshape(width, width), total[width * width :]


def isotonic(weights: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The non-decreasing fit by pooling adjacent violators; a value for each input."""
    blocks: list[list[float]] = []
    for w, m in zip(weights.tolist(), means.tolist(), strict=True):
        blocks.append([m, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m1, w1, k1 = blocks.pop()
            m0, w0, k0 = blocks[-1]
            blocks[-1] = [(m0 * w0 + m1 * w1) / (w0 + w1), w0 + w1, k0 + k1]
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


class QualityModel:
    def __init__(self, features: Features, weights: np.ndarray):
        self.features, self.weights = features, weights
        self.at, self.level = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated scores; a thousandth of the raw score keeps the order inside a level."""
        raw = self.raw(stats)
        return np.clip(0.999 * np.interp(raw, self.at, self.level) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def calibration_fold(doc_id: str) -> Column:
    """Whether a labelled row is kept for the calibration: by a hash of its id."""
    return F.pmod(F.xxhash64(F.lit("calibration"), F.col(doc_id)), F.lit(1000)) < int(1000 * CALIBRATION)


def fit_quality(labelled: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, seed: int = SEED) -> QualityModel | None:
    """A model from labelled: doc_id, stats, y (0 to 1), a row per document; None without rows.

    Where one of the two folds has no row, both fits take all rows.
    """
    labelled = labelled.withColumn("held", calibration_fold("doc_id"))
    folds = {r["held"] for r in labelled.select("held").distinct().collect()}
    learn, rest = (labelled.where("not held"), labelled.where("held")) if len(folds) > 1 else (labelled, labelled)
    cells = labelled.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()
    if not cells:
        return None
    made = Features(np.array([c["m"] for c in cells]), np.array([c["s"] for c in cells]), features, width, seed)
    sums = _normal_equations(learn, made)
    left, right = sums
    n = left[-1, -1]
    model = QualityModel(made, np.linalg.solve(left + ridge * max(n, 1.0) ** 0.5 * np.eye(len(left)), right))
    sent = labelled.sparkSession.sparkContext.broadcast(model)

    def bins(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = sent.value.raw(_stats_of(batch))
        return pa.record_batch([pa.array(np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)), column_of(batch, "y")], ["b", "y"])

    rows = map_arrow(rest, bins, "b long, y double").groupBy("b").agg(F.count("*").alias("n"), F.avg("y").alias("y")).orderBy("b").collect()
    at = np.array([(r["b"] + 0.5) * 2 / BINS - 0.5 for r in rows])
    model.at, model.level = at, isotonic(np.array([float(r["n"]) for r in rows]), np.array([r["y"] for r in rows]))
    return model


def score_quality(docs: DataFrame, labels: DataFrame, learn_from=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Quality of every whole text: doc_id, score (0 to 1), predicted (1 if score >= 0.5).

    labels: doc_id, quality (0 or 1, several rows of an id are averaged, nulls ignored);
    learn_from: condition on doc_id for rows that may be learnt from. Without any such
    row all scores are 0.5. Null texts count as empty; repeated rows score alike; null
    ids stay null and are not learnt from; other columns, of any name, are not read.
    Texts are read once; only the small statistics are shuffled.
    """
    stats = written(document_statistics(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))), "quality-stats")
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").cast("double").alias("y"))
    train = stats if learn_from is None else stats.where(learn_from)
    train = written(train.join(known, "doc_id").select("doc_id", "stats", "y"), "quality-train")
    sent = docs.sparkSession.sparkContext.broadcast(fit_quality(train))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = sent.value.score(_stats_of(batch)) if sent.value else np.full(batch.num_rows, 0.5)
        return pa.record_batch([column_of(batch, "doc_id"), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_arrow(stats, score, "doc_id long, score double, predicted int")


def drop_low_quality(docs: DataFrame, labels: DataFrame, learn_from=None, text_col: str = "text") -> DataFrame:
    """Rows of docs with score >= 0.5 (all rows if there is nothing to learn from), columns as they are.

    The model is fitted on docs' own labelled rows; then docs pass row by row.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").cast("double").alias("y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stats = document_statistics(texts if learn_from is None else texts.where(learn_from))
    sent = docs.sparkSession.sparkContext.broadcast(fit_quality(written(stats.join(known, "doc_id").select("doc_id", "stats", "y"), "quality-train")))

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        if sent.value is None:
            return batch
        return batch.filter(pa.array(sent.value.score(np.array([statistics(t) for t in texts_of(batch, text_col)])) >= 0.5))

    return map_arrow(docs, keep, docs.schema)
