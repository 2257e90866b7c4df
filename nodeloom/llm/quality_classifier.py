"""Quality classifier: ridge regression on random Fourier features of document statistics, with isotonic calibration.

Statistics of the whole text are scaled by means and deviations of the training rows. Cosines of random projections
approximate a Gaussian kernel over them; each partition sums its part of the normal equations, Spark adds the parts, and the
driver solves a system whose size is the number of features. Another fold of the training rows gives the step function from
raw to calibrated scores by pooling adjacent violators over bins of the raw score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm import hashing as H
from nodeloom.llm import textstats as T
from nodeloom.llm.scratch import light_batches, save
from nodeloom.llm.workers import free, trim

#: Random Fourier features, the kernel's width in deviations, the ridge, bins of raw scores per unit.
FEATURES, WIDTH, RIDGE, BINS = 192, 4.0, 1e-3, 500
#: A score from which a document counts as good.
GOOD = 0.7
N_STATISTICS = 14


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of N_STATISTICS numbers for each text; those of an empty text are all 0."""
    c = T.count(data, offsets)
    n, size = c.n_words, np.maximum(np.diff(offsets), 1)
    k, w = c.classes, np.maximum(c.n_words, 1)
    letters = np.maximum(k[:, T.UPPER] + k[:, T.LOWER] + k[:, T.HIGH], 1)
    owner = T._row_of(c.rows)
    often = T.run_counts(c.words, owner)
    distinct = np.bincount(owner, weights=1 / np.maximum(often, 1), minlength=len(n))
    top = np.zeros(len(n))
    np.maximum.at(top, owner, often)
    again = np.bincount(owner[1:][(c.words[1:] == c.words[:-1]) & (owner[1:] == owner[:-1])], minlength=len(n))
    lines, same = T.line_counts(c)
    share = [
        np.log1p(n),
        k[:, T.UPPER] / letters,
        k[:, T.DIGIT] / size,
        np.sqrt(k[:, T.SYMBOL] / size),
        np.sqrt(k[:, T.BANG] / size),
        k[:, T.POINT] / size,
        k[:, T.HIGH] / letters,
        c.word_chars / w,
        np.log(np.maximum(distinct, 1)) / np.log(np.maximum(n, 2)),
        top / w,
        again / w,
        T.repeated_words(c, 5) / w,
        same / np.maximum(lines, 1),
        np.log1p(lines) / np.log(w + 2),
    ]
    out = np.stack([np.asarray(s, float) for s in share], axis=1)
    out[np.diff(offsets) == 0] = 0
    return out


def _rows(batch, column: int):
    for at in range(0, batch.num_rows, 500):
        part = batch.slice(at, 500)
        yield part, statistics(*H.text_bytes(part.column(column)))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))


def _describe(batches):
    free()
    for batch in batches:
        for part, x in _rows(batch, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(x)], ["doc_id", "x"])
    trim()


@dataclass
class QualityModel:
    """A fitted model; small, whatever the input's size."""

    centre: np.ndarray
    scale: np.ndarray
    project: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ self.project + self.phase), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, -1, 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def _pool(value: np.ndarray, weight: np.ndarray) -> list[list[float]]:
    """Blocks of (mean, weight, bins) with rising means: pooled adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return blocks


def _parts(model: QualityModel):
    """The rows of this partition's normal equations, the last column for the right-hand side."""

    def run(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, N_STATISTICS)
            z = model.features(x)
            total += z.T @ np.concatenate([z, batch.column(1).to_numpy().astype(float)[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1), pa.int32()), _lists(total)], ["i", "v"])

    return run


def _raw(model: QualityModel):
    def run(batches):
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, N_STATISTICS)
            yield pa.RecordBatch.from_arrays([pa.array(np.rint(model.raw(x) * BINS).astype(np.int32)), batch.column(1)], ["bin", "y"])

    return run


def fit(rows: DataFrame) -> QualityModel:
    """A model of (x, y, fold): fold 0 is for the regression, fold 1 for the calibration.

    Without rows every score is 0.5. Where one fold is empty the other serves for both.
    """
    rng = np.random.default_rng(11)
    project, phase = rng.normal(size=(N_STATISTICS, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)
    scaling = rows.agg(*[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(N_STATISTICS) for k, f in (("m", F.avg), ("s", F.stddev_pop))], F.sum(1 - F.col("fold")).alias("first"), F.sum("fold").alias("second")).first()
    if not (scaling["first"] or scaling["second"]):
        half = np.full(2, 0.5)
        return QualityModel(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), project, phase, np.zeros(FEATURES + 1), np.array([-1.0, 2.0]), half)
    centre, scale = (np.array([scaling[f"{k}{i}"] for i in range(N_STATISTICS)]) for k in "ms")
    model = QualityModel(centre, np.maximum(scale, 1e-6), project, phase, np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    fold = lambda i: rows.where(f"fold = {i if scaling[('first', 'second')[i]] else 1 - i}").select("x", F.col("y").cast("double").alias("y"))
    parts = fold(0).mapInArrow(_parts(model), "i int, v array<double>").groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    total = np.zeros((FEATURES + 1, FEATURES + 2))
    for r in parts.collect():
        total[r.i] = r.v
    rows_in = max(total[-1, -2], 1)
    model.weights = np.linalg.solve(total[:, :-1] + RIDGE * rows_in * np.eye(FEATURES + 1), total[:, -1])
    bins = fold(1).mapInArrow(_raw(model), "bin int, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    at, n = np.array([r.bin for r in bins]) / BINS, np.array([r.n for r in bins], float)
    knots, levels, first = [], [], 0
    for mean, weight, width in _pool(np.array([r.y for r in bins]) / n, n):
        last = first + int(width) - 1
        knots += [at[first]] if first == last else [at[first], at[last]]
        levels += [(mean * weight + 0.5) / (weight + 1)] * (1 if first == last else 2)
        first = last + 1
    model.knots, model.levels = np.array(knots), np.maximum.accumulate(np.array(levels))
    return model


def _held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> tuple[QualityModel, DataFrame]:
    """The model of the labelled rows that are not held out, and (doc_id, x) of all rows.

    All labelled rows count, each as often as it is there; the labels' language, source and id are no part of x.
    """
    light_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = save(texts.mapInArrow(_describe, "doc_id long, x array<double>"), "statistics")
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("y"))
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    rows = described.join(known.where(rest != 2), "doc_id").select("x", "y", F.when(rest == 3, 1).otherwise(0).alias("fold"))
    return fit(save(rows, "training")), described


def _scored(model: QualityModel):
    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, N_STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    The model learns from labelled rows whose crc32 of the id as text, modulo 4, is not 2. Null and empty texts score as texts
    of which all statistics are 0. Without usable labels each score is 0.5. A null id is not held out.
    """
    model, described = train(docs, labels)
    out = described.mapInArrow(_scored(model), "doc_id long, score double")
    return out.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def _keep(model: QualityModel, column: int):
    def run(batches):
        for batch in batches:
            for part, x in _rows(batch, column):
                yield part.filter(pa.array(model.score(x) >= GOOD))

    return run


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model predicts to be good, with all their columns."""
    model, _ = train(docs, labels)
    return docs.mapInArrow(_keep(model, docs.columns.index("text")), docs.schema)
