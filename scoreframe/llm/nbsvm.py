"""Naive Bayes support vectors: a linear classifier over scaled n-gram indicators.

A text's indicators are hashed into ``FEATURES`` places: its words and word pairs, and the
n-grams of its shape, the text with runs of one character class made one (upper, lower,
digit, blank, line end, each symbol), and runs of one word repeated. Each indicator is
scaled by the log ratio of its smoothed counts in the two classes, rows are brought to unit
length, and a linear hinge-loss model is fitted by dual coordinate descent: one row's
multiplier at a time, the weights kept up to date. A logistic curve fitted to the margins
of a fifth of the rows, left out of the descent, turns margins into probabilities.

The fit uses at most ``sample`` labelled rows (a documented bound), those whose hashed id
comes first, so one task holds them; of several rows of one id it reads the one whose text
has the smallest hash, found by a partial aggregation. Every row is scored.

Defined results: a missing text counts as empty and is scored by the intercept; rows with a
missing id or label, or a label other than 0 and 1, teach nothing; of several labels of one
id the least counts; without any label each score is 0.5, with one class its smoothed share;
equal rows get equal scores; extra columns are kept and never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.text import whole

FEATURES = 1 << 18
SAMPLE = 12_000
SHAPE_GRAMS = (1, 2, 3, 4, 6)
COST, SWEEPS, TOLERANCE = 1.0, 30, 1e-3


def _classes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint64)
    table[ord("A"):ord("Z") + 1] = ord("A")
    table[ord("a"):ord("z") + 1] = ord("a")
    table[128:] = ord("a")
    table[ord("0"):ord("9") + 1] = ord("0")
    table[[9, 11, 12, 13, 32]] = 32
    return table


class Indicators:
    """The places of a text's n-grams, each once; one instance serves one task."""

    def __init__(self) -> None:
        self.table = _classes()
        self.seen = np.zeros(FEATURES, dtype=bool)

    def _mark(self, grams: np.ndarray, kind: int) -> None:
        mixed = (grams + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        self.seen[(mixed >> np.uint64(64 - 18)).astype(np.int64)] = True

    def __call__(self, text: bytes | None) -> np.ndarray:
        text = text or b""
        words = np.fromiter(map(zlib.crc32, text.lower().split()), dtype=np.uint64)
        self._mark(words, 1)
        self._mark(words[:-1] * np.uint64(0x100000001B3) + words[1:], 2)
        again = words[1:] == words[:-1]
        for run in (1, 3, 7):
            if len(again) >= run and np.convolve(again, np.ones(run), "valid").max() >= run:
                self._mark(np.array([run], dtype=np.uint64), 3)
        shape = self.table[np.frombuffer(text, dtype=np.uint8)]
        if len(shape):
            shape = shape[np.r_[True, shape[1:] != shape[:-1]]]
        for n in SHAPE_GRAMS:
            if len(shape) >= n:
                gram = np.zeros(len(shape) - n + 1, dtype=np.uint64)
                for i in range(n):
                    gram = gram * np.uint64(257) + shape[i:len(shape) - n + 1 + i]
                self._mark(gram, 10 + n)
        places = np.flatnonzero(self.seen)
        self.seen[places] = False
        return places.astype(np.int32)


@dataclass
class Model:
    """Weights on indicators (already scaled by their ratios), squared ratios, and the curve."""

    weights: np.ndarray
    squares: np.ndarray
    intercept: float
    slope: float
    offset: float

    def margin(self, places: np.ndarray) -> float:
        length = np.sqrt(self.squares[places].sum(dtype=np.float64)) or 1.0
        return float(self.weights[places].sum(dtype=np.float64) / length + self.intercept)

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margins + self.offset, -500, 500)))


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = [np.full(FEATURES, smooth), np.full(FEATURES, smooth)]
    for places, label in zip(rows, good, strict=True):
        counts[int(label)][places] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def descend(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; the last weight belongs to a constant."""
    weights, constant = np.zeros(FEATURES), 0.0
    multipliers = np.zeros(len(rows))
    squares = np.array([v @ v + 1.0 for v in values])
    random = np.random.default_rng(11)
    for _ in range(SWEEPS):
        most = 0.0
        for i in random.permutation(len(rows)):
            gradient = sign[i] * (weights[rows[i]] @ values[i] + constant) - 1.0
            old = multipliers[i]
            new = min(max(old - gradient / squares[i], 0.0), cost[i])
            if new != old:
                multipliers[i] = new
                step = (new - old) * sign[i]
                weights[rows[i]] += step * values[i]
                constant += step
                most = max(most, abs(new - old))
        if most < TOLERANCE:
            break
    return weights, constant


def logistic_curve(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of the good class, with smoothed targets."""
    n1, n0 = good.sum(), (1 - good).sum()
    target = np.where(good == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


def fit_rows(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """The model of labelled indicator rows, in their given order."""
    zeros = np.zeros(FEATURES, dtype=np.float32)
    n1, n = int(labels.sum()), len(labels)
    if n == 0 or n1 in (0, n):
        share = (n1 + 1) / (n + 2)
        return Model(zeros, zeros, 0.0, 1.0, float(np.log(share / (1 - share))))
    ratios = log_count_ratios(rows, labels)
    values = []
    for places in rows:
        v = ratios[places]
        values.append(v / (np.sqrt(v @ v) or 1.0))
    held = np.arange(n) % 5 == 0
    if min(labels[held].sum(), (1 - labels[held]).sum(), labels[~held].sum(), (1 - labels[~held]).sum()) == 0:
        held[:] = False
    own = np.flatnonzero(~held)
    cost = np.where(labels == 1, COST, COST * n1 / (n - n1))
    weights, constant = descend([rows[i] for i in own], [values[i] for i in own],
                                2.0 * labels[own] - 1, cost[own])
    curve = np.flatnonzero(held) if held.any() else own
    margins = np.array([weights[rows[i]] @ values[i] + constant for i in curve])
    slope, offset = logistic_curve(margins, labels[curve])
    return Model((weights * ratios).astype(np.float32), (ratios**2).astype(np.float32), constant, slope, offset)


def held_out(id_column: str = "doc_id"):
    """Rows whose label is never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on the labelled rows outside the held-out fold."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_column).isNotNull() & ~held_out(id_column))
    known = known.groupBy(F.col(id_column).alias("_id")).agg(F.min(label).cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    text = docs.select(F.col(id_column).alias("_id"), whole().cast("binary").alias("_text"), F.xxhash64(whole()).alias("_hash"))
    rows = text.join(F.broadcast(chosen), "_id").select("_id", "_label", "_text", "_hash")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Indicators()
        for batch in batches:
            packed = [places(x.as_py()).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), batch.column(1), batch.column(3), pa.array(packed, pa.binary())],
                ["id", "label", "hash", "places"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        found.sort(key=lambda r: (zlib.crc32(r[0].encode()), r[0]))  # one order whatever the partitioning
        model = fit_rows([np.frombuffer(r[2], dtype=np.int32) for r in found], np.array([r[1] for r in found], dtype=np.float64))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x.tobytes()], pa.binary()) for x in (model.weights, model.squares)]
            + [pa.array([x], pa.float64()) for x in (model.intercept, model.slope, model.offset)],
            ["weights", "squares", "intercept", "slope", "offset"])

    marked = rows.mapInArrow(mark, "id string, label int, hash bigint, places binary")
    single = marked.groupBy("id", "label").agg(F.min(F.struct("hash", "places")).alias("row")).select("id", "label", "row.places")
    out = single.repartition(1).mapInArrow(solve, "weights binary, squares binary, intercept double, slope double, offset double").collect()
    if not out:
        return fit_rows([], np.zeros(0))
    one = out[0]
    return Model(*(np.frombuffer(x, dtype=np.float32) for x in one[:2]), *one[2:])


def with_score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the probability of the good class."""

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places = Indicators()
        for texts in batches:
            margins = np.array([model.margin(places(t)) for t in texts], dtype=np.float64)
            yield pd.Series(model.probability(margins))

    of_text = F.pandas_udf(scores, "double")
    return docs.withColumn(column, of_text(whole().cast("binary")))


def quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", cut: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) of each row."""
    scored = with_score(docs.select(id_column, "text"), fit(docs, labels, id_column))
    return scored.select(id_column, held_out(id_column).alias("held_out"), "score",
                         (F.col("score") >= cut).cast("int").alias("predicted"))
