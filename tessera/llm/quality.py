"""A quality classifier: naive Bayes features under a linear support vector machine.

Features are indicators of hashed n-grams, of a text's bytes and of its words' shapes (case, ending, and whether a word
is the one before it again), and of the text's length to the power of two. Each is scaled by the log ratio of its smoothed frequencies in the two
classes, each document's vector is brought to length 1, and a linear hinge-loss model is fitted by dual coordinate
descent, with the classes weighted alike. Margins of documents that a fold's model hasn't seen give the sigmoid that
turns margins into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, byte_batches, spread, unit_hash, wrapped

SLOT_BITS = 18
SIZES = (1, 2, 3, 4)
SHAPE_SIZES = (1, 2, 3)


def shape(word: str) -> int:
    """Case and ending of a word, below 16."""
    case = 0 if word.islower() else 1 if word.istitle() else 2 if word.isupper() else 3
    end = 0 if word[-1].isalnum() else 1 if word[-1] in ".,;:" else 2 if word[-1] in "!?" else 3
    return case * 4 + end


class Shapes(dict):
    """Word to a number whose last four bits are its shape; forgets all when it grows too large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        n = self[word] = xxhash.xxh3_64_intdigest(word) & ~15 & (1 << 63) - 1 | shape(word)
        return n


class Indicators:
    """The distinct slots of a text's n-grams, ascending."""

    def __init__(self):
        self.seen, self.shapes = np.zeros(1 << SLOT_BITS, bool), Shapes()

    def mark(self, grams: np.ndarray, salt: int) -> None:
        grams = (grams ^ np.uint32(0x9E3779B1 * salt & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        grams = (grams ^ (grams >> np.uint32(15))) * np.uint32(0xC2B2AE35)
        self.seen[grams >> np.uint32(32 - SLOT_BITS)] = True

    def __call__(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
        for size in SIZES:
            n = len(raw) - size + 1
            if n > 0:
                gram = raw[:n].copy()
                for k in range(1, size):
                    gram |= raw[k : k + n] << np.uint32(8 * k)
                self.mark(gram, size)
        words = (text or "").split()
        if words:
            codes = np.fromiter(map(self.shapes.__getitem__, words), np.int64, len(words))
            again = np.append(False, codes[1:] == codes[:-1])
            signs = ((codes & 15) + 16 * again + 1).astype(np.uint32)
            for size in SHAPE_SIZES:
                n = len(signs) - size + 1
                if n > 0:
                    gram = signs[:n].copy()
                    for k in range(1, size):
                        gram |= signs[k : k + n] << np.uint32(6 * k)
                    self.mark(gram, 10 + size)
            self.mark(np.array([len(words).bit_length()], np.uint32), 20)
        found = np.flatnonzero(self.seen).astype(np.int32)
        self.seen[found] = False
        return found


@dataclass
class Model:
    weights: np.ndarray  # times the ratios
    squares: np.ndarray  # of the ratios
    bias: float
    slope: float
    shift: float

    def margin(self, slots: np.ndarray) -> float:
        length = float(self.squares[slots].sum()) ** 0.5
        return (float(self.weights[slots].sum()) / length if length else 0.0) + self.bias

    def score(self, slots: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(slots) + self.shift, -500, 500))))


def log_ratios(docs: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log of (count in class 1 over its size) / (count in class 0 over its size), counts smoothed."""
    both = []
    for label in (1, -1):
        own = [d for d, t in zip(docs, y) if t == label]
        count = smooth + np.bincount(np.concatenate([*own, np.zeros(0, np.int32)]), minlength=1 << SLOT_BITS)
        both.append(np.log(count / (len(own) + 2 * smooth)))
    return (both[0] - both[1]).astype(np.float64)


def descend(docs: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, cost: float, epochs: int, seed: int = 3) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss: each step solves one document's multiplier, kept in [0, its cost].

    It ends when no multiplier moves by a thousandth any more, or after so many passes."""
    w, bias = np.zeros(len(ratios)), 0.0
    values = [(r := ratios[d]) / (np.sqrt((r * r).sum()) or 1.0) for d in docs]
    square = [float((v * v).sum()) + 1.0 for v in values]  # 1 for the bias
    bound = np.where(y > 0, cost * len(y) / 2 / max(1, (y > 0).sum()), cost * len(y) / 2 / max(1, (y < 0).sum()))
    alpha, order = np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            slope = y[i] * (float(w[docs[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), bound[i])
            if step := (new - alpha[i]) * y[i]:
                w[docs[i]] += step * values[i]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def sigmoid(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that fit the labels best (Newton, with targets smoothed by the class sizes)."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margins, np.ones_like(margins)], 1)
    c = np.array([1.0, 0.0])
    loss = lambda c: float(np.logaddexp(0, x @ c).sum() - t @ (x @ c))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - t))
        size = 1.0
        while loss(c - size * step) > loss(c) and size > 1e-6:
            size /= 2
        c = c - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(c[0]), float(c[1])


def fit(docs: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 40, folds: int = 3) -> Model:
    """Without both classes the model knows only the smoothed share of label 1."""
    y = np.where(labels > 0, 1, -1)
    pos, neg = int((y > 0).sum()), int((y < 0).sum())
    nothing = np.zeros(1 << SLOT_BITS, np.float32)
    if min(pos, neg) < folds:
        return Model(nothing, nothing, 0.0, 0.0, float(np.log((pos + 1) / (neg + 1))))
    fold = np.zeros(len(y), int)
    for label in (1, -1):
        own = np.flatnonzero(y == label)
        fold[own] = np.arange(len(own)) % folds
    margins = np.zeros(len(y))
    for k in range(folds):
        inside = np.flatnonzero(fold != k)
        some, sy = [docs[i] for i in inside], y[inside]
        r = log_ratios(some, sy)
        w, b = descend(some, sy, r, cost, epochs)
        m = Model(w * r, r * r, b, 1.0, 0.0)
        for i in np.flatnonzero(fold == k):
            margins[i] = m.margin(docs[i])
    r = log_ratios(docs, y)
    w, b = descend(docs, y, r, cost, epochs)
    return Model((w * r).astype(np.float32), (r * r).astype(np.float32), b, *sigmoid(margins, y))


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int) -> Model:
    known = labels.where(F.col("quality").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    share = rows / max(1, known.count())
    known = known.where(unit_hash(3, F.col("doc_id")) < share)  # about ``rows`` rows, so they may be broadcast

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators = Indicators()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([indicators(t.as_py()).tobytes() for t in b.column(1)], pa.binary()), b.column(2)], ["quality", "slots", "_order"])

    got = docs.join(F.broadcast(known), "doc_id").select("quality", F.col("text").cast("string"), F.xxhash64("doc_id", "text").alias("_order"))
    got = spread(got).mapInArrow(work, "quality int, slots binary, _order long").toArrow().sort_by("_order")
    return fit([np.frombuffer(x.as_py(), np.int32) for x in got["slots"]], got["quality"].to_numpy(zero_copy_only=False))


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, train: DataFrame | None, train_rows: int, threshold: float, whole: bool) -> DataFrame:
    """doc_id, held_out, score and predicted; with ``whole`` also _all, the row."""
    byte_batches(spark)
    model = spark.sparkContext.broadcast(learn(spark, (docs if train is None else train).select("doc_id", "text"), labels, train_rows))
    rows = docs.select(F.col("text").cast("string").alias("_text"), "doc_id", held_out().alias("held_out"), *([wrapped(docs)] if whole else []))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators, m = Indicators(), model.value
        for b in batches:
            scores = np.array([m.score(indicators(t.as_py())) for t in b.column(0)], np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [*b.schema.names[1:], "score", "predicted"])

    return spread(rows).mapInArrow(work, T.StructType([*rows.schema.fields[1:], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, train: DataFrame | None = None, train_rows: int = 4000, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score (of label 1) and predicted (1 from ``threshold`` on).

    Learns from ``train`` (else ``docs``) and ``labels``: about ``train_rows`` labelled documents that are not held out,
    chosen by a hash of the id. Null texts are as empty ones, scored without features; very long ones are read whole. With
    fewer than three rows of a class every score is the smoothed share of label 1. Repeated rows each give a row, and equal
    texts the same score; other columns are not read, so they may have any name; an empty table gives an empty result.
    """
    return scored(spark, docs, labels, train, train_rows, threshold, False)


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame, train: DataFrame | None = None, train_rows: int = 4000, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that ``score_quality`` predicts as 1, as they are, with all their columns whatever their names;
    odd rows are scored as there."""
    return scored(spark, docs, labels, train, train_rows, threshold, True).where("predicted = 1").select("_all.*")
