"""Sparse linear models trained with follow-the-regularised-leader updates on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows sampled of a label, about, however many labels there are.
LEAST = 30


def bounded_sample(rows: DataFrame, label: str, per_label: int, work: int) -> DataFrame:
    """About ``per_label`` rows of each label, chosen by a hash of doc_id and text; the same rows on every run.

    Every label that is not null is learned. An update costs as much as there are
    labels, so with many of them each gets fewer rows: ``work`` bounds sampled rows
    times labels, down to LEAST rows a label. Counts cover all rows; the driver sees
    one row for each label.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n")).collect()
    if not counts:
        return rows.where("false")
    each = min(per_label, max(LEAST, work // len(counts) ** 2))
    rates = rows.sparkSession.createDataFrame([(r["_label"], min(1.0, each / r["_n"])) for r in counts], rows.select(F.col(label).alias("_label")).schema.add("_rate", "double"))
    chosen = rows.join(F.broadcast(rates), F.col(label) == F.col("_label"))  # a row for each label
    return chosen.where(_share(F.xxhash64("doc_id", "text")) < F.col("_rate")).select(*rows.columns)


def _share(h: Column) -> Column:
    """A hash as a number in [0, 1)."""
    return F.pmod(h, F.lit(1 << 20)) / F.lit(float(1 << 20))


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class FollowTheLeader:
    """Multinomial logistic regression, one weight column for each class, with elastic-net FTRL-proximal updates."""

    def __init__(self, size: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0):
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, ids: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[ids], self.n[ids]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, ids: np.ndarray, values: np.ndarray, label: int, weight: float = 1.0) -> None:
        w = self.weights(ids)
        error = softmax(values @ w)
        error[label] -= 1.0
        g = weight * values[:, None] * error
        n = self.n[ids]
        self.z[ids] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[ids] = n + g * g


def fit(features: DataFrame, size: int, classes: int, epochs: int, options: dict, calibrate: bool) -> tuple[np.ndarray, float]:
    """``(weights, temperature)`` learned in one task from a bounded sample ``(order, label, ids, values)``.

    ids and values are int32 and float32 bytes. Rows are taken in the order of
    ``order``. With ``calibrate`` every fifth row is set apart, and the temperature
    that makes its log loss least, labels counted as almost certain, is returned
    beside the weights; else 1.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        rows = [(r["label"], np.frombuffer(r["ids"], np.int32), np.frombuffer(r["values"], np.float32)) for r in sorted(rows, key=lambda r: (r["order"], r["ids"]))]
        apart = rows[::5] if calibrate and len(rows) >= 10 * classes else []
        taught = [r for k, r in enumerate(rows) if k % 5] if apart else rows
        totals = np.bincount([r[0] for r in taught], minlength=classes) if taught else np.ones(classes)
        balance = len(taught) / np.maximum(totals, 1) / classes
        model = FollowTheLeader(size, classes, **options)
        for epoch in range(epochs):
            for k in np.random.default_rng(epoch).permutation(len(taught)):
                label, ids, values = taught[k]
                model.learn(ids, values, label, balance[label])
        w, best = model.weights().astype(np.float32), 1.0
        if apart:
            logits, labels = np.array([v @ w[i] for _, i, v in apart]), np.array([r[0] for r in apart])
            heat = np.exp(np.linspace(-4, 4, 161))
            target = np.full(logits.shape, 1.0 / (len(labels) + 2) / max(1, classes - 1))  # no label is certain, as in Platt scaling
            target[np.arange(len(labels)), labels] = 1.0 - 1.0 / (len(labels) + 2)
            loss = [-(target * np.log(softmax(logits / t) + 1e-30)).sum() for t in heat]
            best = float(heat[int(np.argmin(loss))])
        used = np.flatnonzero(w.any(axis=1)).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"ids": [used.tobytes()], "weights": [w[used].tobytes()], "heat": [best]})

    row = features.repartition(1).mapInArrow(task, "ids binary, weights binary, heat double").first()
    weights = np.zeros((size, classes), np.float32)
    if row is not None:
        weights[np.frombuffer(row["ids"], np.int32)] = np.frombuffer(row["weights"], np.float32).reshape(-1, classes)
    return weights, row["heat"] if row is not None else 1.0
