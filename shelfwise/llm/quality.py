"""Quality of a text: logistic regression on hashed word n-grams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import linear
from shelfwise.llm.common import held_out, map_slices, settle, table

#: Hash buckets of n-grams; the first ones are the bias and the share of repeated word pairs.
SIZE = 1 << 18
BIAS, REPEATED, FREE = 0, 1, 16
#: Words whose n-grams are made at once.
BLOCK = 1 << 16
#: Words that a task remembers before it starts anew.
REMEMBERED = 300_000
#: The training sample: about so many rows of each label.
PER_LABEL = 3000
EPOCHS = 4
OPTIONS = {"alpha": 0.5, "beta": 1.0, "l1": 1e-4, "l2": 1e-4}
#: N-gram frequencies are shares of a text's words; this brings them to the size that the updates expect.
SCALE = 10.0
GOOD = 0.7

_WORDS = re.compile(r"\S+")
_SHAPE = ((re.compile(r"[^\W\d_]*[a-zß-öø-ÿ][^\W\d_]*"), "a"), (re.compile(r"[^\W\d_a]+"), "A"), (re.compile(r"\d+"), "0"))


def shape(word: str) -> str:
    """A word with letter runs as ``a`` (``A`` if all are capitals), digit runs as ``0``, other runs as one character."""
    for pattern, sign in _SHAPE:
        word = pattern.sub(sign, word)
    return re.sub(r"(.)\1+", r"\1", word)[:16]


class Hashes(dict):
    """Hashes of a word and of its shape, as one 64-bit number, made on first use."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = zlib.crc32(word.lower().encode("utf-8", "replace")) << 32 | zlib.crc32(shape(word).encode("utf-8", "replace"))
        if len(word) <= 64:
            self[word] = value
        return value


_hashes = Hashes()


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint32(kind)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    return FREE + (h * np.uint32(0x2C1B3C6D)) % np.uint32(SIZE - FREE)


def grams(text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Block by block: buckets of words, shapes and their pairs, the hashed pairs, and the number of words."""
    words, last = [], np.zeros(1, np.uint64)

    def block() -> tuple[np.ndarray, np.ndarray, int]:
        nonlocal last
        both = np.concatenate((last, np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))))
        last = both[-1:]
        w, s = (both >> np.uint64(32)).astype(np.uint32), both.astype(np.uint32)
        pair, shapes = w[:-1] * np.uint32(0x85EBCA77) + w[1:], s[:-1] * np.uint32(0x85EBCA77) + s[1:]
        ids = np.concatenate((_bucket(w[1:], 1), _bucket(s[1:], 2), _bucket(pair, 3), _bucket(shapes, 4)))
        return ids, pair, len(words)

    for found in _WORDS.finditer(text or ""):
        words.append(found.group())
        if len(words) == BLOCK:
            yield block()
            words = []
    if words:
        yield block()


def _repeats(pairs: list[np.ndarray]) -> float:
    """Share of word pairs that are not the first of their kind."""
    joined = np.concatenate(pairs) if len(pairs) != 1 else pairs[0]
    return 1.0 - len(np.unique(joined)) / len(joined)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted buckets and values of a text; only the bias without words."""
    count, pairs, n = np.zeros(SIZE, np.float32), [], 0
    for ids, pair, words in grams(text):
        count += np.bincount(ids, minlength=SIZE)
        pairs.append(pair)
        n += words
    count *= SCALE / max(n, 1)
    count[BIAS], count[REPEATED] = 1.0, SCALE * _repeats(pairs) if pairs else 0.0
    used = np.flatnonzero(count)
    return used.astype(np.int32), count[used]


class Model:
    def __init__(self, weights: np.ndarray, heat: float):
        self.weights, self.heat = np.ascontiguousarray(weights[:, 1] - weights[:, 0], np.float32), heat

    def score(self, text: str | None) -> float:
        """The sparse dot product of weights and n-gram frequencies, as a probability of label 1."""
        total, pairs, n = 0.0, [], 0
        for ids, pair, words in grams(text):
            total += float(self.weights[ids].sum(dtype=np.float64))
            pairs.append(pair)
            n += words
        logit = float(self.weights[BIAS]) + SCALE * total / max(n, 1)
        if pairs:
            logit += SCALE * _repeats(pairs) * float(self.weights[REPEATED])
        return float(1.0 / (1.0 + np.exp(-np.clip(logit / self.heat, -60, 60))))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from a bounded sample (PER_LABEL) of the labelled rows outside the held-out fold.

    Rows whose label is null or neither 0 nor 1 teach nothing. A doc_id with
    several labels or texts teaches each combination, one row each; the sample is
    drawn from ids before texts are joined.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.where(~held_out() & F.col("label").isin(0, 1)).withColumn("text", F.lit(""))
    chosen = linear.bounded_sample(known, "label", PER_LABEL, 4 * PER_LABEL).select("doc_id", "label")
    small = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # twice PER_LABEL rows
    rows = small.join(F.broadcast(chosen), "doc_id").select("label", "text", F.xxhash64("doc_id", "text").alias("order"))

    def featured(part: pa.RecordBatch) -> list:
        made = [features(t) for t in part.column("text").to_pylist()]
        return [part.column("order"), part.column("label"), [i.tobytes() for i, _ in made], [v.tobytes() for _, v in made]]

    sample = settle(map_slices(rows, featured, "order bigint, label int, ids binary, values binary"), "quality-sample")
    return Model(*linear.fit(sample, SIZE, 2, EPOCHS, OPTIONS, calibrate=True))


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``.

    Null and empty texts have the score of the bias alone. Without labels all
    scores are 0.5. Repeated rows get equal results; a null doc_id is in no fold;
    other columns are ignored; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # SIZE numbers
    small = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def work(part: pa.RecordBatch) -> list:
        return [part.column("doc_id"), [sent.value.score(t) for t in part.column("text").to_pylist()]]

    scored = map_slices(small, work, "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
