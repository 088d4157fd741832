"""Language of a text: multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import linear
from shelfwise.llm.common import free_name, held_out, map_slices, settle, table

UNKNOWN = "und"
#: Hash buckets of n-grams of one to three characters.
SIZE = 1 << 16
#: Characters whose n-grams are made at once, so that a very long text needs no large arrays.
BLOCK = 1 << 18
#: The training sample: about so many rows of each language, fewer where rows times languages would go beyond WORK.
PER_LANGUAGE, WORK = 1500, 6_000_000
EPOCHS = 4
OPTIONS = {"alpha": 0.5, "beta": 1.0, "l1": 1e-4, "l2": 1e-4}
#: Least confidence for a document to stay in the corpus.
CONFIDENT = 0.4


@cache
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)


def grams(text: str) -> Iterator[np.ndarray]:
    """Bucket ids of the letter n-grams (n up to 3, word ends as blanks), block by block."""
    codes = text.lower().encode("utf-32-le", "replace")
    for at in range(0, len(codes) // 4, BLOCK):
        c = _letters()[np.frombuffer(codes, np.uint32, min(BLOCK + 2, len(codes) // 4 - at), 4 * at)]
        if at == 0:
            c = np.concatenate((np.zeros(1, np.uint32), c))
        if at + BLOCK >= len(codes) // 4:
            c = np.concatenate((c, np.zeros(3, np.uint32)))
        a, b, d = c[:-2], c[1:-1], c[2:]
        one, two = a * np.uint32(0x9E3779B1), a * np.uint32(0x85EBCA77) + b * np.uint32(0xC2B2AE3D) + np.uint32(1)
        three = two * np.uint32(0x27D4EB2F) + d * np.uint32(0x165667B1)
        mixed = np.concatenate((one[a > 0], two[(a > 0) | (b > 0)], three[b > 0]))
        mixed ^= mixed >> np.uint32(15)
        yield (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(16)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def document_counts(docs: DataFrame, size: int = SIZE) -> tuple[np.ndarray, int]:
    """In how many of all rows of ``docs (text)`` each bucket occurs, and the number of rows."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(size, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                seen = np.zeros(size, bool)
                for ids in grams(text.as_py() or ""):
                    seen[ids] = True
                total += seen
                rows += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": [*used.tolist(), -1], "n": [*total[used].tolist(), rows]})

    parts = docs.select("text").mapInArrow(count, "bucket bigint, n bigint")
    found = parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # size + 1 rows at most
    counts, rows = np.zeros(size, np.int64), 0
    for bucket, n in found:
        if bucket < 0:
            rows = n
        else:
            counts[bucket] = n
    return counts, rows


class Model:
    """Languages, inverse document frequencies, weights and temperature; small enough to go with every task."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, heat: float):
        self.languages, self.heat = languages, heat
        self.scaled = np.ascontiguousarray(weights * idf[:, None], np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        total, n = np.zeros(len(self.languages)), 0
        for ids in grams(text):
            total += self.scaled[ids].sum(axis=0, dtype=np.float64)
            n += len(ids)
        p = linear.softmax(SCALE * total / max(n, 1) / self.heat)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


#: Term frequencies are shares of a text's n-grams; this brings them to the size that the updates expect.
SCALE = 10.0


def train(docs: DataFrame) -> Model:
    """Learn from rows outside the held-out fold whose lang is not null and whose text has a letter.

    Document frequencies count all such rows; the weights are fitted to a bounded
    sample of them (PER_LANGUAGE, WORK). Every language is learned. A language takes
    SIZE weights of 4 bytes in the model, and some 20 bytes each in the one task that fits them.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    ).where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts, n = document_counts(rows)
    idf = np.log((1.0 + n) / (1.0 + counts)) + 1.0
    sample = linear.bounded_sample(rows, "lang", PER_LANGUAGE, WORK)

    def featured(part: pa.RecordBatch) -> list:
        ids, values = [], []
        for text in part.column("text").to_pylist():
            count = np.zeros(SIZE, np.int64)
            for found in grams(text):
                count += np.bincount(found, minlength=SIZE)
            used = np.flatnonzero(count)
            ids.append(used.astype(np.int32).tobytes())
            values.append((SCALE * count[used] / count.sum() * idf[used]).astype(np.float32).tobytes())
        return [part.column("lang"), part.column("order"), ids, values]

    order = F.xxhash64("doc_id", "text", F.lit(1)).alias("order")
    features = settle(
        map_slices(sample.select("text", "lang", order), featured, "lang string, order bigint, ids binary, values binary"), "language-sample"
    )
    languages = sorted(r["lang"] for r in features.select("lang").distinct().collect())  # a row for each language
    if not languages:
        return Model([], idf, np.zeros((SIZE, 1), np.float32), 1.0)
    places = docs.sparkSession.createDataFrame(list(zip(languages, range(len(languages)))), "lang string, label bigint")
    labelled = features.join(F.broadcast(places), "lang").select("order", "label", "ids", "values")
    weights, heat = linear.fit(labelled, SIZE, len(languages), EPOCHS, OPTIONS, calibrate=True)
    return Model(languages, idf, weights, heat)


def with_language(docs: DataFrame, model: Model, language: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with two columns more. A null text, or one without a letter, is ``und`` with score 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SIZE numbers for each language

    def work(part: pa.RecordBatch) -> list:
        return list(zip(*[sent.value.predict(t) for t in part.column("text").to_pylist()])) or [[], []]

    return map_slices(docs, work, f"{language} string, {score} double", keep=True)


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for each row of ``docs``, by a model that learns from ``docs``.

    Ties and repeated rows get equal results; a null doc_id is in no fold; without
    any row to learn from all are ``und``; other columns are ignored; an empty
    table gives an empty result.
    """
    small = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_language(small, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def drop_unknown(docs: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with at least ``confident``."""
    names = free_name(docs, "_lang_pred"), free_name(docs, "_lang_score")
    return (
        with_language(docs, train(docs), *names)
        .where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= confident)).drop(*names)
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return identify(table(spark, sf_dir, "documents"))
