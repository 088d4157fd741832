"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters of the vocabulary."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import arrow_schema, settle, table

#: A run is damaged where this number divides its checksum.
DAMAGED = 31
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A word's form is so many times as frequent.
TIMES = 10
#: Runs of letters in UTF-8 (A-Z already lower-cased): a-z and U+00C0 to U+00FF, which are the bytes C3 80 to C3 BF.
LETTER = rb"(?:[a-z]|\xc3[\x80-\xbf])"
#: Distinct words, and bytes of words, that a task holds before it passes its counts on.
HELD, HELD_BYTES = 300_000, 1 << 25
#: Words a filter block of 64 bits is made for, and blocks that are broadcast at once (16 MB).
A_BLOCK, AT_ONCE = 2, 1 << 21
#: Longer words share one filter.
LAST_SHARD = 64
#: Edits that a task hashes at once.
PROBES = 1 << 20


def damaged(doc_id: int | None, run: str) -> str:
    """The run without one code point, if its checksum with doc_id says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run if h % DAMAGED else run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)`` of the words of at least ``least_length`` code points that occur ``least_count`` times in ``docs (doc_id, text)``.

    A run is looked at once a document, however often it stands there; tasks count
    before anything moves.
    """
    schema, runs = arrow_schema("word string, n bigint"), re.compile(LETTER + b"{%d,}" % least_length)

    def passed_on(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], schema=schema)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = Counter(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                doc_id, text = doc_id.as_py(), text.as_py()
                if not text:
                    continue
                seed = zlib.crc32(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id))
                for run, n in Counter(runs.findall(text.lower())).items():
                    if zlib.crc32(run, seed) % DAMAGED == 0:
                        whole = run.decode()
                        if len(whole) == least_length:
                            continue
                        run = damaged(doc_id, whole).encode()
                    if run not in counts:
                        held += len(run)
                    counts[run] += n
                if len(counts) > HELD or held > HELD_BYTES:
                    yield passed_on(counts)
                    counts, held = Counter(), 0
        yield passed_on(counts)

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    parts = texts.mapInArrow(count, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _factors(n: int) -> np.ndarray:
    """An odd factor for each position: a word's hash is the sum of its code points times these, mixed."""
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def codes_of(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length).astype(np.uint64)


class Filters:
    """Blocked Bloom filters, one for each word length (one for all beyond LAST_SHARD), laid one after another.

    Blocks have 64 bits; a word sets four of them in one block. The number of
    blocks follows the number of words of that length.
    """

    def __init__(self, sizes: dict[int, int]):
        self.blocks = {shard: max(1, -(-n // A_BLOCK)) for shard, n in sorted(sizes.items())}
        ends = np.cumsum(list(self.blocks.values())).tolist()
        self.begins = dict(zip(self.blocks, [0, *ends[:-1]]))
        self.total = ends[-1] if ends else 0

    def places(self, sums: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Block and bits for the position sums of words of one length; block -1 where no word has that length."""
        shard = min(length, LAST_SHARD)
        h = _mix(sums + np.uint64(length))
        if shard not in self.blocks:
            return np.full(h.shape, -1), h
        block = self.begins[shard] + (((h >> np.uint64(32)) * np.uint64(self.blocks[shard])) >> np.uint64(32)).astype(np.int64)
        bits = np.zeros(h.shape, np.uint64)
        for shift in (0, 6, 12, 18):
            bits |= np.uint64(1) << ((h >> np.uint64(shift)) & np.uint64(63))
        return block, bits


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Lengths, and which of ``words`` have them."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    at = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    for a, b in zip(at, [*at[1:], len(order)]):
        yield int(lengths[order[a]]), order[a:b]


def filled(words: DataFrame, filters: Filters, first: int) -> np.ndarray:
    """The blocks from ``first`` on, AT_ONCE at most, with the bits of all words whose block is among them."""
    schema, last = arrow_schema("block bigint, bits bigint"), min(filters.total, first + AT_ONCE)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            for length, at in _by_length(own):
                for part in np.array_split(at, min(len(at), 1 + len(at) * length // PROBES)):
                    sums = (codes_of([own[k] for k in part], length) * _factors(length)).sum(axis=1, dtype=np.uint64)
                    block, bits = filters.places(sums, length)
                    inside = (block >= first) & (block < last)
                    yield pa.RecordBatch.from_arrays([pa.array(block[inside]), pa.array(bits[inside].view(np.int64))], schema=schema)

    rows = words.select("word").mapInArrow(place, "block bigint, bits bigint").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(last - first, np.uint64)  # AT_ONCE rows at most
    out[rows.column("block").to_numpy() - first] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def edits(words: list[str], length: int, alphabet: np.ndarray, filters: Filters, blocks: np.ndarray, first: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions, rows and letters (-1: deleted) of the edits of words of one length that the filter blocks may hold.

    Of two words that differ by a replaced letter the one with the smaller letter
    finds the other, of two that differ by an inserted one the longer: each pair
    is met once. Hashes of edits come from the word's own in constant time.
    """
    factors, codes = _factors(length), codes_of(words, length)
    terms = codes * factors
    sums = terms.sum(axis=1, dtype=np.uint64)

    def held(sums: np.ndarray, size: int) -> np.ndarray:
        block, bits = filters.places(sums, size)
        inside = (block >= first) & (block < first + len(blocks))
        inside[inside] = (blocks[block[inside] - first] & bits[inside]) == bits[inside]
        return inside

    before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
    moved = codes[:, 1:] * factors[:-1]
    after = np.zeros_like(terms)
    after[:, :-1] = np.cumsum(moved[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
    found = held(before + after, length - 1)
    found[:, 1:] &= codes[:, 1:] != codes[:, :-1]  # of equal neighbours either gives the same word
    row, at = np.nonzero(found)
    yield at, row, np.full(len(row), -1)
    step = max(1, PROBES // (len(words) * max(1, len(alphabet))))
    for a in range(0, length, step):
        own, f = codes[:, a:a + step, None], factors[a:a + step, None]
        found = held(sums[:, None, None] + (alphabet - own) * f, length) & (alphabet > own)
        row, at, letter = np.nonzero(found)
        yield at + a, row, alphabet[letter].astype(np.int64)


def candidates(words: DataFrame, filters: Filters, alphabet: list[int], blocks, first: int) -> DataFrame:
    """``(word, n, edit)``: edits of ``words (word, n)`` that the broadcast ``blocks`` may hold."""
    schema, letters = arrow_schema("word string, n bigint, edit string"), np.array(sorted(alphabet), np.uint64)

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for length, at in _by_length(own):
                for part in np.array_split(at, min(len(at), 1 + len(at) * length * 8 // PROBES)):
                    some = [own[k] for k in part]
                    for place, row, letter in edits(some, length, letters, filters, blocks.value, first):
                        made = [(w := some[r])[:p] + (chr(c) if c >= 0 else "") + w[p + 1:] for p, r, c in zip(place.tolist(), row.tolist(), letter.tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array([some[r] for r in row.tolist()], pa.string()), pa.array(counts[part[row]]), pa.array(made, pa.string())], schema=schema)

    return words.mapInArrow(probe, "word string, n bigint, edit string")


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n, other, m)``: both directions of each pair of ``words (word, n)`` that differ by one edit.

    Filters of all lengths together may outgrow a broadcast; they go out AT_ONCE
    blocks at a time, and each round meets all edits, so none is lost. What a
    filter passes is joined with the vocabulary by equality.
    """
    spark = words.sparkSession
    shard = F.least(F.length("word"), F.lit(LAST_SHARD)).alias("shard")
    filters = Filters({r["shard"]: r["n"] for r in words.groupBy(shard).agg(F.count("*").alias("n")).collect()})  # LAST_SHARD rows at most
    alphabet = [ord(r["letter"]) for r in words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").distinct().collect()]  # 90 letters
    spread = words.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    rounds = []
    for first in range(0, filters.total, AT_ONCE):
        blocks = spark.sparkContext.broadcast(filled(words, filters, first))
        rounds.append(settle(candidates(spread, filters, alphabet, blocks, first), "edits"))
        blocks.destroy()
    if not rounds:
        return spark.createDataFrame([], "word string, n bigint, other string, m bigint")
    found = rounds[0]
    for more in rounds[1:]:
        found = found.union(more)
    real = found.join(words.select(F.col("word").alias("edit"), F.col("n").alias("m")), "edit")
    return real.selectExpr("inline(array(struct(word, n, edit AS other, m), struct(edit AS word, m AS n, word AS other, n AS m)))")


def variants(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each word of ``docs``.

    form is the near word of largest n (ties: smallest in code-point order) where
    that is at least ``times`` the word's n; root follows forms to the last. Each
    step there multiplies n, so doubling the steps ends after a few rounds, of which
    the driver sees one number. A null text has no words; a null doc_id counts as
    an empty one in checksums; repeated rows count each; other columns are ignored;
    an empty table gives an empty result.
    """
    words = settle(word_counts(docs), "words")
    pairs = near_words(words)
    alone = words.selectExpr("word", "n", "CAST(NULL AS STRING) AS other", "CAST(NULL AS BIGINT) AS m")
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("m")).alias("less"), "other")))
    linked = pairs.union(alone).groupBy("word").agg(F.max("n").alias("n"), F.count("other").alias("n_near"), best.alias("best"))
    follows = -F.col("best.less") >= F.lit(times) * F.col("n")
    linked = settle(linked.select(
        "word", "n", "n_near", F.when(follows, F.col("best.other")).alias("form"), F.when(follows, -F.col("best.less")).alias("form_n")
    ), "spelling")
    up = linked.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        jump = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = settle(up.join(jump, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        up = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            break
    return linked.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents and their spelling variants."""
    return variants(table(spark, sf_dir, "documents"))
