"""Tokens of documents, packed best-fit into sequences of fixed length."""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import map_slices, settle, table
from shelfwise.llm.token_counts import PreTokens, runs

MAX_TOKENS = 4096
END_ID = 1
#: Pre-tokens whose ids a task remembers before it starts anew.
REMEMBERED = 300_000
#: Texts whose distinct words are looked up together.
ROWS = 1024


class TokenIds(dict):
    """Token ids of pre-tokens, as little-endian unsigned 32-bit bytes, made on first use."""

    def __init__(self, path: str):
        self.cutter = PreTokens(path)

    def __missing__(self, pre_token: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        ids = array("I", self.cutter.token_ids(pre_token)).tobytes()
        if len(pre_token) <= 64:
            self[pre_token] = ids
        return ids

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin and the last ones end.

        Distinct pre-tokens are looked up once for all the texts, then laid out by position.
        """
        cut = self.cutter.cut(texts)
        found = [self[pre_token] for pre_token in cut.pre_tokens.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        own = np.diff(cut.begins)[cut.places]
        order = cut.ids[runs(cut.begins[cut.places], own)]  # pre-tokens in the order of the texts
        ids = np.frombuffer(b"".join(found), np.uint32)[runs((np.cumsum(sizes) - sizes)[order], sizes[order])]
        after, before = np.concatenate(([0], np.cumsum(sizes[order]))), np.concatenate(([0], np.cumsum(own)))
        return ids.astype("<u4", copy=False), after[before[cut.ends]]


@cache
def token_ids(path: str) -> TokenIds:
    return TokenIds(path)


def token_pieces(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every row's ids and ``end_id``, cut where longer than ``max_tokens``."""
    end, wide = end_id.to_bytes(4, "little"), 4 * max_tokens

    def cut(part: pa.RecordBatch) -> list:
        rows = []
        ids, at = token_ids(tokenizer).texts(part.column(1))
        for doc_id, a, b in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
            data = ids[a:b].tobytes() + end
            for piece, begin in enumerate(range(0, len(data), wide)):
                own = data[begin:begin + wide]
                rows.append((doc_id, piece, begin // 4, len(own) // 4, zlib.crc32(own)))
        return list(zip(*rows)) or [[]] * 5

    return map_slices(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), cut,
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint", rows=ROWS,
    )


def best_fit_plan(counts: dict[int, int], max_tokens: int = MAX_TOKENS) -> list[tuple[int, ...]]:
    """Rounds of best fit over length classes: rows ``(length, rank, sequence, each, offset)``.

    Pieces of one length are alike, and so are sequences with one gap, so a round
    matches a whole length class, longest first, with its successor among the
    sorted gaps: the smallest gap that holds it. Pieces of the class claim these
    gaps by rank, as many to a gap as fit, the gaps shrink, and the rest of the
    class goes to the next gap, at last to new sequences. A row says: from rank
    ``rank`` on, ``each`` pieces go to each sequence from ``sequence`` on, the
    first at ``offset``. State and work depend on the number of lengths
    (``max_tokens`` at most), not on the number of documents.
    """
    plan, opened = [], 0
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, number of sequences), sorted

    def place(length: int, rank: int, left: int, gap: int, first: int, number: int) -> int:
        each = gap // length
        whole, rest = min(number, left // each), 0
        if whole < number and left - whole * each:
            rest = left - whole * each
        plan.append((length, rank, first, each, max_tokens - gap))
        if whole and gap - each * length:
            insort(gaps, (gap - each * length, first, whole))
        if rest:
            insort(gaps, (gap - rest * length, first + whole, 1))
        if number - whole - bool(rest):
            insort(gaps, (gap, first + whole + bool(rest), number - whole - bool(rest)))
        return whole * each + rest

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(gaps, (length, -1, -1))
            if at < len(gaps):
                gap, first, number = gaps.pop(at)
            else:
                gap, first, number = max_tokens, opened, -(-left // (max_tokens // length))
                opened += number
            done = place(length, rank, left, gap, first, number)
            rank, left = rank + done, left - done
    return plan


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``pieces`` with sequence_id and offset: best fit, longest pieces first.

    Pieces are range-sorted by length (ties by doc_id and piece, so one frequent
    length spreads over partitions) and numbered within their length: each
    partition numbers its own rows, and counts of earlier partitions are added.
    The driver holds one count for each length, and for each length that spans
    several partitions one for each of those. Rows find their place in the plan by
    length and rank, without another shuffle.
    """

    def numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, run = -1, 0
        for batch in batches:
            length = batch.column("length").to_numpy()
            if not len(length):
                continue
            new = np.flatnonzero(np.diff(length, prepend=last))
            begun = np.zeros(len(length), np.int64)
            begun[new] = new
            rank = np.arange(len(length)) - np.maximum.accumulate(begun)
            rank[:new[0] if len(new) else len(length)] += run
            last, run = length[-1], int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank)], [*batch.schema.names, "rank"])

    keys = ["length", *(name for name in ("doc_id", "piece") if name in pieces.columns)]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    ranged = pieces.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(numbered, f"{kinds}, rank bigint")
    placed = settle(ranged.withColumn("part", F.spark_partition_id()), "packing")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counted = placed.groupBy("length", "part").agg(F.count("*").alias("n"))
    counted = counted.withColumn("before", F.coalesce(before, F.lit(0))).collect()  # lengths + partitions rows at most
    counts: dict[int, int] = {}
    for row in counted:
        counts[row["length"]] = counts.get(row["length"], 0) + row["n"]
    shift = {(row["part"], row["length"]): row["before"] for row in counted if row["before"]}
    plan = np.array(best_fit_plan(counts, max_tokens), np.int64).reshape(-1, 5)
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    sent = placed.sparkSession.sparkContext.broadcast((plan[order], shift))

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, shifts = sent.value
        firsts = {length: (at, end) for length, at, end in zip(*_runs(rows[:, 0]))}
        for batch in batches:
            length, rank, part = (batch.column(c).to_numpy() for c in ("length", "rank", "part"))
            step, rank = np.zeros(len(length), np.int64), rank.copy()
            for value in np.unique(length):
                own = np.flatnonzero(length == value)
                for p in np.unique(part[own]):
                    rank[own[part[own] == p]] += shifts.get((int(p), int(value)), 0)
                at, end = firsts[value]
                step[own] = at + np.searchsorted(rows[at:end, 1], rank[own], "right") - 1
            found = rows[step]
            turn = rank - found[:, 1]
            sequence, offset = found[:, 2] + turn // found[:, 3], found[:, 4] + turn % found[:, 3] * length
            kept = batch.drop_columns(["rank", "part"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], [*kept.schema.names, "sequence_id", "offset"])

    return placed.mapInArrow(put, f"{kinds}, sequence_id bigint, offset bigint")


def _runs(values: np.ndarray) -> tuple[list, list, list]:
    at = np.flatnonzero(np.diff(values, prepend=-1))
    return values[at].tolist(), at.tolist(), [*at[1:].tolist(), len(values)]


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Every piece of every row of ``docs`` with its place in a sequence.

    A null or empty text is the end id alone. Only documents of more than
    ``max_tokens`` ids are cut. Rows with the same doc_id are packed each for
    itself; a null doc_id stays null; other columns are ignored; an empty table
    gives an empty result.
    """
    return pack(settle(token_pieces(docs, tokenizer, max_tokens, end_id), "token-pieces"), max_tokens)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
