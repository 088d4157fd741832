"""Near-duplicates by SimHash and deletion variants of fingerprint halves."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import map_slices, pick_rows, settle, table
from shelfwise.llm.components import components

SHINGLE = 3
DISTANCE = 2
#: Fingerprints that share a variant key are compared in pairs up to this number; beyond it two bits are deleted.
PAIRED = 128
#: Shingles whose bits are counted at once.
BLOCK = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the word shingles (A-Z lower-cased, split at ASCII white space); 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - shingle + 1)
    spans = zip(starts[:last].tolist(), ends[min(shingle, len(words)) - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, last)
    ones = np.zeros(64, np.int64)
    for at in range(0, last, BLOCK):
        bits = np.unpackbits(hashes[at:at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(ones * 2 > last)
    return int.from_bytes(packed.tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, h, fp)``, one row for each row of ``docs``; h is a hash of the text."""
    return map_slices(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text")
        ),
        lambda part: [part.column(0), part.column(1), [fingerprint(t, shingle) for t in part.column(2).to_pylist()]],
        "doc_id bigint, h bigint, fp bigint",
    )


def _half(at: str, fp: str = "fp") -> str:
    """The 32 bits in which bit ``at`` of the fingerprint lies."""
    return f"(shiftrightunsigned({fp}, 32 * ({at} div 32)) & 4294967295)"


def _cliques(rows: DataFrame) -> DataFrame:
    """Edges among fingerprints that agree but for bits ``i`` and ``j``.

    At most four fingerprints agree so, whatever the input; a mask of the bit
    pairs present tells them all, and each is tied to the first one.
    """
    bit_i, bit_j = "shiftleft(1L, i)", "shiftleft(1L, j)"
    seen = rows.select(
        "i", "j", F.expr(f"fp & ~({bit_i} | {bit_j})").alias("base"),
        F.expr("shiftleft(1, cast(2 * (shiftrightunsigned(fp, i) & 1) + (shiftrightunsigned(fp, j) & 1) as int))").alias("bit"),
    ).groupBy("i", "j", "base").agg(F.bit_or("bit").alias("mask")).where("bit_count(mask) > 1")
    members = seen.withColumn("members", F.expr(
        "transform(filter(array(0, 1, 2, 3), k -> getbit(mask, k) = 1), "
        f"k -> base | if(k >= 2, {bit_i}, 0L) | if(k % 2 = 1, {bit_j}, 0L))"
    ))
    return members.select(F.col("members")[0].alias("a"), F.explode(F.slice("members", 2, 3)).alias("b"))


def links(fps: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs of distinct ``fp`` at 2 or fewer differing bits.

    Of two halves at least one differs in one bit at most, so the pair shares the
    key "half without bit i" for some i: 64 keys a fingerprint, joined by equality
    and verified. Where more than ``paired`` fingerprints share a key, pairs would
    grow with the square: there a second bit is deleted, after which fingerprints
    with equal keys are at 2 bits or fewer, so a few edges tie each group. Both
    ways are exact.

    Keys are 64 times as many rows as Spark's estimate from ``fps`` says, so joins of
    them are told to sort: a size threshold would send them to the driver.
    """
    keys = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select(
        "fp", "i", F.expr(f"shiftleft(cast(i as bigint), 32) | ({_half('i')} & ~shiftleft(1L, i % 32))").alias("key")
    )
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = settle(keys.hint("merge").join(shared.hint("merge"), "key"), "simhash-members")
    few = members.where(F.col("n") <= paired).select("key", "fp", "i")
    other = few.select("key", F.col("fp").alias("fq"))
    near = few.hint("merge").join(other.hint("merge"), "key").where(
        f"fp < fq and bit_count(fp ^ fq) <= {DISTANCE} and "  # a pair counts at the bit it differs in, or at the first
        f"({_half('i')} ^ {_half('i', 'fq')}) = if({_half('i')} = {_half('i', 'fq')}, if(i % 32 = 0, 0L, 1L), shiftleft(1L, i % 32))"
    ).select(F.col("fp").alias("a"), F.col("fq").alias("b"))
    many = members.where(F.col("n") > paired).select("fp", "i")
    across = many.select(
        "fp", "i", F.explode(F.expr("transform(sequence(0, 31), q -> 32 * (1 - i div 32) + q)")).alias("j")
    ).selectExpr("fp", "cast(least(i, j) as int) i", "cast(greatest(i, j) as int) j")
    within = many.where("i % 32 = 0").select("fp", F.explode(F.expr(
        "flatten(transform(sequence(0, 30), p -> transform(sequence(p + 1, 31), q -> "
        "struct(cast(32 * (1 - i div 32) + p as int) as i, cast(32 * (1 - i div 32) + q as int) as j))))"
    )).alias("at")).selectExpr("fp", "at.i", "at.j")
    return near.union(_cliques(across.union(within)))


def _linked(docs: DataFrame, shingle: int) -> DataFrame:
    """``(doc_id, h, fp, root)``, one row for each row of ``docs``; rows with one root are one component."""
    spark, prints = docs.sparkSession, settle(fingerprints(docs, shingle), "simhash")
    # narrow rows, but each becomes 64: a number of tasks of its own, which adaptive execution doesn't merge
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = prints.select("fp").distinct().repartition(tasks)
    roots = settle(components(links(distinct)), "simhash-roots").withColumnRenamed("node", "fp")
    return prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row for each row of ``docs``.

    component_id is the smallest doc_id reachable over links of 2 or fewer
    differing bits. Null and empty texts have fingerprint 0 and link like any
    other; a row without doc_id gets the component of its text (null if no row in
    it has an id); repeated rows stay; other columns are ignored; an empty table
    gives an empty result. Distinct fingerprints are linked, so any number of
    copies costs one row.
    """
    rows = _linked(docs, shingle).drop("h")
    # a table of its own, so a component with many rows is a join that can be split
    named = settle(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "simhash-named")
    return rows.join(named, "root").select("doc_id", "fp", "component_id")


def first_of_each(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with the smallest doc_id of each root of ``linked (doc_id, h, root)``; ids before null."""
    seen = linked.groupBy("root", "doc_id", "h").agg(F.count("*").alias("n"))
    first = seen.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h", "n")).alias("first"))
    return pick_rows(docs, settle(first.select("first.doc_id", "first.h", "first.n"), "simhash-kept"), F.xxhash64("text"))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns, with the smallest doc_id of their component: one for each component.

    Rows without an id stay only where no row of the component has one.
    """
    return first_of_each(docs, _linked(docs, shingle))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
