"""Exact duplicates over an extendible-hash index kept in shared files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import ascii_lower, pick_rows, settle, shared_path, table

#: Most index entries of a bucket before it is split.
CAPACITY = 50_000
#: The directory doubles up to this depth, so it never has more than 2**16 slots.
MAX_DEPTH = 16
#: Bits of the filter that finds texts with copies: 2**18 words of 64 bits at most.
FILTER_WORDS = 1 << 18


def normal(text: Column) -> Column:
    """The text that is compared: null as empty, A-Z lower-cased."""
    return ascii_lower(F.coalesce(text.cast("string"), F.lit("")))


def _slot(depth: int) -> Column:
    """Directory slot of a hash: its first ``depth`` bits."""
    return F.shiftrightunsigned("h", 64 - depth).cast("int")


def directory(entries: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``(slot, depth, bucket)`` for all 2**max_depth slots.

    The directory doubles as long as a bucket of the present depth holds more than
    ``capacity`` entries: a bucket's depth is one more than that of the deepest
    overfull prefix of its slots. Counts of all depths come from one histogram of
    at most 2**max_depth rows. Buckets that are still overfull at the last depth
    stay so; their chains are longer, nothing else changes.
    """
    spark = entries.sparkSession
    histogram = entries.groupBy(_slot(max_depth).alias("slot")).agg(F.count("*").alias("n"))
    levels = histogram.select(
        F.explode(F.sequence(F.lit(0), F.lit(max_depth - 1))).alias("level"), "slot", "n"
    ).groupBy("level", F.expr(f"shiftright(slot, {max_depth} - level)").alias("prefix")).agg(F.sum("n").alias("n"))
    overfull = levels.where(F.col("n") > capacity)
    slots = spark.range(1 << max_depth).select(F.col("id").cast("int").alias("slot"))
    # an overfull prefix covers a run of slots: unfold the few of them, not the many that fit
    split = overfull.select(
        F.explode(F.expr(
            f"sequence(cast(shiftleft(prefix, {max_depth} - level) as int), "
            f"cast(shiftleft(prefix + 1, {max_depth} - level) - 1 as int))"
        )).alias("slot"), (F.col("level") + 1).alias("depth"),
    ).groupBy("slot").agg(F.max("depth").alias("depth"))
    out = slots.join(split, "slot", "left").select("slot", F.coalesce("depth", F.lit(0)).alias("depth"))
    return out.withColumn("bucket", F.expr(f"shiftleft(shiftright(slot, {max_depth} - depth), {max_depth} - depth)"))


def build_index(entries: DataFrame, path: str, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Write the index of ``entries (h, sha, …)`` to ``path``, a folder for each bucket, and read it back.

    Owner tasks take ranges of (bucket, hash), so a bucket that holds many entries
    may have several owners, and entries of one hash lie together, sorted.
    """
    slots = F.broadcast(directory(entries, capacity, max_depth).select("slot", "bucket"))  # 2**max_depth rows at most
    placed = entries.withColumn("slot", _slot(max_depth)).join(slots, "slot").drop("slot")
    placed.repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h").write.partitionBy("bucket").parquet(path)
    return entries.sparkSession.read.schema(placed.schema).parquet(path)


def _groups(docs: DataFrame, capacity: int, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """Narrow rows ``(doc_id, row, h, sha)``, and ``(h, sha, keep, group_size)`` of each text that has copies.

    A first scan writes narrow rows (hash, digest, id). Grouped by hash and digest
    before any of them moves, they are the entries of the index, so a text with
    very many copies is one entry. Entries that stand for several rows name the
    chains to check: a second scan groups whole texts by (hash, text), copies
    again merged before they move, and so compares bytes. A filter of fixed size
    keeps texts without copies out of that; its false hits only cost time. Two
    different texts under one digest end the job, as SHA-256 could not name them.
    """
    spark = docs.sparkSession
    text = normal(F.col("text"))
    rows = settle(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("t")).select(
            "doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64("t").alias("h"),
            F.sha2(F.col("t").cast("binary"), 256).alias("sha"),
        ), "exact-rows",
    )
    entries = rows.groupBy("h", "sha").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("n"))
    index = build_index(entries, shared_path(spark, "exact-index"), capacity, max_depth)
    copied = index.where("n > 1")
    word, bit = F.pmod("h", F.lit(FILTER_WORDS)).alias("word"), F.expr("cast(shiftrightunsigned(h, 58) as int)")
    marks = copied.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 58) as int))")).alias("bits"))
    texts = (
        docs.select(text.alias("t")).withColumn("h", F.xxhash64("t")).withColumn("word", word)
        .join(F.broadcast(marks), "word").where(F.getbit("bits", bit) == 1)  # FILTER_WORDS rows at most
        .groupBy("h", "t").agg(F.count("*").alias("copies"))
    )
    checked = texts.groupBy("h", F.sha2(F.col("t").cast("binary"), 256).alias("sha")).agg(
        F.count("*").alias("texts"), F.sum("copies").alias("copies")
    )
    chains = copied.join(checked, ["h", "sha"], "left").select(
        "h", "sha", "keep",
        F.when((F.col("texts") == 1) & (F.col("copies") == F.col("n")), F.col("n"))
        .otherwise(F.raise_error(F.lit("different texts under one digest"))).alias("group_size"),
    )
    return rows, settle(chains, "exact-chains")  # a table of its own, so a text with many copies is a join that can be split


def duplicates(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null counts as empty. Of equal texts the row with the largest doc_id stays (a
    null id is smaller than any; of rows that repeat an id, exactly one stays).
    Other columns are ignored; an empty table gives an empty result.
    """
    rows, chains = _groups(docs, capacity, max_depth)
    return rows.join(chains, ["h", "sha"], "left").select(
        "doc_id", F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The rows of ``docs``, all columns, that ``duplicates`` keeps."""
    rows, chains = _groups(docs, capacity, max_depth)
    copies = rows.join(chains, ["h", "sha"])  # only texts with copies can name a row that goes or repeats
    same = copies.where(F.col("doc_id").eqNullSafe(F.col("keep.doc_id"))).groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    alone = rows.join(chains, ["h", "sha"], "left_anti").select("doc_id", "h", F.lit(1).cast("bigint").alias("n"))
    return pick_rows(docs, alone.union(same), F.xxhash64(normal(F.col("text"))))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of each group of equal texts stays."""
    return duplicates(table(spark, sf_dir, "documents"))


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
