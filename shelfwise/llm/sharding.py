"""Placement of rows in shards by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import table

#: Slots of the table: a prime, about a thousand for each shard, so shards differ by a thousandth.
SLOTS = 65537
SHARDS = tuple(f"shard-{k:02d}" for k in range(64))


def _number(text: str, below: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % below


def lookup_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """For each slot the place of its shard in ``shards``.

    Each shard prefers slots in an order of its own: an offset and a step, hashes
    of its name, which visit every slot as ``slots`` is prime. Shards take turns;
    in its turn a shard claims the first slot of its order that is free. Shards
    get equal numbers of slots, give or take one, and when a shard comes or goes
    few other slots change hands. The work depends on ``slots`` alone.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must have different names")
    if slots < len(shards) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime number, and no smaller than the number of shards")
    at = [_number(f"{name}/offset", slots) for name in shards]
    step = [_number(f"{name}/step", slots - 1) + 1 for name in shards]
    owner, left = [-1] * slots, slots
    while left:
        for shard in range(min(len(shards), left)):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % slots
            owner[at[shard]] = shard
            left -= 1
    return owner


def slot_of(keys: list[Column], slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def place(df: DataFrame, keys: list[Column], shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard``. No row moves: the table, ``slots`` rows, is broadcast and joined by slot."""
    spark, owner = df.sparkSession, lookup_table(shards, slots)
    text = ",".join(map(str, owner))
    names = F.array(*[F.lit(name) for name in shards])
    lookup = spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "owner")).select(
        "slot", F.element_at(names, F.col("owner").cast("int") + 1).alias("shard")
    )
    return df.withColumn("slot", slot_of(keys, slots)).join(F.broadcast(lookup), "slot")


def place_documents(docs: DataFrame, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``(doc_id, slot, shard)`` for each row of ``docs``.

    Placed by doc_id; a row without one by its text, so rows without ids spread as
    well. Repeated rows share a shard; other columns are ignored; an empty table
    gives an empty result.
    """
    small = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("text_hash")
    )
    return place(small, [F.col("doc_id"), F.col("text_hash")], shards, slots).select("doc_id", "slot", "shard")


def write_shards(placed: DataFrame, path: str, files: int = 1) -> None:
    """Write ``placed`` (rows with a ``shard`` column) as a folder for each shard, in ``files`` files each."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in placed.columns]), F.lit(files))
    placed.repartition("shard", salt).write.partitionBy("shard").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return place_documents(table(spark, sf_dir, "documents"))
