"""From raw documents to packed sequences: the stages, one after the other, each over all its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import decontaminate, exact_dedup, language_id, packing, simhash
from shelfwise.llm.common import settle, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay."""
    return language_id.drop_unknown(docs)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose SimHash fingerprints link one row stays."""
    return simhash.drop_near_duplicates(docs, simhash.SHINGLE)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of packed sequences."""
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_known),
    ("exact_dedup", drop_exact),
    ("simhash_dedup", drop_near),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Learned models, iterated components and a tokenizer: no SQL for the rows of ``run``.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each writes a table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
