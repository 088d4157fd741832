"""Ingest of rows that name their parents instead of carrying ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Lookup:
    """Find ``key`` of ``parent`` by ``name`` equal to the row's ``column``; store it as ``into``."""

    parent: DataFrame
    key: str
    name: str
    column: str
    into: str


@dataclass(frozen=True)
class Resolved:
    rows: DataFrame
    unmatched: DataFrame
    ambiguous: DataFrame


def ingest_by_lookup(df: DataFrame, lookups: list[Lookup], keep_ambiguous: bool = True) -> Resolved:
    """Resolve every lookup.

    ``rows`` keeps the rows whose parents were all found. A name with several
    parents yields one row per parent, as an insert from a join would; without
    ``keep_ambiguous`` rows with such a name are left out, so a row yields one row
    at most. Those names are listed in ``ambiguous`` and the rows without a parent
    in ``unmatched``.
    """
    spark = df.sparkSession
    rows = df
    unmatched, ambiguous = None, None
    for i, look in enumerate(lookups):
        named = look.parent.filter(F.col(look.name).isNotNull()).select(
            F.col(look.name).alias(f"_name{i}"), F.col(look.key).alias(look.into)
        )
        wanted = df.select(F.lit(look.column).alias("lookup"), F.col(look.column).alias("name"))
        # names first: a name repeated in a third of the rows is counted before it is joined
        asked = wanted.groupBy("lookup", "name").agg(F.count(F.lit(1)).alias("row_count"))
        known = named.groupBy(f"_name{i}").agg(F.count(F.lit(1)).alias("parents"))
        missing = asked.join(known, asked["name"] == known[f"_name{i}"], "left_anti")
        several = (
            asked.join(known.filter("parents > 1"), asked["name"] == known[f"_name{i}"])
            .select("lookup", "name", "row_count", "parents")
        )
        unmatched = missing if unmatched is None else unmatched.unionByName(missing)
        ambiguous = several if ambiguous is None else ambiguous.unionByName(several)
        if not keep_ambiguous:
            only = named.groupBy(f"_name{i}").agg(F.max(look.into).alias(look.into), F.count(F.lit(1)).alias("_parents"))
            named = only.filter("_parents = 1").drop("_parents")
        rows = rows.join(named, rows[look.column] == named[f"_name{i}"]).drop(f"_name{i}", look.column)
    if unmatched is None:
        unmatched = spark.createDataFrame([], "lookup string, name string, row_count long")
        ambiguous = spark.createDataFrame([], "lookup string, name string, row_count long, parents long")
    return Resolved(rows, unmatched, ambiguous)
