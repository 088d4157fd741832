"""Connected components of an edge table, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import settle


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; root is the smallest node it reaches.

    Alternates two steps until the edges stand still, which takes a logarithmic
    number of rounds: hang a node's larger neighbours below its smallest one, then
    hang it and its smaller neighbours below that. Minima are aggregated before
    they are joined back, so a node with very many neighbours is a skewed join
    that adaptive execution splits, never one task. The driver sees two numbers a round.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    pairs, before = settle(pairs, "edges"), None
    while True:
        now = tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                pairs.select("b", "b").distinct()
            )
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        low = large.join(least, "a")
        small = low.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.union(least.select("a", "m")).distinct()
        pairs, before = settle(small, "edges"), now
