"""What a stream stores, batch by batch, in a number of folders that does not grow with every batch.

Spark numbers micro-batches 0, 1, 2, … and runs them in order; after a failure
the last one runs again. So paths follow from the number alone and nothing is listed:

* a batch goes to a slot of a ring of ``2 * compact`` folders, which a retry overwrites;
* when a span of ``compact`` batches is complete, the next batch first merges its
  slots into one folder, again by overwriting, before the ring comes round to them;
* a pointer tells the last batch that is whole. It has two sides that are written in
  turn, so one stays readable while the other is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

POINTER = "batch bigint, next_id bigint"


def read_folders(spark: SparkSession, schema: T.StructType | str, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("ignoreMissingFiles", "true").parquet(*paths)


class Batches:
    """The stored rows of one stream below ``base``."""

    def __init__(self, spark: SparkSession, base: str, name: str, schema: T.StructType | str, compact: int = 20):
        if compact < 1:
            raise ValueError("compact must be 1 or more")
        self.spark, self.base, self.name, self.schema, self.compact = spark, base, name, schema, compact

    def slot(self, batch: int) -> str:
        return f"{self.base}/{self.name}/slot={batch % (2 * self.compact)}"

    def span(self, k: int) -> str:
        return f"{self.base}/{self.name}_spans/span={k}"

    def side(self, batch: int) -> str:
        return f"{self.base}/{self.name}_pointer/side={batch % 2}"

    def write(self, rows: DataFrame, batch: int) -> None:
        """Store the batch's rows; a retry replaces them."""
        rows.write.mode("overwrite").parquet(self.slot(batch))

    def close(self, batch: int, next_id: int = 0) -> None:
        """The batch is whole: merge the span before it if it is the first of its own, and move the pointer."""
        if batch and batch % self.compact == 0:
            k = batch // self.compact - 1
            merged = read_folders(self.spark, self.schema, self.slots(k * self.compact, batch - 1))
            merged.hint("rebalance").write.mode("overwrite").parquet(self.span(k))
        self.spark.createDataFrame([(batch, next_id)], POINTER).coalesce(1).write.mode("overwrite").parquet(self.side(batch))

    def slots(self, first: int, last: int) -> list[str]:
        return [self.slot(b) for b in range(first, last + 1)]

    def pointer(self, batch: int) -> int | None:
        """The first id after ``batch``; None if that batch is not the one its side tells of."""
        row = self._told([self.side(batch)])
        return row[1] if row and row[0] == batch else None

    def last(self) -> int | None:
        """The last batch that is whole."""
        row = self._told([self.side(0), self.side(1)])
        return row[0] if row else None

    def _told(self, paths: list[str]) -> tuple[int, int] | None:
        found = []
        for path in paths:
            try:
                found += read_folders(self.spark, POINTER, [path]).collect()  # one row
            except Exception as error:  # the side was never written, or is being replaced
                if "PATH_NOT_FOUND" not in str(error):
                    raise
        return max(map(tuple, found), default=None)

    def paths(self, last: int | None) -> list[str]:
        """The folders of all batches up to ``last``: merged spans, then slots."""
        if last is None:
            return []
        spans = last // self.compact
        return [self.span(k) for k in range(spans)] + self.slots(spans * self.compact, last)

    def read(self) -> DataFrame:
        """All rows stored so far, each once."""
        return read_folders(self.spark, self.schema, self.paths(self.last()))
