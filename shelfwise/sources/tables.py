"""Reading, completing and writing the nine tables."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from shelfwise.functions.dialect import blank_to_null
from shelfwise.functions.scan import number_rows
from shelfwise.model import DEFAULTS, NOW, SCHEMAS, WHO

Tables = Mapping[str, DataFrame]


def load_tables(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    names: Iterable[str] = tuple(SCHEMAS),
    months: tuple[str, str] | None = None,
    blanks: bool | None = None,
    **options,
) -> Tables:
    """Read the tables below ``path`` with their fixed schemas.

    The schemas hold no password column, so it is never read. ``months``, first
    and last as ``2026-01``, reads only those folders of the transactions that
    ``save_tables`` wrote. Empty strings become NULL, as the source database
    stores them; by default only from text formats, because the expression would
    keep filters from reaching a parquet scan.
    """
    tables = {}
    for name in names:
        reader = spark.read.schema(_stored(name)).format(fmt).options(**options)
        if fmt == "csv":
            reader = reader.option("header", options.get("header", "true"))
        df = reader.load(f"{path}/{name}")
        if name == "transactions" and months:
            df = df.filter(F.col("Month").between(*months))
        df = df.select(*[f.name for f in _stored(name)])
        if blanks if blanks is not None else fmt in ("csv", "json", "text"):
            df = _blanks_to_null(df)
        tables[name] = with_subtotal(df) if name == "transaction_items" else df
    return tables


def load_jdbc(spark: SparkSession, url: str, properties: dict[str, str], split: dict[str, tuple[int, int, int]]) -> Tables:
    """Read the tables from a database, each split on its key into parallel ranges.

    ``split`` maps every table to (lowest key, highest key, number of reads), so no
    table is read by one task unasked.
    """
    if missing := set(SCHEMAS) - set(split):
        raise ValueError(f"no split for {', '.join(sorted(missing))}")
    tables = {}
    for name, schema in SCHEMAS.items():
        low, high, parts = split[name]
        df = spark.read.jdbc(
            url, name, column=schema[0].name, lowerBound=low, upperBound=high, numPartitions=parts,
            properties=properties,
        )
        tables[name] = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    return tables


def _stored(name: str) -> T.StructType:
    """Subtotal is derived, not stored."""
    return T.StructType([f for f in SCHEMAS[name] if f.name != "Subtotal"])


def _blanks_to_null(df: DataFrame) -> DataFrame:
    return df.select(
        *[blank_to_null(f.name).alias(f.name) if isinstance(f.dataType, T.StringType) else f.name for f in df.schema]
    )


def with_subtotal(items: DataFrame) -> DataFrame:
    """Quantity times price; NULL where that does not fit the column."""
    return items.withColumn("Subtotal", (F.col("Quantity") * F.col("Unit_Price")).try_cast("decimal(12,2)"))


def apply_defaults(
    df: DataFrame, table: str, now: dt.datetime | Column | None = None, who: str = "system"
) -> DataFrame:
    """Add missing columns and fill NULLs with the table's declared defaults."""
    if now is None:
        now = F.current_timestamp().cast("timestamp_ntz")
    special = {NOW: now if isinstance(now, Column) else F.lit(now), WHO: F.lit(who)}
    present = {c.lower() for c in df.columns}
    columns = []
    for f in _stored(table):
        value = F.col(f.name) if f.name.lower() in present else F.lit(None)
        default = DEFAULTS[table].get(f.name)
        if default is not None:
            value = F.coalesce(value.cast(f.dataType), special.get(default, F.lit(default)))
        columns.append(value.cast(f.dataType).alias(f.name))
    full = df.select(*columns)
    return with_subtotal(full) if table == "transaction_items" else full


def next_key(table: DataFrame, column: str) -> Column:
    """The highest key in use, 0 for an empty table, as a scalar subquery."""
    return F.coalesce(table.agg(F.max(column)).scalar(), F.lit(0))


def assign_keys(df: DataFrame, column: str, start: Column | int, order: list[str]) -> DataFrame:
    """Surrogate keys above ``start`` for new rows, in the given order."""
    return number_rows(df, column, start, order)


def append_rows(df: DataFrame, path: str, fmt: str = "parquet", by: str | None = None) -> None:
    """Append audit or report rows to their store, optionally one folder per value of ``by``."""
    writer = df.write.mode("append").format(fmt)
    (writer.partitionBy(by) if by else writer).save(path)


class BatchLog:
    """A store that rows are appended to batch by batch, each batch once.

    An attempt writes its rows to a folder of its own, and then a commit that names
    the folder. Readers take the rows of committed attempts only: what a broken-off
    attempt left is never seen, and a batch that has its commit is not written again.
    Two attempts at one batch at the same time may both write rows; the commit
    written last counts. With ``by``, rows get one folder per value of that column.
    """

    COMMIT = "batch string, attempt string"

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, by: str | None = None):
        self.spark, self.path, self.schema, self.by = spark, path, schema, by

    def commits(self) -> DataFrame:
        """``(batch, attempt)``, one row for each committed batch."""
        try:
            found = self.spark.read.schema("attempt string, batch string").json(f"{self.path}/commits")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], self.COMMIT)
        return found.filter(F.col("attempt").isNotNull()).select("batch", "attempt")

    def write(self, df: DataFrame, batch: str, attempt: str) -> None:
        """The rows of an attempt; no reader sees them yet."""
        rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(self.by) if self.by else writer).parquet(f"{self.path}/rows/batch={batch}/attempt={attempt}")

    def commit(self, batch: str, attempt: str) -> None:
        named = self.spark.createDataFrame([(attempt,)], "attempt string").coalesce(1)
        named.write.mode("overwrite").json(f"{self.path}/commits/batch={batch}")

    def append(self, df: DataFrame, batch: str) -> bool:
        """Append ``df`` as ``batch``; False if that batch is there already."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError("a batch is named by letters, digits, dots and dashes")
        if not self.commits().filter(F.col("batch") == batch).isEmpty():
            return False
        attempt = uuid.uuid4().hex
        self.write(df, batch, attempt)
        self.commit(batch, attempt)
        return True

    def read(self) -> DataFrame:
        """The rows of all committed batches; folders of other attempts are pruned."""
        kinds = T.StructType([*self.schema.fields, T.StructField("batch", T.StringType()), T.StructField("attempt", T.StringType())])
        commits = self.commits()
        if commits.isEmpty():
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(kinds).parquet(f"{self.path}/rows")
        return rows.join(commits, ["batch", "attempt"], "left_semi").select(*[f.name for f in self.schema])


def save_tables(tables: Tables, path: str, fmt: str = "parquet") -> None:
    """Write the tables as folders below ``path``; ``load_tables`` reads them back.

    Transactions also get a Month folder level, so a report over some months
    prunes the rest.
    """
    for name, df in tables.items():
        stored = df.select(*[f.name for f in _stored(name)])
        if name == "transactions" and fmt == "parquet":
            stored.withColumn("Month", F.date_format("Trans_Date", "yyyy-MM")).write.partitionBy("Month").mode(
                "overwrite"
            ).parquet(f"{path}/{name}")
        else:
            writer = stored.write.mode("overwrite").format(fmt)
            (writer.option("header", "true") if fmt == "csv" else writer).save(f"{path}/{name}")


def save_bucketed(tables: Tables, database: str, buckets: int, path: str | None = None) -> None:
    """Catalog tables in which headers and items share buckets on TransactionID.

    Joins of the two then need no shuffle. Other tables are written plainly. Files
    go below ``path`` where it is given, else to the warehouse. Rows are dealt to the
    buckets before they are written, so a bucket is one file.
    """
    spark = next(iter(tables.values())).sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}" + (f" LOCATION '{path}'" if path else ""))
    for name, df in tables.items():
        bucketed = name in ("transactions", "transaction_items")
        writer = (df.repartition(buckets, "TransactionID") if bucketed else df).write.mode("overwrite").format("parquet")
        if bucketed:
            writer = writer.bucketBy(buckets, "TransactionID").sortBy("TransactionID")
        (writer.option("path", f"{path}/{name}") if path else writer).saveAsTable(f"{database}.{name}")


def catalog_tables(spark: SparkSession, database: str, names: Iterable[str] = tuple(SCHEMAS)) -> Tables:
    return {name: spark.table(f"{database}.{name}") for name in names}
