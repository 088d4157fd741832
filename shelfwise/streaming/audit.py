"""Audit rows for a stream of changed rows.

A change is (table, seq, before, after): ``before`` and ``after`` are the row's
images as structs, NULL for a row that did not or no longer exists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from shelfwise.operators.audit import audit_product_images, audit_stock_images
from shelfwise.session import tune
from shelfwise.sources.tables import assign_keys
from shelfwise.streaming.batches import Batches, read_folders

ROWS = (
    "LogID bigint, seq {seq}, Table_Name string, Operation string, Record_ID bigint, Old_Value string, "
    "New_Value string, Description string"
)


def _store(spark: SparkSession, base: str, kind: str, compact: int, seq: str) -> Batches:
    return Batches(spark, base, kind, ROWS.format(seq=seq), compact)


def audit_batch(
    changes: DataFrame, batch: int, kind: str, base: str, products: DataFrame | None = None, first_id: int = 1, compact: int = 20
) -> None:
    """Store the audit rows of one micro-batch with the next contiguous range of LogIDs.

    The range begins where the batch before ended, which its pointer tells, so a
    retry gives the same ids and leaves no gap.
    """
    spark = changes.sparkSession
    tune(spark)  # a stream runs in a session of its own
    store = _store(spark, base, kind, compact, changes.schema["seq"].dataType.simpleString())
    start = first_id if batch == 0 else store.pointer(batch - 1)
    if start is None:
        raise ValueError(f"batch {batch} has no batch before it below {base}")
    images = changes.select("seq", F.col("before").alias("o"), F.col("after").alias("n"))
    if kind == "products":
        rows = audit_product_images(images, "seq")
    else:
        updates = images.filter(F.col("o").isNotNull() & F.col("n").isNotNull())
        rows = audit_stock_images(updates, products, "seq")
    order = ["seq", "Record_ID", "Operation", "Old_Value", "New_Value"]
    store.write(assign_keys(rows, "LogID", start - 1, order).select("LogID", *rows.columns), batch)
    store.close(batch, start + read_folders(spark, store.schema, [store.slot(batch)]).count())


def stream_audit(
    changes: DataFrame, kind: str, base: str, products: DataFrame | None = None, first_id: int = 1, compact: int = 20
) -> DataStreamWriter:
    """A writer that audits a change stream of ``products`` or ``stock`` below the shared folder ``base``.

    LogIDs begin at ``first_id``; ``compact`` must stay the same for a folder.
    """
    return (
        changes.writeStream.option("checkpointLocation", f"{base}/progress_{kind}")
        .foreachBatch(lambda df, batch: audit_batch(df, batch, kind, base, products, first_id, compact))
    )


def stream_audit_rows(spark: SparkSession, kind: str, base: str, compact: int = 20, seq: str = "bigint") -> DataFrame:
    """All audit rows stored so far, each once."""
    return _store(spark, base, kind, compact, seq).read()
