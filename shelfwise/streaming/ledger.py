"""The ledger and the audit log over an unbounded feed.

Both use ``foreachBatch``: a micro-batch runs through the batch operators, so a
product with a third of a batch is spread over tasks exactly as in a batch run.
State and results lie in folders that follow from the batch's number, which a
retried batch overwrites: no row is applied or written twice, and no folder listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter

from shelfwise.functions.dialect import nvl
from shelfwise.model import COMMAND_SCHEMA, LONG, PRICE, TEXT
from shelfwise.operators.ledger import attach_facts, decide, judge
from shelfwise.session import noting, releasing, remove, tune
from shelfwise.sources.tables import Tables
from shelfwise.streaming.batches import Batches, read_folders

HASHED = "64m"  # shuffled bytes of a partition up to which a join hashes it instead of sorting both sides
STATE = "ProductID bigint, Quantity bigint, last_ts timestamp_ntz, batch bigint"
DECIDED = T.StructType(
    [*COMMAND_SCHEMA.fields] + [
        T.StructField(name, kind) for name, kind in {
            "product_name": TEXT, "Unit_Price": PRICE, "category_name": TEXT, "stock_start": LONG, "effect": LONG,
            "stock_before": LONG, "stock_after": LONG, "accepted": T.BooleanType(), "code": TEXT, "message": TEXT,
            "warning": TEXT, "late": T.BooleanType(),
        }.items()
    ]
)


def _decided(spark: SparkSession, base: str, compact: int) -> Batches:
    return Batches(spark, base, "decided", DECIDED, compact)


def _states(spark: SparkSession, base: str, compact: int) -> Batches:
    return Batches(spark, base, "state", STATE, compact)


def _state(spark: SparkSession, base: str, before: int, compact: int) -> DataFrame:
    """Saved state as of the batches before ``before``: the last full one and what came after it."""
    states = _states(spark, base, compact)
    full = max(before - 1, 0) // compact * compact
    return read_folders(spark, STATE, states.slots(full, before - 1))


def _latest(state: DataFrame) -> DataFrame:
    return state.groupBy(F.col("ProductID").alias("_moved")).agg(
        F.max_by("Quantity", "batch").alias("_now"), F.max_by("last_ts", "batch").alias("_at")
    )


def current_stock(spark: SparkSession, base: str, stock: DataFrame, before: int, compact: int) -> DataFrame:
    """(ProductID, Quantity, last_ts) after the batches before ``before``.

    A batch writes the products it moved; every ``compact``-th one writes all
    products moved so far, so at most ``compact`` folders are read.
    """
    latest = _latest(_state(spark, base, before, compact))
    return stock.join(latest, F.col("ProductID") == F.col("_moved"), "left").select(
        "ProductID", nvl("_now", F.col("Quantity")).alias("Quantity"), F.col("_at").alias("last_ts")
    )


def ledger_batch(
    cmds: DataFrame, batch: int, t: Tables, base: str, rules: str = "package", compact: int = 20
) -> None:
    """Decide one micro-batch and store its results and the stock it leaves; what it set aside meanwhile is removed."""
    spark = cmds.sparkSession
    with noting() as aside, releasing(spark):
        try:
            _ledger_batch(spark, cmds, batch, t, base, rules, compact)
        finally:
            remove(spark, aside)


def _ledger_batch(spark: SparkSession, cmds: DataFrame, batch: int, t: Tables, base: str, rules: str, compact: int) -> None:
    tune(spark)  # a stream runs in a session of its own
    # what commands are joined to is small once shuffled: hashed, it spares sorting them, twice as their ranges are sampled
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", HASHED)
    state = current_stock(spark, base, t["stock_management"], batch, compact)
    asked = cmds.select(F.col("product_id").alias("_asked")).distinct()
    near = state.join(asked, F.col("ProductID") == F.col("_asked"), "left_semi")  # what the batch can touch
    facts = attach_facts(cmds, {**t, "stock_management": near})
    last = near.select(F.col("ProductID").alias("_seen"), "last_ts")
    facts = facts.join(last, F.col("product_id") == F.col("_seen"), "left")
    # no rule refuses late events: they are applied on arrival and marked
    marked = facts.withColumn("late", nvl(F.col("event_ts") < F.col("last_ts"), False)).drop("_seen", "last_ts")
    decided = decide(judge(marked, rules), rules).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DECIDED])
    store, states = _decided(spark, base, compact), _states(spark, base, compact)
    store.write(decided, batch)
    done = read_folders(spark, DECIDED, [store.slot(batch)])
    moved = done.filter("accepted AND effect <> 0").groupBy(F.col("product_id").alias("_moved")).agg(
        F.sum("effect").alias("_net"), F.max("event_ts").alias("_at")
    )
    full = batch % compact == 0
    merged = (state if full else near).join(moved, F.col("ProductID") == F.col("_moved"), "left").select(
        "ProductID", (F.col("Quantity") + nvl("_net", 0)).alias("Quantity"),
        F.greatest("last_ts", "_at").alias("last_ts"), F.col("_moved").isNotNull().alias("_now"),
    )
    keep = F.col("last_ts").isNotNull() if full else F.col("_now")
    states.write(merged.filter(keep).drop("_now").withColumn("batch", F.lit(batch).cast("long")), batch)
    store.close(batch)


def stream_ledger(
    commands: DataFrame, t: Tables, base: str, rules: str = "package", compact: int = 20
) -> DataStreamWriter:
    """A writer that applies a command stream; start it with a trigger of your choice.

    ``base`` is a shared folder: ``decided/`` and ``decided_spans/`` collect every
    command with its verdict (``stream_decided`` reads them), ``state/`` the stock,
    ``progress/`` the stream's own position. ``compact`` must stay the same for a folder.
    """
    return (
        commands.writeStream.option("checkpointLocation", f"{base}/progress")
        .foreachBatch(lambda df, batch: ledger_batch(df, batch, t, base, rules, compact))
    )


def stream_decided(spark: SparkSession, base: str, compact: int = 20) -> DataFrame:
    """Every command the stream has decided so far, once."""
    return _decided(spark, base, compact).read()


def stream_stock(spark: SparkSession, base: str, stock: DataFrame, compact: int = 20) -> DataFrame:
    """The stock after everything the stream has applied so far."""
    last = _decided(spark, base, compact).last()
    latest = _latest(_state(spark, base, 0 if last is None else last + 1, compact))
    return stock.join(latest, F.col("ProductID") == F.col("_moved"), "left").select(
        "StockID", "ProductID", nvl("_now", F.col("Quantity")).alias("Quantity"), "Restock_Level",
        F.coalesce("_at", "Last_Updated").alias("Last_Updated"),
    )
