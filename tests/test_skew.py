"""A product, user or transaction that holds a third of the facts."""

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import ledger, reports
from shelfwise.session import tune
from shelfwise.sources.retail import retail_tables

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    # at this size all partitions would be merged into one
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "6",
}


@pytest.fixture
def skewed(spark):
    tune(spark)
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    t = dict(retail_tables(spark, "/root/testdata/sf0.01"))
    items = t["transaction_items"].repartition(12)
    t["transaction_items"] = items.withColumn(
        "ProductID", F.when(F.col("ItemID") % 3 == 0, 7).otherwise(F.col("ProductID"))
    )
    yield t
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_product_in_a_join_is_split(skewed):
    assert "skew=true" in final_plan(reports.transaction_history(skewed))


def test_hot_product_in_an_aggregate_is_reduced_first(skewed):
    plan = final_plan(reports.sales_performance(skewed))
    join = plan.index("SortMergeJoin [ProductID")
    assert "HashAggregate(keys=[ProductID" in plan[join:]  # below the join: one row per product meets it


def test_running_stock_with_a_hot_product(spark, skewed):
    """Summed per product, the last running value equals the net movement."""
    stock = skewed["stock_management"]
    got = ledger.stock_from_items(skewed["transaction_items"], skewed["transactions"], stock, blocks=12)
    hot = got.filter("ProductID = 7")
    assert hot.count() > got.count() / 3.5
    net = ledger.net_movement(skewed["transaction_items"], skewed["transactions"], stock)
    want = net.filter("ProductID = 7").first().stock_after
    signed = F.when(F.col("Trans_Type") == "SALE", -F.col("Quantity")).otherwise(F.col("Quantity"))
    start = stock.filter("ProductID = 7").first().Quantity
    rows = sorted((r.TransactionID, r.ItemID, r.running_stock, r.m) for r in hot.withColumn("m", signed).collect())
    assert want == start + sum(r[3] for r in rows)
    assert want in {r[2] for r in rows} and {r[2] - r[3] for r in rows} | {want} == {r[2] for r in rows} | {start}
