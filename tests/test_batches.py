"""What a stream stores over many batches: few folders, every row once, ids without gaps."""

import os

import pytest
from pyspark.sql import functions as F

import seed
from shelfwise.model import COMMAND_SCHEMA
from shelfwise.operators import ledger
from shelfwise.session import cut_lineage
from shelfwise.streaming.audit import audit_batch, stream_audit_rows
from shelfwise.streaming.batches import Batches
from shelfwise.streaming.ledger import ledger_batch, stream_decided, stream_stock

SCHEMA = "id bigint, batch bigint"


def rows(spark, batch, n=3):
    return spark.range(batch * n, batch * n + n, 1, 1).select("id", F.lit(batch).cast("long").alias("batch"))


def test_two_hundred_batches(spark, tmp_path):
    """The folders a batch touches stay as many, the ring never grows, and a replayed batch adds nothing."""
    store = Batches(spark, str(tmp_path), "rows", SCHEMA, compact=25)
    for batch in range(200):
        store.write(rows(spark, batch), batch)
        store.close(batch)
        if batch % 40 == 7 or batch % 25 == 0:  # a batch that runs again, also one that merges
            store.write(rows(spark, batch), batch)
            store.close(batch)
        assert len(store.paths(batch)) <= batch // 25 + 25
    assert store.last() == 199
    assert len([d for d in os.listdir(tmp_path / "rows") if d.startswith("slot=")]) == 50
    assert sorted(r.id for r in store.read().collect()) == list(range(600))


def test_unfinished_batch_is_not_read(spark, tmp_path):
    store = Batches(spark, str(tmp_path), "rows", SCHEMA, compact=2)
    assert store.last() is None and store.read().count() == 0
    for batch in range(5):
        store.write(rows(spark, batch), batch)
        if batch < 4:
            store.close(batch)
    assert store.last() == 3 and store.read().count() == 12
    assert store.pointer(3) == 0 and store.pointer(4) is None


def test_a_side_can_be_missing(spark, tmp_path):
    """While one side of the pointer is replaced the other one is read."""
    store = Batches(spark, str(tmp_path), "rows", SCHEMA, compact=3)
    for batch in range(3):
        store.write(rows(spark, batch), batch)
        store.close(batch)
    os.rename(tmp_path / "rows_pointer" / "side=0", tmp_path / "aside")
    assert store.last() == 1 and store.read().count() == 6


def test_log_ids_without_gaps(spark, tmp_path):
    """Fifty batches of changing sizes, some run twice."""
    t, base = seed.seed_tables(spark), str(tmp_path)
    image = F.struct(*t["stock_management"].columns)
    after = F.struct(*[(F.col("Quantity") + 1).alias(c) if c == "Quantity" else F.col(c) for c in t["stock_management"].columns])
    feed = t["stock_management"].select(F.col("ProductID").alias("seq"), image.alias("before"), after.alias("after")).cache()
    want = 0
    for batch in range(50):
        part = feed.filter(F.col("seq") <= batch % 4)
        for _ in range(2 if batch % 10 == 3 else 1):
            audit_batch(part, batch, "stock", base, t["products"], first_id=100, compact=8)
        want += part.count()
    ids = sorted(r.LogID for r in stream_audit_rows(spark, "stock", base, 8).collect())
    assert ids == list(range(100, 100 + want))


def test_missing_batch_is_told(spark, tmp_path):
    t = seed.seed_tables(spark)
    feed = spark.createDataFrame([], "seq long, before struct<ProductID:long,Quantity:long>, after struct<ProductID:long,Quantity:long>")
    with pytest.raises(ValueError):
        audit_batch(feed, 3, "stock", str(tmp_path), t["products"])


def test_ledger_over_many_batches(spark, tmp_path):
    t, base = seed.seed_tables(spark), str(tmp_path)
    cmds = [(k, seed.NOW, 1, 1 + k % 3, 1 + k % 4, ("SALE", "RESTOCK", "RETURN")[k % 3], None, None) for k in range(36)]
    for batch in range(12):
        part = spark.createDataFrame(cmds[3 * batch:3 * batch + 3], COMMAND_SCHEMA)
        for _ in range(2 if batch in (4, 7) else 1):
            ledger_batch(part, batch, t, base, compact=4)
    whole = ledger.apply_stock_commands(spark.createDataFrame(cmds, COMMAND_SCHEMA), t)
    assert seed.stock_of({"stock_management": stream_stock(spark, base, t["stock_management"], 4)}) == seed.stock_of({"stock_management": whole.stock})
    assert sorted(r.cmd_id for r in stream_decided(spark, base, 4).collect()) == list(range(36))


def test_a_batch_leaves_only_what_it_stores(spark, tmp_path):
    t = seed.seed_tables(spark)
    cmds = spark.createDataFrame([(k, seed.NOW, 1, 1 + k % 3, 1, "SALE", None, None) for k in range(40)], COMMAND_SCHEMA)
    cut_lineage(cmds.limit(1))  # the folder is made
    before = seed.left_on_disk(spark)
    for batch in range(3):
        ledger_batch(cmds, batch, t, str(tmp_path), compact=2)
    assert not seed.left_on_disk(spark) - before
    assert stream_decided(spark, str(tmp_path), 2).count() == 120
