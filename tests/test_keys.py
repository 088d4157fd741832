"""Unique and foreign keys by bitmaps, against plain counts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import seed
from shelfwise.operators import quality


def shuffled(df):
    """Records that each exchange of the executed plan wrote."""
    df.collect()
    out = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "ShuffleExchangeExec":
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return out


def shop(spark, products, headers, items):
    t = dict(seed.seed_tables(spark))
    t["products"] = spark.createDataFrame([(k,) for k in products], "ProductID long").select(
        "ProductID", *[F.lit(None).cast(f.dataType).alias(f.name) for f in t["products"].schema if f.name != "ProductID"]
    )
    t["transactions"] = spark.createDataFrame([(k,) for k in headers], "TransactionID long").select(
        "TransactionID", *[F.lit(None).cast(f.dataType).alias(f.name) for f in t["transactions"].schema if f.name != "TransactionID"]
    )
    t["transaction_items"] = spark.createDataFrame(
        [(k, h, p) for k, h, p in items], "ItemID long, TransactionID long, ProductID long"
    ).withColumns({f.name: F.lit(None).cast(f.dataType) for f in t["transaction_items"].schema if f.name in ("Quantity", "Unit_Price", "Subtotal")})
    return t


def random_shop(spark, seed_):
    rng = random.Random(seed_)
    wide = [rng.randrange(-2**63, 2**63) for _ in range(60)] + [-2**63, 2**63 - 1, -1, 0, 63, 64, -64, -65]
    some = lambda n: [rng.choice(wide + list(range(-20, 150))) for _ in range(n)]
    items = list(zip(some(800), some(800), some(800)))
    items += [(None, None, rng.choice(wide)), (5, None, 7), (5, 7, None)] + [(9, 8, 10**12)] * 300  # one hot orphan
    return shop(spark, some(100), some(120) + [None], items), items


@pytest.mark.parametrize("seed_, limit", [(0, 1 << 20), (1, 1 << 20), (0, 0), (2, 0)])
def test_orphans_and_copies(spark, monkeypatch, seed_, limit):
    """Whether the words without a parent are broadcast or joined; negative, extreme, hot and null keys."""
    monkeypatch.setattr(quality, "BROADCAST_WORDS", limit)
    t, items = random_shop(spark, seed_)
    held = {name: [r[0] for r in t[name].select(column).collect()] for name, column in (("products", "ProductID"), ("transactions", "TransactionID"))}
    want = Counter()
    for _, h, p in items:
        if h is not None and h not in held["transactions"]:
            want["FOREIGN KEY TransactionID", str(h)] += 1
        if p is not None and p not in held["products"]:
            want["FOREIGN KEY ProductID", str(p)] += 1
    got = {(r.rule, r.value): r.row_count for r in quality.check_all_fks(t).collect() if r.table_name == "transaction_items"}
    assert got == want
    report = {(r.table_name, r.rule): r.violations for r in quality.quality_report(t).collect()}
    for rule in ("FOREIGN KEY TransactionID", "FOREIGN KEY ProductID"):
        assert report["transaction_items", rule] == sum(n for (of, _), n in want.items() if of == rule)
    ids = [k for k, _, _ in items if k is not None]
    assert report["transaction_items", "UNIQUE ItemID"] == len(ids) - len(set(ids))
    keys = [k for k in held["transactions"] if k is not None]
    assert report["transactions", "UNIQUE TransactionID"] == len(keys) - len(set(keys))


def test_only_orphans_move(spark):
    """With 1 % orphans, at most 5 % of the child's rows are shuffled for their values."""
    t = shop(spark, range(1000), range(1000), [(k, k % 1000, k % 1000 if k % 100 else 5000 + k) for k in range(20_000)])
    assert sum(shuffled(quality.check_all_fks(t))) <= 0.05 * 20_000


def test_no_text_and_no_exploded_keys(spark):
    t = shop(spark, range(10), range(10), [(k, k, k) for k in range(10)])
    plan = quality.key_words(t, [("transaction_items", "ItemID"), ("products", "ProductID")])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "as string" not in plan and plan.count("Exchange") == 1


def test_no_violation(spark):
    t = seed.seed_tables(spark)
    assert quality.check_all_fks(t).collect() == [] and quality.quality_report(t).collect() == []


def test_unique_values_are_grouped_by_as_many_tasks_as_their_rows_ask_for(spark, monkeypatch):
    """Many rows are dealt to more tasks; a value of a third of the rows is not dealt to one."""
    monkeypatch.setattr(quality, "PER_TASK", 500)
    rows = [(k,) for k in range(4000)] + [(7,)] * 3000 + [(k,) for k in range(0, 4000, 400)] + [(None,)] * 9
    found = quality.check_unique(spark.createDataFrame(rows, "UserID long").repartition(3), "users", ["UserID"])
    plan = found._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and "15" in plan  # 7,010 rows
    expected = {str(k): 2 for k in range(0, 4000, 400)} | {"7": 3001}
    assert {r.value: r.row_count for r in found.collect()} == expected
    spread = quality._spread([(spark.createDataFrame(rows, "UserID long"), ["UserID"])])
    assert spread[0][0] == 15 and len(spread[0][1]) >= 1
