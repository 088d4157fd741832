"""Loading, defaults, lookups, writing, and the data-quality jobs."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

import seed
from shelfwise.model import KEYS, SCHEMAS
from shelfwise.operators import changes, quality, report_lines, reports
from shelfwise.sources import tables as src
from shelfwise.sources.lookup import Lookup, ingest_by_lookup


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc"])
def test_write_and_load(spark, tmp_path, fmt):
    t = seed.seed_tables(spark)
    src.save_tables(t, str(tmp_path), fmt)
    back = src.load_tables(spark, str(tmp_path), fmt)
    for name, df in t.items():
        assert [(f.name, f.dataType) for f in back[name].schema] == [(f.name, f.dataType) for f in SCHEMAS[name]]
        assert sorted(back[name].collect(), key=str) == sorted(df.select(*back[name].columns).collect(), key=str)


def test_blank_text_is_null(spark, tmp_path):
    (tmp_path / "category").mkdir()
    (tmp_path / "category" / "a.csv").write_text("CategoryID,Name,Description,IS_ACTIVE,Created_At\n1,A,\"\",1,2026-01-01 00:00:00\n")
    row = src.load_tables(spark, str(tmp_path), "csv", ["category"])["category"].first()
    assert row.Description is None and row.Created_At == dt.datetime(2026, 1, 1)


def test_month_folders_prune(spark, tmp_path):
    src.save_tables(seed.seed_tables(spark), str(tmp_path))
    def read(*months):
        return src.load_tables(spark, str(tmp_path), names=["transactions"], months=months)["transactions"]

    assert "PartitionFilters: [isnotnull(Month" in read("2026-01", "2026-01")._jdf.queryExecution().toString()
    assert read("2026-01", "2026-02").count() == 4 and read("2025-01", "2025-12").count() == 0


def test_buckets_join_without_shuffle(spark):
    src.save_bucketed(seed.seed_tables(spark), "shop", 4)
    t = src.catalog_tables(spark, "shop")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.bucketing.coalesceBucketsInJoin.enabled", "true")
    try:
        joined = t["transaction_items"].join(t["transactions"], "TransactionID")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE shop CASCADE")


@pytest.mark.parametrize("report", ["transaction_history", "category_revenue", "sales_and_returns", "view_transactions_total"])
def test_reports_over_buckets_shuffle_no_items(spark, tmp_path, report):
    plain = seed.seed_tables(spark)
    facts = ("transactions", "transaction_items")
    src.save_bucketed({name: plain[name] for name in facts}, "piles", 4, str(tmp_path))
    t = {**plain, **src.catalog_tables(spark, "piles", facts)}
    ask = plain["users"].select(F.col("UserID").alias("user_id"))
    def run(t):
        return report_lines.view_transactions_total(t, ask) if report == "view_transactions_total" else getattr(reports, report)(t)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        shuffled, free = (run(x)._jdf.queryExecution().executedPlan().toString() for x in (plain, t))
        assert "hashpartitioning(TransactionID" in shuffled and "hashpartitioning(TransactionID" not in free
        assert "Bucketed: true" in free
        assert sorted(map(str, run(t).collect())) == sorted(map(str, run(plain).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE piles CASCADE")


def test_append(spark, tmp_path):
    log = seed.seed_tables(spark)["audit_log"]
    for _ in range(2):
        src.append_rows(log, str(tmp_path / "log"), by="Table_Name")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_batches_are_appended_once(spark, tmp_path):
    """The same batch twice, and an attempt broken off before its commit: each row once."""
    log = seed.seed_tables(spark)["audit_log"]
    store = src.BatchLog(spark, str(tmp_path / "log"), SCHEMAS["audit_log"], by="Table_Name")
    assert store.read().count() == 0
    store.write(log, "2026-01-02", "broken")  # no commit followed
    assert store.read().count() == 0
    assert store.append(log, "2026-01-02") and not store.append(log, "2026-01-02")
    assert store.append(log.withColumn("LogID", F.col("LogID") + 100), "007") and not store.append(log, "007")
    store.write(log, "007", "late")
    got = store.read()
    assert got.columns == log.columns and got.schema.simpleString() == log.schema.simpleString()
    assert sorted(r.LogID for r in got.collect()) == sorted(r.LogID + n for r in log.collect() for n in (0, 100))
    assert sorted(r.batch for r in store.commits().collect()) == ["007", "2026-01-02"]
    with pytest.raises(ValueError):
        store.append(log, "a/b")


def test_commit_that_was_broken_off(spark, tmp_path):
    """A commit folder without a row is no commit; the batch is appended by the next attempt."""
    log = seed.seed_tables(spark)["audit_log"]
    store = src.BatchLog(spark, str(tmp_path), SCHEMAS["audit_log"])
    (tmp_path / "commits" / "batch=1" / "_temporary").mkdir(parents=True)
    assert store.append(log, "1") and store.read().count() == log.count()


def test_defaults(spark):
    rows = spark.createDataFrame([(1, "x")], "LogID long, Table_Name string").withColumn("Operation", F.lit("INSERT"))
    got = src.apply_defaults(rows, "audit_log", seed.NOW, "raj").first()
    assert got.Changed_By == "raj" and got.Change_Date == seed.NOW and got.Old_Value is None


def test_lookup(spark):
    t = seed.seed_tables(spark)
    twice = t["suppliers"].unionByName(t["suppliers"].filter("SupplierID = 1").withColumn("SupplierID", F.lit(9).cast("long")))
    rows = spark.createDataFrame(
        [("Lamp", "Electronics", "TechSource Pvt Ltd"), ("Cup", "Kitchen", "PaperWorld Co."), ("Ink", "Stationery", "Nobody"),
         ("Pad", "Stationery", "PaperWorld Co.")],
        "Name string, cat string, sup string",
    )
    lookups = [
        Lookup(t["category"], "CategoryID", "Name", "cat", "CategoryID"), Lookup(twice, "SupplierID", "Name", "sup", "SupplierID"),
    ]
    out = ingest_by_lookup(rows, lookups)
    assert sorted((r.Name, r.CategoryID, r.SupplierID) for r in out.rows.collect()) == [("Lamp", 1, 1), ("Lamp", 1, 9), ("Pad", 2, 2)]
    assert sorted((r.lookup, r.name) for r in out.unmatched.collect()) == [("cat", "Kitchen"), ("sup", "Nobody")]
    assert [(r.name, r.parents) for r in out.ambiguous.collect()] == [("TechSource Pvt Ltd", 2)]
    clear = ingest_by_lookup(rows, lookups, keep_ambiguous=False)
    assert [(r.Name, r.SupplierID) for r in clear.rows.collect()] == [("Pad", 2)]


def test_headers_and_items_by_name(spark):
    """Headers find their user by name, items their header by its note and their product by name."""
    t = seed.seed_tables(spark)
    wanted = spark.createDataFrame(
        [("staff_arjun", "SALE", "Sale of 2x Wireless Mouse"), ("staff_meera", "RETURN", "Return of 1x A4 Notebook")],
        "username string, Trans_Type string, Notes string",
    )
    found = ingest_by_lookup(wanted, [Lookup(t["users"], "UserID", "Username", "username", "UserID")]).rows
    headers = src.assign_keys(found, "TransactionID", src.next_key(t["transactions"], "TransactionID"), ["Notes"])
    assert sorted((r.TransactionID, r.UserID) for r in headers.collect()) == [(5, seed.MEERA), (6, seed.ARJUN)]
    lines = spark.createDataFrame(
        [("Sale of 2x Wireless Mouse", "Wireless Mouse", 2), ("Return of 1x A4 Notebook", "A4 Notebook", 1)],
        "note string, product string, Quantity long",
    )
    items = ingest_by_lookup(lines, [
        Lookup(headers, "TransactionID", "Notes", "note", "TransactionID"),
        Lookup(t["products"], "ProductID", "Name", "product", "ProductID"),
    ]).rows
    assert sorted((r.TransactionID, r.ProductID, r.Quantity) for r in items.collect()) == [
        (5, seed.NOTEBOOK, 1), (6, seed.MOUSE, 2)
    ]


def test_keys_follow_the_current_maximum(spark):
    t = seed.seed_tables(spark)
    new = spark.createDataFrame([("b",), ("a",)], "Name string")
    keyed = src.assign_keys(new, "ProductID", src.next_key(t["products"], "ProductID"), ["Name"])
    assert sorted((r.ProductID, r.Name) for r in keyed.collect()) == [(9, "a"), (10, "b")]
    first = src.assign_keys(new, "ReportID", src.next_key(t["reports"], "ReportID"), ["Name"])
    assert sorted(r.ReportID for r in first.collect()) == [1, 2]


def test_violations(spark):
    t = seed.seed_tables(spark)
    bad = t["products"].unionByName(
        spark.createDataFrame([(1, None, 77, 1, D("-1.00"), 5, seed.NOW)], t["products"].schema.simpleString()[7:-1].replace(":", " "))
    )
    found = {r.rule: r.violations for r in quality.quality_report({**t, "products": bad}).collect()}
    assert found == {
        "NOT NULL Name": 1, "ABOVE 0 Unit_Price": 1, "VALUE Is_Active": 1, "UNIQUE ProductID": 1, "FOREIGN KEY CategoryID": 1,
    }
    assert set(KEYS) == set(SCHEMAS)


def test_updates(spark):
    t = seed.seed_tables(spark)
    rows = [(1, 2, D("10.00")), (2, 2, D("1399.00")), (3, 2, None), (4, 77, D("1.00"))]
    new = spark.createDataFrame(
        [(i, seed.NOW, p, x) for i, p, x in rows],
        "change_id long, event_ts timestamp_ntz, ProductID long, Unit_Price decimal(10,2)",
    )
    got = {r.ProductID: r.Unit_Price for r in changes.apply_updates(t["products"], new, "ProductID", ["Unit_Price"]).collect()}
    assert got[2] == D("1399.00") and got[1] == D("599.00") and len(got) == 8


def test_scans_read_only_what_they_need(spark, tmp_path):
    src.save_tables(seed.seed_tables(spark), str(tmp_path))
    plan = reports.category_revenue(src.load_tables(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(Trans_Type), EqualTo(Trans_Type,SALE)" in plan
    assert "Notes" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
