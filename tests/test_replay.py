"""The golden list of events, the batch operators and the streams."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

import seed
from seed import (
    ARJUN, CHAIR, CRT, HEADPHONES, HUB, KEYBOARD, MEERA, MOUSE, NOTEBOOK, NOW, OIL, PENS, PRIYA, RICE,
)
from shelfwise.model import COMMAND_SCHEMA
from shelfwise.operators import audit, changes, ledger, report_lines, reports
from shelfwise.plans import replay as plan_module
from shelfwise.plans.replay import replay
from shelfwise.session import cut_lineage
from shelfwise.streaming.audit import stream_audit, stream_audit_rows
from shelfwise.streaming.ledger import ledger_batch, stream_decided, stream_ledger, stream_stock

AFTER = {
    7: {MOUSE: 23, HUB: 20, HEADPHONES: 8, NOTEBOOK: 51, PENS: 3, RICE: 30, OIL: 12, CRT: 2},
    15: {MOUSE: 23, HUB: 18, HEADPHONES: 33, NOTEBOOK: 51, PENS: 3, RICE: 30, OIL: 12, CRT: 2, KEYBOARD: 15},
    19: {MOUSE: 23, HUB: 18, HEADPHONES: 33, NOTEBOOK: 51, PENS: 3, RICE: 28, OIL: 12, CRT: 2, KEYBOARD: 15},
    28: {MOUSE: 23, HUB: 18, HEADPHONES: 33, NOTEBOOK: 51, PENS: 3, RICE: 28, OIL: 12, CRT: 2, KEYBOARD: 15, CHAIR: 28},
}
HEADERS = {7: 7, 15: 10, 19: 11, 28: 15}


@pytest.mark.parametrize("upto,blocks", [(7, None), (15, None), (19, None), (28, 5)])
def test_events(spark, upto, blocks):
    numbers = [n for n in seed.EVENTS if n <= upto]
    out = replay(seed.event_log(spark, numbers), seed.seed_tables(spark), blocks=blocks)
    assert seed.stock_of(out.tables) == AFTER[upto]
    assert out.tables["transactions"].count() == HEADERS[upto]
    status = {r.cmd_id: (r.status, r.code) for r in out.outcomes.collect()}
    assert len(status) == len(numbers)
    want = {2: "-20031", 5: "-20025", 11: "-20021", 18: "-20025", 27: "-20025"}
    assert {n: c for n, (s, c) in status.items() if c} == {n: c for n, c in want.items() if n <= upto}
    assert status[7] == ("no-op", None)
    if upto == 7:
        alerts = report_lines.stock_alert_reports(out.tables, 1, NOW).collect()
        assert [r.Report_Data for r in alerts] == [
            "Product: Bluetooth Headphones | Category: Electronics | Stock: 8 | Needed: 2",
            "Product: Ballpoint Pen Pack | Category: Stationery | Stock: 3 | Needed: 22",
        ]
        assert [r.ReportID for r in alerts] == [1, 2]
    if upto == 19:
        health = dict(tuple(r) for r in reports.health_metrics(out.tables).collect())
        assert health["Total Sales Revenue (Rs.)"] == "7158" and health["Total Returns (Rs.)"] == "1469"
        assert health["Total Products"] == "9" and health["Active Categories"] == "0"
        price = out.tables["products"].filter(f"ProductID = {HUB}").first().Unit_Price
        assert price == D("1399.00")
    if upto == 28:
        assert reports.restock_alert_supplier(out.tables).count() == 0
        sold = {r.Product: (r.Times_Sold, r.Total_Units_Sold, r.Total_Revenue, r.Avg_Sale_Value)
                for r in reports.sales_performance(out.tables).collect()}
        assert sold["Ergonomic Chair"] == (2, 3, D("26997.00"), D("13498.50"))
        assert sold["Wireless Mouse"] == (2, 4, D("2396.00"), D("1198.00")) and sold["USB-C Hub"][2] == D("3897.00")
        stock = {r.Category: r.Total_Stock for r in reports.category_health(out.tables).collect()}
        assert stock == {"Discontinued": 2, "Electronics": 89, "Furniture": 28, "Grocery": 40, "Stationery": 54}
        users = {r.Username: r.Total_Value_Handled for r in reports.user_activity(out.tables).collect()}
        assert users["staff_arjun"] == D("34155.00") and users["staff_meera"] == D("10468.00")


def test_state_holds_from_its_place_in_the_log(spark, monkeypatch):
    events = {
        1: dict(cmd_type="SALE", user_id=ARJUN, product_id=50, quantity=1),  # not added yet
        2: dict(cmd_type="CATEGORY_OFF", category_id=7),  # not added yet
        3: dict(cmd_type="SET_PRICE", product_id=50, unit_price=D("1.00")),  # touches no row
        4: dict(cmd_type="ADD_CATEGORY", category_id=7, name="Toys"),
        5: dict(cmd_type="ADD_CATEGORY", category_id=8, name="Toys"),
        6: dict(cmd_type="ADD_PRODUCT", product_id=51, category_id=7, supplier_id=9, name="Kite", unit_price=D("5.00")),
        7: dict(cmd_type="ADD_SUPPLIER", supplier_id=9, name="ToyHouse", contact="1"),
        8: dict(cmd_type="ADD_SUPPLIER", supplier_id=10, name="ToyHouse", contact="1"),
        9: dict(
            cmd_type="ADD_PRODUCT", product_id=50, category_id=7, supplier_id=9, name="Ball", unit_price=D("5.00"), quantity=4
        ),
        10: dict(cmd_type="SALE", user_id=ARJUN, product_id=50, quantity=2),
        11: dict(cmd_type="SET_PRICE", product_id=50, unit_price=D("6.00")),
        12: dict(cmd_type="SALE", user_id=ARJUN, product_id=50, quantity=1),
        13: dict(cmd_type="CATEGORY_OFF", category_id=7),
        14: dict(cmd_type="RESTOCK", user_id=PRIYA, product_id=50, quantity=9),
        15: dict(cmd_type="CATEGORY_ON", category_id=7),
        16: dict(cmd_type="RESTOCK", user_id=PRIYA, product_id=50, quantity=9),
        17: dict(cmd_type="ADD_PRODUCT", product_id=52, category_id=77, supplier_id=9, name="Top", unit_price=D("5.00")),
        18: dict(cmd_type="DANCE", user_id=PRIYA, product_id=50, quantity=9),
        19: dict(cmd_type="SET_PRICE", product_id=50, unit_price=D("-6.00")),
    }
    monkeypatch.setattr(seed, "EVENTS", events)
    out = replay(seed.event_log(spark, events), seed.seed_tables(spark), blocks=4)
    got = {r.cmd_id: (r.status, r.code) for r in out.outcomes.collect()}
    applied, idle = ("applied", None), ("no-op", None)

    def no(code):
        return ("rejected", code)

    assert got == {
        1: no("-20030"), 2: no("-20026"), 3: idle, 4: applied, 5: no("UNIQUE_NAME"), 6: no("-20022"), 7: applied,
        8: no("-20023"), 9: applied, 10: applied, 11: applied, 12: applied, 13: applied, 14: no("-20025"), 15: applied,
        16: applied, 17: no("-20020"), 18: no("-20004"), 19: no("CHK_PRICE"),
    }
    new = out.ledger.transactions.orderBy("TransactionID").collect()
    assert [(r.TransactionID, r.Trans_Type, r.Total_Amount) for r in new] == [
        (5, "SALE", D("10.00")), (6, "SALE", D("6.00")), (7, "RESTOCK", D("0.00"))
    ]
    assert seed.stock_of(out.tables)[50] == 10 and seed.active_of(out.tables)["Toys"] == 1
    assert out.tables["products"].filter("ProductID = 50").first().Unit_Price == D("6.00")


def commands(spark, rows):
    """rows: (minute, user, product, quantity, type)"""
    return spark.createDataFrame(
        [(i, NOW + dt.timedelta(minutes=m), u, p, q, k, None, "demo") for i, (m, u, p, q, k) in enumerate(rows)],
        COMMAND_SCHEMA,
    )


def codes(result):
    return {r.cmd_id: r.code for r in result.decided.collect()}


def test_facts_are_stored_before_they_are_placed(spark, monkeypatch):
    """So the joins' shuffles are gone when the placement writes its own; the stored facts go after it."""
    plans, as_of = [], plan_module.as_of
    monkeypatch.setattr(plan_module, "as_of", lambda probes, *a, **k: (plans.append(probes._jdf.queryExecution().toString()), as_of(probes, *a, **k))[1])
    cmds = seed.event_log(spark, [1, 2, 3])
    cut_lineage(cmds.limit(1))  # the folder is made
    before = seed.left_on_disk(spark)
    assert replay(cmds, seed.seed_tables(spark), blocks=3).ledger.decided.count() == 3
    assert len(plans) == 1 and "Join" not in plans[0]
    assert len([p for p in seed.left_on_disk(spark) - before if "/rdd-" in p]) == 1


def test_reject_codes(spark):
    t = seed.seed_tables(spark)
    t["products"] = t["products"].withColumn("Is_Active", F.when(F.col("ProductID") == OIL, 0).otherwise(1))
    t["stock_management"] = t["stock_management"].filter(f"ProductID <> {NOTEBOOK}")
    cmds = commands(spark, [
        (0, ARJUN, OIL, 1, "SALE"), (0, ARJUN, 77, 1, "RETURN"), (0, PRIYA, OIL, 1, "RESTOCK"),
        (0, PRIYA, CRT, 1, "RESTOCK"), (0, ARJUN, NOTEBOOK, 1, "SALE"), (0, MEERA, NOTEBOOK, 1, "RETURN"),
        (0, ARJUN, HUB, 999, "SALE"), (0, ARJUN, HUB, 1, "GIFT"), (0, ARJUN, HUB, 0, "SALE"),
        (0, 99, HUB, 1, "SALE"), (0, 99, HUB, 999, "SALE"), (0, ARJUN, HUB, None, "SALE"), (0, PRIYA, NOTEBOOK, 1, "RESTOCK"),
    ])
    package = ledger.apply_stock_commands(cmds, t)
    assert codes(package) == {
        0: "-20030", 1: "-20032", 2: "-20024", 3: "-20025", 4: "NO_STOCK_ROW", 5: None, 6: "-20031", 7: "-20004",
        8: "CHK_QTY", 9: "FK_USER", 10: "-20031", 11: "CHK_QTY", 12: "NO_STOCK_ROW",
    }
    assert package.accepted.first().warning == "NO_STOCK_ROW"
    assert package.accepted.count() + package.rejected.count() == 13
    messages = {r.cmd_id: r.message for r in package.rejected.collect()}
    assert messages[6] == 'ERROR: Insufficient stock for "USB-C Hub". Available: 20, Requested: 999'
    assert all(messages.values())
    procedure = codes(ledger.apply_stock_commands(cmds, t, "procedure"))
    assert procedure == {
        0: "-20001", 1: "-20001", 2: "-20005", 3: "-20006", 4: "-20002", 5: "-20002", 6: "-20003", 7: "-20004",
        8: "CHK_QTY", 9: "FK_USER", 10: "-20003", 11: "CHK_QTY", 12: "NO_STOCK_ROW",
    }


def random_commands(seed_no, n):
    rng = random.Random(seed_no)
    return [
        (m, rng.choice([ARJUN, MEERA]), rng.choice([MOUSE] * 4 + [HUB, PENS, RICE, CRT]), rng.randint(1, 9),
         rng.choice(["SALE", "SALE", "SALE", "RETURN", "RESTOCK"]))
        for m in range(n)
    ]


def plain_loop(rows):
    stock = {p: q for p, (_, _, _, q, _) in enumerate(seed.PRODUCTS, 1)}
    for _, _, p, q, kind in rows:
        if kind == "SALE":
            stock[p] -= q if stock[p] >= q else 0
        elif kind == "RETURN" or p != CRT:
            stock[p] += q
    return stock


def test_batches_equal_one_loop(spark):
    rows = random_commands(11, 240)
    t = seed.seed_tables(spark)
    whole = ledger.apply_stock_commands(commands(spark, rows), t, blocks=6)
    want = plain_loop(rows)
    assert seed.stock_of({"stock_management": whole.stock}) == want
    assert min(want.values()) >= 0
    first = ledger.apply_stock_commands(commands(spark, rows[:100]), t)
    second = ledger.apply_stock_commands(commands(spark, rows[100:]), {**t, "stock_management": first.stock})
    assert seed.stock_of({"stock_management": second.stock}) == want
    headers, items = whole.transactions.collect(), whole.items.collect()
    assert sorted(r.TransactionID for r in headers) == list(range(5, 5 + len(headers)))
    assert {r.TransactionID: r.Subtotal for r in items} == {r.TransactionID: r.Total_Amount for r in headers}
    assert all(r.Unit_Price == 0 for r in items if r.TransactionID in {h.TransactionID for h in headers if h.Trans_Type == "RESTOCK"})


def test_stream_equals_batch(spark, tmp_path):
    rows = random_commands(12, 180)
    t = seed.seed_tables(spark)
    source, base = str(tmp_path / "in"), str(tmp_path / "out")
    cmds = commands(spark, rows)
    for low, high in [(0, 50), (50, 90), (90, 120), (120, 180)]:
        cmds.filter(f"cmd_id >= {low} AND cmd_id < {high}").coalesce(1).write.mode("append").parquet(source)
        # a restarted stream goes on where it stopped
        feed = spark.readStream.schema(COMMAND_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        stream_ledger(feed, t, base, compact=2).trigger(availableNow=True).start().awaitTermination()
    got = stream_stock(spark, base, t["stock_management"], compact=2)
    assert seed.stock_of({"stock_management": got}) == plain_loop(rows)
    decided = stream_decided(spark, base, 2)
    assert decided.count() == 180 and decided.filter("late").count() == 0
    late = commands(spark, [(3, ARJUN, MOUSE, 1, "RETURN")]).withColumn("cmd_id", F.lit(500).cast("long"))
    late.write.mode("append").parquet(source)
    feed = spark.readStream.schema(COMMAND_SCHEMA).parquet(source)
    stream_ledger(feed, t, base, compact=2).trigger(availableNow=True).start().awaitTermination()
    assert [r.accepted for r in stream_decided(spark, base, 2).filter("late").collect()] == [True]


def test_retried_batch_changes_nothing(spark, tmp_path):
    t, base = seed.seed_tables(spark), str(tmp_path)
    first, second = (commands(spark, random_commands(n, 60)) for n in (13, 14))
    ledger_batch(first, 0, t, base)
    for _ in range(2):
        ledger_batch(second, 1, t, base)
    once = ledger.apply_stock_commands(first, t)
    twice = ledger.apply_stock_commands(second, {**t, "stock_management": once.stock})
    got = stream_stock(spark, base, t["stock_management"])
    assert seed.stock_of({"stock_management": got}) == seed.stock_of({"stock_management": twice.stock})
    assert stream_decided(spark, base).count() == 120


def test_stream_audit(spark, tmp_path):
    t = seed.seed_tables(spark)
    image = F.struct(*t["stock_management"].columns)
    after = F.struct(
        *[(F.col("Quantity") - 2).alias(c) if c == "Quantity" else F.col(c) for c in t["stock_management"].columns]
    )
    moved = t["stock_management"].select(F.col("ProductID").alias("seq"), image.alias("before"), after.alias("after"))
    moved.write.parquet(str(tmp_path / "stock"))
    feed = spark.readStream.schema(moved.schema).parquet(str(tmp_path / "stock"))
    out = str(tmp_path / "audit")
    stream_audit(feed, "stock", out, t["products"]).trigger(availableNow=True).start().awaitTermination()
    got = {r.Record_ID: (r.Old_Value, r.New_Value, r.Description) for r in stream_audit_rows(spark, "stock", out).collect()}
    assert got[RICE] == ("Qty=30", "Qty=28", 'Stock change for "Basmati Rice 5kg" | Delta: -2') and len(got) == 8
    row = F.struct(*t["products"].columns)
    born = t["products"].select(F.col("ProductID").alias("seq"), F.lit(None).cast(t["products"].schema).alias("before"), row.alias("after"))
    born.write.parquet(str(tmp_path / "products"))
    feed = spark.readStream.schema(born.schema).parquet(str(tmp_path / "products"))
    stream_audit(feed, "products", out).trigger(availableNow=True).start().awaitTermination()
    got = {r.Record_ID: (r.Operation, r.New_Value) for r in stream_audit_rows(spark, "products", out).collect()}
    assert got[PENS] == ("INSERT", "Name=Ballpoint Pen Pack Price=45 CatID=2 Active=1")


def test_snapshot_audit(spark):
    t = seed.seed_tables(spark)
    new = t["products"].filter(f"ProductID <> {OIL}").withColumn(
        "Unit_Price", F.when(F.col("ProductID") == HUB, 1399).otherwise(F.col("Unit_Price")).cast("decimal(10,2)")
    ).withColumn("CategoryID", F.when(F.col("ProductID") == PENS, 1).otherwise(F.col("CategoryID")))
    got = {r.Record_ID: (r.Operation, r.Old_Value, r.New_Value) for r in audit.audit_products(t["products"], new).collect()}
    assert got == {
        HUB: ("UPDATE", "Name=USB-C Hub Price=1299 Active=1", "Name=USB-C Hub Price=1399 Active=1"),
        PENS: ("UPDATE", "Name=Ballpoint Pen Pack Price=45 Active=1", "Name=Ballpoint Pen Pack Price=45 Active=1"),
        OIL: ("DELETE", "Name=Sunflower Oil 1L Price=180", None),
    }
    plan = audit.changed_keys(t["products"], new, "ProductID")._jdf.queryExecution().executedPlan().toString()
    joined = plan[plan.index("FullOuter"):].splitlines()
    moved = [line for line in joined if "Exchange" in line or "Sort " in line or "FullOuter" in line]
    assert moved and not any("Name" in line or "Price" in line for line in moved)  # digests alone are joined
    null = t["products"].withColumn("CategoryID", F.when(F.col("ProductID") != PENS, F.col("CategoryID")))
    assert [r.Record_ID for r in audit.audit_products(t["products"], null).collect()] == [PENS]


def test_items_move_stock(spark):
    t = seed.seed_tables(spark)
    net = {r.ProductID: r.stock_after for r in ledger.net_movement(t["transaction_items"], t["transactions"], t["stock_management"]).collect()}
    assert net[MOUSE] == 3 and net[HEADPHONES] == 18 and net[NOTEBOOK] == 51 and net[PENS] == -2
    short = ledger.stock_from_items(t["transaction_items"], t["transactions"], t["stock_management"]).filter("code IS NOT NULL")
    assert [r.ProductID for r in short.collect()] == [PENS]


def test_category_status(spark):
    t = seed.seed_tables(spark)
    rows = [(1, 3, 0), (2, 4, 0), (3, 4, 1), (4, 4, 0), (5, 88, 0)]
    turns = spark.createDataFrame(
        [(i, NOW + dt.timedelta(minutes=i), c, f, "demo") for i, c, f in rows],
        "change_id long, event_ts timestamp_ntz, CategoryID long, IS_ACTIVE int, actor string",
    )
    out = changes.apply_category_status(turns, t["category"], t["products"])
    got = {r.change_id: r.status for r in out.outcomes.collect()}
    assert got == {1: "applied", 2: "no-op", 3: "applied", 4: "applied", 5: "rejected"}
    assert seed.active_of({"category": out.table}) == {"Electronics": 1, "Stationery": 1, "Grocery": 0, "Discontinued": 0}
    log = changes.with_log_ids(out.audit, t["audit_log"]).orderBy("LogID").collect()
    assert [(r.LogID, r.Record_ID) for r in log] == [(2, 3), (3, 4)]
    assert log[0].Description == 'Soft delete via PKG_ADMIN_OPS: "Grocery" | 2 product(s) affected'


def test_unique_columns_follow_the_order_of_inserts(spark):
    t = seed.seed_tables(spark)
    rows = [
        (1, "A", "a@x"), (2, "B", "a@x"), (3, "B", "b@x"), (4, "C", None), (5, "D", None), (6, "C", "c@x"),
        (7, "PaperWorld Co.", "p@x"), (8, "E", "p@x"), (9, "F", "s1@example.com"),
    ]
    new = spark.createDataFrame(
        [(i, NOW, n, "1", e, None, "demo") for i, n, e in rows],
        "row_id long, event_ts timestamp_ntz, Name string, Contact string, Email string, Address string, actor string",
    )
    out = changes.add_suppliers(new, t["suppliers"])
    assert sorted(r.Name for r in out.rows.collect()) == ["A", "B", "C", "D", "E"]
    assert {r.row_id: r.code for r in out.rejected.collect()} == {
        2: "UNIQUE_EMAIL", 6: "-20023", 7: "-20023", 9: "UNIQUE_EMAIL"
    }


def test_ids_and_values_of_added_rows_are_checked(spark, monkeypatch):
    add = dict(cmd_type="ADD_PRODUCT", category_id=7, supplier_id=9, unit_price=D("5.00"), quantity=10)
    events = {
        1: dict(cmd_type="ADD_CATEGORY", category_id=7, name="Toys"),
        2: dict(cmd_type="ADD_CATEGORY", category_id=7, name="Games"),
        3: dict(cmd_type="ADD_CATEGORY", category_id=8),
        4: dict(cmd_type="ADD_SUPPLIER", supplier_id=9, name="ToyHouse", contact="1", email="a@b"),
        5: dict(cmd_type="ADD_SUPPLIER", supplier_id=10, name="Other", contact="1", email="a@b"),
        6: dict(cmd_type="ADD_SUPPLIER", supplier_id=11, name="Third"),
        7: dict(add, product_id=50, name="Ball"),
        8: dict(add, product_id=50, name="Ball again"),
        9: dict(add, product_id=MOUSE, name="Mouse"),
        10: dict(add, product_id=51),
        11: dict(add, product_id=52, name="Top", quantity=-1),
        12: dict(cmd_type="SALE", user_id=ARJUN, product_id=50, quantity=2),
        13: dict(cmd_type="SALE", user_id=ARJUN, product_id=50, quantity=10**11),
        14: dict(cmd_type="RETURN", user_id=ARJUN, product_id=50, quantity=10**11),
        15: dict(cmd_type="SET_PRICE", product_id=50, unit_price=D("6.00")),
        16: dict(cmd_type="CATEGORY_OFF", category_id=7),
    }
    monkeypatch.setattr(seed, "EVENTS", events)
    out = replay(seed.event_log(spark, events), seed.seed_tables(spark), blocks=3)
    rows = out.outcomes.collect()
    assert len(rows) == len(events)
    assert {r.cmd_id: r.code for r in rows if r.code} == {
        2: "UNIQUE_ID", 3: "NOT_NULL", 5: "UNIQUE_ID", 6: "NOT_NULL", 8: "UNIQUE_ID", 9: "UNIQUE_ID", 10: "NOT_NULL",
        11: "CHK_QTY", 13: "-20031", 14: "AMOUNT_RANGE",
    }
    stock = out.tables["stock_management"].collect()
    assert len({r.StockID for r in stock}) == len(stock) and seed.stock_of(out.tables)[50] == 8
    audit = out.tables["audit_log"].collect()
    assert len({r.LogID for r in audit}) == len(audit)
    new = [(r.Operation, r.Record_ID, r.Old_Value, r.New_Value) for r in out.admin_audit.collect()]
    assert sorted(new, key=str) == sorted([
        ("INSERT", 9, None, "Name=ToyHouse"), ("INSERT", 50, None, "Name=Ball Price=5"),
        ("UPDATE", 50, "Name=Ball Price=5 Active=1", "Name=Ball Price=6 Active=1"), ("UPDATE", 7, "IS_ACTIVE=1", "IS_ACTIVE=0"),
    ], key=str)
    assert any("1 product(s) affected" in (r.Description or "") for r in out.admin_audit.collect())


def test_constraints_on_new_and_changed_rows(spark):
    t = seed.seed_tables(spark)
    people = spark.createDataFrame(
        [(1, NOW, "a", "a@x", "STAFF"), (2, NOW, None, "b@x", "STAFF"), (3, NOW, "c", "c@x", "BOSS"), (4, NOW, "d", None, "STAFF"),
         (5, NOW, "e", "a@x", "ADMIN"), (6, NOW, "f" * 51, "f@x", "ADMIN")],
        "row_id long, event_ts timestamp_ntz, Username string, Email string, Role string",
    )
    added = changes.add_dimension_rows(people, t["users"], "users")
    assert [r.Username for r in added.rows.collect()] == ["a"]
    assert {r.row_id: r.code for r in added.rejected.collect()} == {
        2: "NOT_NULL", 3: "CHK_ROLE", 4: "NOT_NULL", 5: "UNIQUE_EMAIL", 6: "LENGTH"
    }
    wanted = spark.createDataFrame(
        [(MOUSE, NOW, 1, D("0.00"), None), (HUB, NOW, 2, D("9.00"), 7), (PENS, NOW, 3, D("8.00"), None), (PENS, NOW, 4, None, 0)],
        "ProductID long, event_ts timestamp_ntz, change_id long, Unit_Price decimal(10,2), Is_Active int",
    )
    columns = ["Unit_Price", "Is_Active"]
    after = {r.ProductID: (r.Unit_Price, r.Is_Active) for r in changes.apply_updates(t["products"], wanted, "ProductID", columns, table="products").collect()}
    before = {r.ProductID: (r.Unit_Price, r.Is_Active) for r in t["products"].collect()}
    assert after == {**before, PENS: (D("8.00"), 0)}
    refused = changes.screen_updates(wanted, "products", columns)[1].collect()
    assert {r.change_id: r.code for r in refused} == {1: "CHK_PRICE", 2: "CHK_FLAG"}


def test_outcomes_carry_no_texts(spark):
    """Verdicts alone are asked for: the ledger with its texts is not computed for them."""
    out = replay(seed.event_log(spark, list(seed.EVENTS)), seed.seed_tables(spark), blocks=3)
    alone = {(r.cmd_id, r.status, r.code) for r in out.outcomes.collect()}
    assert "ledger" not in out.__dict__
    both = replay(seed.event_log(spark, list(seed.EVENTS)), seed.seed_tables(spark), blocks=3)
    assert both.ledger.decided.count() > 0
    assert {(r.cmd_id, r.status, r.code) for r in both.outcomes.collect()} == alone and alone
