"""Report queries on the seed rows against the golden values."""

from decimal import Decimal as D

import pytest

from seed import CRT, HEADPHONES, HUB, MOUSE, NOTEBOOK, OIL, PENS, RICE, NOW, seed_tables
from shelfwise.operators import lookups, quality, report_lines as lines, reports as r


@pytest.fixture(scope="module")
def t(spark):
    return {name: df.cache() for name, df in seed_tables(spark).items()}


def rows(df, *columns):
    return [tuple(row) for row in (df.select(*columns) if columns else df).collect()]


def test_dashboard(t):
    got = rows(r.product_dashboard(t), "ProductID", "Stock_Status")
    assert len(got) == 8 and {p for p, s in got if s == "LOW STOCK"} == {MOUSE, HEADPHONES, PENS, CRT}


def test_history_and_listings(t):
    assert r.transaction_history(t).count() == 4
    assert rows(r.user_history(t, 3), "Product_Name") == [("Wireless Mouse",), ("Ballpoint Pen Pack",)]
    assert r.product_catalog(t).count() == r.stock_listing(t).count() == 8
    assert r.active_suppliers(t).count() == 4
    assert rows(r.categories(t, False), "Name") == [("Discontinued",)]
    assert "Password" not in r.user_directory(t).columns


def test_restock_alert(t):
    assert rows(r.restock_alert(t), "Product", "Units_Needed") == [
        ("Ballpoint Pen Pack", 22), ("Wireless Mouse", 10), ("Bluetooth Headphones", 2)
    ]
    assert rows(r.restock_alert_supplier(t), "Supplier") == [
        ("PaperWorld Co.",), ("TechSource Pvt Ltd",), ("TechSource Pvt Ltd",)
    ]


def test_supplier_price_range(t):
    got = {s: (n, lo, hi, avg) for s, _, n, lo, hi, avg in rows(r.supplier_price_range(t))}
    assert got["TechSource Pvt Ltd"] == (3, D("599.00"), D("2499.00"), D("1465.67"))
    assert got["PaperWorld Co."] == (2, D("45.00"), D("85.00"), D("65.00")) and len(got) == 4


def test_revenue(t):
    assert rows(r.category_revenue(t)) == [("Electronics", 1, D("1198.00")), ("Stationery", 1, D("225.00"))]
    assert rows(r.category_revenue_over(t)) == [("Electronics", D("1198.00"))]


def test_category_stock(t):
    got = {c: (total, avg) for c, _, _, total, _, _, avg in rows(r.category_stock(t))}
    assert got == {
        "Stationery": (53, D("26.50")), "Grocery": (42, D("21.00")), "Electronics": (33, D("11.00")),
        "Discontinued": (2, D("2.00")),
    }


def test_users(t):
    assert rows(r.user_volume(t)) == [
        ("staff_arjun", "STAFF", 2, D("1423.00")), ("staff_meera", "STAFF", 1, D("85.00")),
        ("manager_priya", "MANAGER", 1, D("0.00")), ("admin_raj", "ADMIN", 0, D("0.00")),
    ]
    assert rows(r.user_activity(t), "Username", "Sales", "Returns", "Restocks")[0] == ("staff_arjun", 2, 0, 0)
    assert rows(r.above_avg_users(t), "Username") == [("staff_arjun",)]
    assert rows(r.users_without_sale(t), "UserID") == [(1,), (2,), (4,)]


def test_months(t):
    assert rows(r.monthly_summary(t), "Trans_Type", "Transaction_Count", "Total_Amount") == [
        ("RESTOCK", 1, D("0.00")), ("RETURN", 1, D("85.00")), ("SALE", 2, D("1423.00"))
    ]


def test_subqueries(t):
    assert rows(r.below_avg_stock(t), "Quantity") == [(2,), (3,), (5,), (8,), (12,)]
    assert rows(r.never_sold(t), "ProductID") == [(p,) for p in (HUB, HEADPHONES, NOTEBOOK, RICE, OIL, CRT)]
    assert {p for (p,) in rows(r.top_priced(t), "ProductID")} == {HEADPHONES, CRT, RICE, NOTEBOOK}
    assert rows(r.low_stock_exists(t), "Quantity") == [(3,), (5,), (8,)]


def test_sets(t):
    flagged = rows(r.flagged_products(t), "ProductID", "Flag")
    assert len(flagged) == 5 and [f for p, f in flagged if p == CRT] == ["INACTIVE CATEGORY", "LOW STOCK"]
    assert [k for (k,) in rows(r.sales_and_returns(t), "Trans_Type")] == ["RETURN", "SALE", "SALE"]
    stuck, actionable = rows(r.stuck_products(t), "ProductID"), rows(r.actionable_restock(t), "ProductID")
    assert stuck == [(CRT,)] and actionable == [(MOUSE,), (HEADPHONES,), (PENS,)]
    assert not set(stuck) & set(actionable)


def test_category_health_keeps_empty(spark, t):
    empty = spark.createDataFrame([(9, "Toys", None, 1, NOW)], t["category"].schema)
    got = {c: (n, s) for c, _, n, s, _ in rows(r.category_health({**t, "category": t["category"].unionByName(empty)}))}
    assert got["Toys"] == (0, None) and got["Electronics"] == (3, 33)


def test_health_metrics(t):
    got = dict(rows(r.health_metrics(t)))
    assert len(got) == 13
    assert got["Total Sales Revenue (Rs.)"] == "1423" and got["Products Needing Restock (Active Cat)"] == "3"
    assert got["Total Stock Alerts Logged"] == "0" and got["Inactive Categories (Soft Deleted)"] == "1"


def test_sum_over_nothing_is_null(t):
    none = {**t, "transactions": t["transactions"].filter("1 = 0")}
    assert dict(rows(r.health_metrics(none)))["Total Sales Revenue (Rs.)"] is None


def test_audit_lists(t):
    assert rows(r.latest_audit(t, "CATEGORY"), "New_Value") == [("IS_ACTIVE=0",)]
    assert rows(r.audit_review(t), "Changed_At") == [("05-JAN 09:00:00",)]
    assert rows(r.audit_tail(t), "Changed_At") == [("05-JAN-26 09:00:00",)]
    assert rows(r.audit_feed(t), "Change_Date") == [("2026-01-05 09:00:00",)]


def test_functions(spark, t):
    asked = spark.createDataFrame([(1, MOUSE, 5), (2, PENS, 10), (3, 77, 1)], "request_id long, product_id long, quantity long")
    got = {i: (p, c) for i, _, _, p, c, _ in rows(lookups.price_quotes(asked, t["products"]))}
    assert got == {1: (D("2995.00"), None), 2: (D("450.00"), None), 3: (None, -20010)}
    status = dict(rows(lookups.stock_status(t["products"], t["stock_management"].filter(f"ProductID <> {OIL}")), "ProductID", "Status"))
    assert status[MOUSE] == "LOW STOCK" and status[HUB] == "OK" and status[OIL] == "NOT FOUND"
    flags = lookups.category_flag(spark.createDataFrame([(1,), (4,), (50,)], "CategoryID long"), t["category"])
    assert dict(rows(flags)) == {1: 1, 4: 0, 50: -1}
    sales = dict(rows(lookups.product_sales(t), "ProductID", "Total_Sales_Revenue"))
    assert sales[MOUSE] == D("1198.00") and sales[HUB] == 0


def test_lines(t):
    first = rows(lines.restock_alert_lines(t), "Line")[0][0]
    assert first == "Ballpoint Pen Pack".ljust(25) + "Stationery".ljust(15) + "3".ljust(8) + "25".ljust(13) + "22"
    assert rows(lines.restock_alert_count(t)) == [(3,)]
    marked = [x for (x,) in rows(lines.stock_report_lines(t), "Line") if "INACTIVE" in x]
    assert marked == ["Old CRT Monitor".ljust(25) + "Discontinued".ljust(15) + "  Qty: 2      Status: LOW STOCK [CATEGORY INACTIVE]"]
    assert lines.transactions_by_type(t, "SALE").count() == 2
    assert rows(lines.type_total(t, "SALE")) == [(D("1423.00"),)]
    assert rows(lines.type_total(t, "NONE")) == [(D("0.00"),)]
    assert rows(lines.view_transactions(t, 3, "SALE"), "Line")[0][0].endswith("Amount: Rs.1198")


def test_view_totals(spark, t):
    asked = spark.createDataFrame([(3,), (1,), (42,)], "user_id long")
    got = {u: (n, v, e) for u, _, n, v, e in rows(lines.view_transactions_total(t, asked))}
    assert got[3] == (2, D("1423.00"), None) and got[1] == (0, D("0.00"), None)
    assert got[42] == (None, None, "ERROR: User ID 42 not found.")


def test_quality_of_clean_tables(t):
    assert quality.quality_report(t).count() == 0
    counts = dict(rows(quality.row_counts(t)))
    assert [counts[n] for n in (
        "users", "category", "suppliers", "products", "stock_management", "transactions", "transaction_items", "audit_log"
    )] == [4, 4, 4, 8, 8, 4, 4, 1]
