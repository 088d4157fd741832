"""The small shop used as golden fixture: its tables and its list of events."""

import datetime as dt
from decimal import Decimal
from pathlib import Path

from pyspark.sql import functions as F

from shelfwise.model import SCHEMAS
from shelfwise.sources.tables import apply_defaults

NOW = dt.datetime(2026, 1, 5, 9, 0)
USERS = [("admin_raj", "ADMIN"), ("manager_priya", "MANAGER"), ("staff_arjun", "STAFF"), ("staff_meera", "STAFF")]
CATEGORIES = [("Electronics", 1), ("Stationery", 1), ("Grocery", 1), ("Discontinued", 0)]
SUPPLIERS = ["TechSource Pvt Ltd", "PaperWorld Co.", "FreshMart Traders", "OldStock Suppliers"]
PRODUCTS = [
    ("Wireless Mouse", 1, "599.00", 5, 15),
    ("USB-C Hub", 1, "1299.00", 20, 10),
    ("Bluetooth Headphones", 1, "2499.00", 8, 10),
    ("A4 Notebook", 2, "85.00", 50, 20),
    ("Ballpoint Pen Pack", 2, "45.00", 3, 25),
    ("Basmati Rice 5kg", 3, "320.00", 30, 15),
    ("Sunflower Oil 1L", 3, "180.00", 12, 10),
    ("Old CRT Monitor", 4, "999.00", 2, 20),
]
MOUSE, HUB, HEADPHONES, NOTEBOOK, PENS, RICE, OIL, CRT = range(1, 9)
RAJ, PRIYA, ARJUN, MEERA = range(1, 5)
TRANSACTIONS = [
    (ARJUN, "SALE", "1198.00", MOUSE, 2, "599.00"),
    (PRIYA, "RESTOCK", "0.00", HEADPHONES, 10, "0.00"),
    (MEERA, "RETURN", "85.00", NOTEBOOK, 1, "85.00"),
    (ARJUN, "SALE", "225.00", PENS, 5, "45.00"),
]


def _make(spark, name, rows, columns):
    df = spark.createDataFrame(rows, columns) if rows else spark.createDataFrame([], SCHEMAS[name])
    return apply_defaults(df, name, NOW)


def seed_tables(spark):
    users = [(i, n, f"{n}@example.com", r) for i, (n, r) in enumerate(USERS, 1)]
    cats = [(i, n, a) for i, (n, a) in enumerate(CATEGORIES, 1)]
    sups = [(i, n, f"900000000{i}", f"s{i}@example.com") for i, n in enumerate(SUPPLIERS, 1)]
    prods = [(i, n, c, c, Decimal(p)) for i, (n, c, p, _, _) in enumerate(PRODUCTS, 1)]
    stock = [(i, i, q, level) for i, (_, _, _, q, level) in enumerate(PRODUCTS, 1)]
    headers = [(i, u, k, Decimal(a)) for i, (u, k, a, *_) in enumerate(TRANSACTIONS, 1)]
    items = [(i, i, p, q, Decimal(x)) for i, (*_, p, q, x) in enumerate(TRANSACTIONS, 1)]
    log = [(1, "CATEGORY", "UPDATE", 4, "admin_raj", "IS_ACTIVE=1", "IS_ACTIVE=0")]
    return {
        "users": _make(spark, "users", users, "UserID long, Username string, Email string, Role string"),
        "category": _make(spark, "category", cats, "CategoryID long, Name string, IS_ACTIVE int"),
        "suppliers": _make(spark, "suppliers", sups, "SupplierID long, Name string, Contact string, Email string"),
        "products": _make(
            spark, "products", prods,
            "ProductID long, Name string, CategoryID long, SupplierID long, Unit_Price decimal(10,2)",
        ),
        "stock_management": _make(
            spark, "stock_management", stock, "StockID long, ProductID long, Quantity long, Restock_Level long"
        ),
        "transactions": _make(
            spark, "transactions", headers, "TransactionID long, UserID long, Trans_Type string, Total_Amount decimal(12,2)"
        ),
        "transaction_items": _make(
            spark, "transaction_items", items,
            "ItemID long, TransactionID long, ProductID long, Quantity long, Unit_Price decimal(10,2)",
        ),
        "reports": _make(spark, "reports", [], ""),
        "audit_log": _make(
            spark, "audit_log", log,
            "LogID long, Table_Name string, Operation string, Record_ID long, Changed_By string, Old_Value string, "
            "New_Value string",
        ),
    }


KEYBOARD, CHAIR = 9, 10
QUICKSHIP, WOODCRAFT, FURNITURE, VGA = 5, 6, 5, 99
# number, command; each has its own minute
EVENTS = {
    1: dict(cmd_type="SALE", user_id=ARJUN, product_id=MOUSE, quantity=2),
    2: dict(cmd_type="SALE", user_id=MEERA, product_id=PENS, quantity=999),
    3: dict(cmd_type="RETURN", user_id=MEERA, product_id=NOTEBOOK, quantity=1),
    4: dict(cmd_type="RESTOCK", user_id=PRIYA, product_id=MOUSE, quantity=20),
    5: dict(cmd_type="RESTOCK", user_id=PRIYA, product_id=CRT, quantity=10),
    6: dict(cmd_type="CATEGORY_OFF", category_id=3),
    7: dict(cmd_type="CATEGORY_OFF", category_id=4),
    9: dict(cmd_type="ADD_SUPPLIER", supplier_id=QUICKSHIP, name="QuickShip Traders", contact="9111222333"),
    10: dict(
        cmd_type="ADD_PRODUCT", product_id=KEYBOARD, category_id=1, supplier_id=QUICKSHIP, name="Mechanical Keyboard",
        unit_price=Decimal("3499.00"), quantity=15, restock_level=5,
    ),
    11: dict(
        cmd_type="ADD_PRODUCT", product_id=VGA, category_id=4, supplier_id=4, name="Old VGA Cable",
        unit_price=Decimal("99.00"),
    ),
    12: dict(cmd_type="RESTOCK", user_id=PRIYA, product_id=HEADPHONES, quantity=25),
    13: dict(cmd_type="CATEGORY_OFF", category_id=2),
    14: dict(cmd_type="SALE", user_id=ARJUN, product_id=HUB, quantity=3),
    15: dict(cmd_type="RETURN", user_id=MEERA, product_id=HUB, quantity=1),
    16: dict(cmd_type="SET_PRICE", product_id=HUB, unit_price=Decimal("1399.00")),
    17: dict(cmd_type="CATEGORY_OFF", category_id=1),
    18: dict(cmd_type="RESTOCK", user_id=PRIYA, product_id=MOUSE, quantity=10),
    19: dict(cmd_type="SALE", user_id=ARJUN, product_id=RICE, quantity=2),
    20: dict(cmd_type="ADD_CATEGORY", category_id=FURNITURE, name="Furniture", description="Office furniture"),
    21: dict(cmd_type="ADD_SUPPLIER", supplier_id=WOODCRAFT, name="WoodCraft Suppliers", contact="9777888999"),
    22: dict(
        cmd_type="ADD_PRODUCT", product_id=CHAIR, category_id=FURNITURE, supplier_id=WOODCRAFT, name="Ergonomic Chair",
        unit_price=Decimal("8999.00"), quantity=10, restock_level=3,
    ),
    23: dict(cmd_type="SALE", user_id=ARJUN, product_id=CHAIR, quantity=2),
    24: dict(cmd_type="RETURN", user_id=MEERA, product_id=CHAIR, quantity=1),
    25: dict(cmd_type="RESTOCK", user_id=PRIYA, product_id=CHAIR, quantity=20),
    26: dict(cmd_type="CATEGORY_OFF", category_id=FURNITURE),
    27: dict(cmd_type="RESTOCK", user_id=PRIYA, product_id=CHAIR, quantity=5),
    28: dict(cmd_type="SALE", user_id=ARJUN, product_id=CHAIR, quantity=1),
}


def event_log(spark, numbers):
    from shelfwise.plans.replay import LOG_SCHEMA

    rows = []
    for n in numbers:
        row = {"cmd_id": n, "event_ts": NOW + dt.timedelta(minutes=n), "actor": "demo", **EVENTS[n]}
        rows.append(tuple(row.get(f.name) for f in LOG_SCHEMA))
    return spark.createDataFrame(rows, LOG_SCHEMA)


def stock_of(tables):
    return {r.ProductID: r.Quantity for r in tables["stock_management"].collect()}


def active_of(tables):
    return {r.Name: r.IS_ACTIVE for r in tables["category"].select("Name", F.col("IS_ACTIVE")).collect()}


def left_on_disk(spark):
    """Shuffle files of the session and what lies in its shared folders."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = {found.apply(k).getName() for k in range(found.size())}
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    return {n for n in names if n.startswith("shuffle_")} | {str(p) for at in ("*", "*/rdd-*") for p in shared.glob(at)}
