"""Every registered query: a Spark builder over the retail tables and its SQL counterpart.

codes and column names in the SQL are those the operators must produce.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfwise.functions import dialect as d
from shelfwise.model import KEYS, RULES, SCHEMAS
from shelfwise.operators import audit, changes, ledger, lookups, quality, report_lines, reports
from shelfwise.plans.oracle import START, fold, mean, number, sql
from shelfwise.plans.replay import LOG_SCHEMA, replay
from shelfwise.session import releasing, shared_dir, tune
from shelfwise.sources.lookup import Lookup, ingest_by_lookup
from shelfwise.sources.retail import EPOCH, _file_schema, _read, retail_commands, retail_tables
from shelfwise.sources.tables import (
    BatchLog, Tables, append_rows, apply_defaults, assign_keys, catalog_tables, load_tables, save_bucketed, save_tables, with_subtotal,
)
from shelfwise.streaming.audit import stream_audit, stream_audit_rows
from shelfwise.streaming.ledger import stream_decided, stream_ledger, stream_stock

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

SQL_NAMES = {"stock_management": "stock", "transactions": "headers", "transaction_items": "items"}
USER = 17  # the user asked about where a report is for one user
MONTHS = dt.datetime(2024, 2, 1)


def _add(name: str, build: Query, oracle: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark)
        return build(spark, sf_dir)

    QUERIES[name] = run
    if oracle is not None:
        ORACLE[name] = oracle


def _fresh_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/run-{uuid.uuid4()}"


def _on_tables(name: str, build: Callable[[Tables], DataFrame], oracle: str | None = None) -> None:
    _add(name, lambda spark, sf_dir: build(retail_tables(spark, sf_dir)), oracle)


def _askers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that a total is asked for; some are unknown."""
    return _read(spark, sf_dir, "customer").selectExpr("IF(c_custkey % 9 = 4, -c_custkey, c_custkey) AS user_id")


BUCKETS = 16
_STORED: dict[tuple[str, str], str] = {}


def bucketed_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The nine tables, headers and items from a bucketed store that is written once for each application and folder."""
    of = spark.sparkContext.applicationId, sf_dir
    if of not in _STORED:
        t, database = retail_tables(spark, sf_dir), f"bucketed_{uuid.uuid4().hex}"
        save_bucketed({name: t[name] for name in ("transactions", "transaction_items")}, database, BUCKETS, _fresh_folder(spark))
        _STORED[of] = database
    return {**retail_tables(spark, sf_dir), **catalog_tables(spark, _STORED[of], ("transactions", "transaction_items"))}


def _bucketed(name: str, build: Callable[[SparkSession, str, Tables], DataFrame]) -> None:
    """The query ``name`` once more, over the bucketed store."""
    _add(f"{name}_bucketed", lambda spark, sf_dir: build(spark, sf_dir, bucketed_tables(spark, sf_dir)), ORACLE[name])


# ---- ingest and quality (I) ------------------------------------------------

def _loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine tables written and read back: rows and a checksum of the keys of each."""
    base = _fresh_folder(spark)
    save_tables(retail_tables(spark, sf_dir), base)
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(KEYS[name]).alias("key_sum"))
        .select(F.lit(name).alias("table_name"), "n_rows", "key_sum")
        for name, df in load_tables(spark, base).items()
    ])


_add(
    "i1_load_tables",
    _loaded,
    sql(
        " UNION ALL ".join(
            f"SELECT '{name}' AS table_name, count(*) AS n_rows, CAST(sum({key}) AS BIGINT) AS key_sum "
            f"FROM {SQL_NAMES.get(name, name)}" for name, key in KEYS.items()
        ),
        *[SQL_NAMES.get(name, name) for name in KEYS],
    ),
)


def _plain_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS TransactionID", "l_partkey AS ProductID", "CAST(l_quantity AS bigint) AS Quantity",
        "CAST(l_extendedprice AS decimal(10,2)) AS Unit_Price",
    )


_add(
    "i2_with_subtotal",
    lambda spark, sf_dir: with_subtotal(_plain_items(spark, sf_dir)),
    """SELECT l_orderkey AS TransactionID, l_partkey AS ProductID, CAST(l_quantity AS BIGINT) AS Quantity,
              CAST(l_extendedprice AS DECIMAL(10,2)) AS Unit_Price,
              CAST(CAST(l_extendedprice AS DECIMAL(10,2)) * CAST(l_quantity AS BIGINT) AS DECIMAL(12,2)) AS Subtotal
       FROM lineitem""",
)


def _sparse_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS StockID", "p_partkey AS ProductID",
        "IF(p_partkey % 3 = 0, NULL, CAST(p_size AS bigint)) AS Quantity",
        "IF(p_partkey % 4 = 0, NULL, p_partkey % 40) AS Restock_Level",
    )
    return apply_defaults(rows, "stock_management", dt.datetime(2024, 1, 1))


_add(
    "i3_apply_defaults",
    _sparse_stock,
    """SELECT p_partkey AS StockID, p_partkey AS ProductID,
              CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END AS BIGINT) AS Quantity,
              CAST(CASE WHEN p_partkey % 4 = 0 THEN 10 ELSE p_partkey % 40 END AS BIGINT) AS Restock_Level,
              TIMESTAMP '2024-01-01 00:00:00' AS Last_Updated
       FROM part""",
)

_add(
    "i4_assign_keys",
    lambda spark, sf_dir: assign_keys(
        _read(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), "new_key",
        F.coalesce(_read(spark, sf_dir, "orders").agg(F.max("o_orderkey")).scalar(), F.lit(0)),
        ["o_orderdate", "o_orderkey"],
    ),
    """SELECT o_orderdate, o_orderkey,
              CAST((SELECT max(o_orderkey) FROM orders)
                   + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS new_key
       FROM orders""",
)


def _named_products(spark: SparkSession, sf_dir: str):
    t = retail_tables(spark, sf_dir)
    rows = _read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS row_id", "p_name AS Name", "IF(p_partkey % 37 = 0, 'Brand#none', p_brand) AS category_name",
        "concat('Supplier#', lpad(CAST(p_partkey % 90 AS string), 9, '0')) AS supplier_name",
    )
    return ingest_by_lookup(
        rows,
        [
            Lookup(t["category"], "CategoryID", "Name", "category_name", "CategoryID"),
            Lookup(t["suppliers"], "SupplierID", "Name", "supplier_name", "SupplierID"),
        ],
    )


NAMED = """
    named AS (
        SELECT p_partkey AS row_id, p_name AS Name,
               CASE WHEN p_partkey % 37 = 0 THEN 'Brand#none' ELSE p_brand END AS category_name,
               'Supplier#' || lpad(CAST(p_partkey % 90 AS VARCHAR), 9, '0') AS supplier_name
        FROM part)"""
_add(
    "i5_ingest_by_lookup",
    lambda spark, sf_dir: _named_products(spark, sf_dir).rows,
    sql(
        """SELECT row_id, n.Name, CategoryID, SupplierID
           FROM named n, category c, suppliers s WHERE c.Name = category_name AND s.Name = supplier_name""",
        "category", "suppliers", extra=NAMED,
    ),
)
_add(
    "i5_unmatched_names",
    lambda spark, sf_dir: _named_products(spark, sf_dir).unmatched,
    sql(
        """SELECT 'category_name' AS lookup, category_name AS name, count(*) AS row_count
           FROM named WHERE category_name NOT IN (SELECT Name FROM category) GROUP BY ALL
           UNION ALL
           SELECT 'supplier_name', supplier_name, count(*)
           FROM named WHERE supplier_name NOT IN (SELECT Name FROM suppliers) GROUP BY ALL""",
        "category", "suppliers", extra=NAMED,
    ),
)
def _items_by_name(spark: SparkSession, sf_dir: str):
    t = retail_tables(spark, sf_dir)
    stock = _read(spark, sf_dir, "part").selectExpr("p_partkey AS row_id", "p_name AS product_name")
    return ingest_by_lookup(stock, [Lookup(t["products"], "ProductID", "Name", "product_name", "ProductID")])


_add(
    "i5_ambiguous_names",
    lambda spark, sf_dir: _items_by_name(spark, sf_dir).ambiguous,
    """SELECT 'product_name' AS lookup, p_name AS name, count(*) AS row_count, count(*) AS parents
       FROM part GROUP BY p_name HAVING count(*) > 1""",
)


def _dirty_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS ProductID",
        "CASE WHEN p_partkey % 10 = 1 THEN NULL WHEN p_partkey % 10 = 2 THEN repeat(p_name, 20) ELSE p_name END AS Name",
        "p_partkey % 30 AS CategoryID", "p_partkey AS SupplierID",
        "CAST(IF(p_partkey % 10 = 3, 0, p_retailprice) AS decimal(10,2)) AS Unit_Price",
        "CAST(p_partkey % 7 AS int) AS Is_Active", f"{EPOCH} AS Created_At",
    )


DIRTY = """
    dirty AS (
        SELECT p_partkey AS id,
               CASE p_partkey % 10 WHEN 1 THEN NULL WHEN 2 THEN repeat(p_name, 20) ELSE p_name END AS name,
               CAST(CASE WHEN p_partkey % 10 = 3 THEN 0 ELSE p_retailprice END AS DECIMAL(10,2)) AS price,
               p_partkey % 7 AS flag
        FROM part)"""
_add(
    "i6_check_rows",
    lambda spark, sf_dir: quality.check_rows(_dirty_products(spark, sf_dir), "products"),
    sql(
        """SELECT 'products' AS table_name, id AS record_id, rule, value FROM (
             SELECT id, 'NOT NULL Name' AS rule, CAST(NULL AS VARCHAR) AS value FROM dirty WHERE name IS NULL
             UNION ALL SELECT id, 'LENGTH 100 Name', name FROM dirty WHERE length(name) > 100
             UNION ALL SELECT id, 'ABOVE 0 Unit_Price', CAST(price AS VARCHAR) FROM dirty WHERE price <= 0
             UNION ALL SELECT id, 'VALUE Is_Active', CAST(flag AS VARCHAR) FROM dirty WHERE flag > 1)""",
        extra=DIRTY,
    ),
)
_on_tables(
    "i7_check_unique",
    quality.check_all_unique,
    sql(
        """SELECT 'transaction_items' AS table_name, 'UNIQUE ItemID' AS rule, CAST(ItemID AS VARCHAR) AS value,
                  count(*) AS row_count
           FROM items GROUP BY ItemID HAVING count(*) > 1""",
        "items",
    ),
)


def _loose(t: Tables) -> Tables:
    """The tables with some references broken."""
    broken = F.when(F.col("ProductID") % 19 == 0, -1 - F.col("ProductID")).otherwise(F.col("ProductID"))
    items = t["transaction_items"].withColumn("ProductID", broken)
    headers = t["transactions"].withColumn("UserID", F.when(F.col("UserID") % 50 != 0, F.col("UserID")).otherwise(-9))
    return {**t, "transaction_items": items, "transactions": headers}


FK_SQL = """
    SELECT 'transaction_items' AS table_name, 'FOREIGN KEY ProductID' AS rule,
           CAST(-1 - ProductID AS VARCHAR) AS value, count(*) AS row_count
    FROM items WHERE ProductID % 19 = 0 GROUP BY ProductID
    UNION ALL
    SELECT 'transactions', 'FOREIGN KEY UserID', '-9', count(*)
    FROM headers WHERE UserID % 50 = 0 HAVING count(*) > 0"""
_on_tables("i8_check_fk", lambda t: quality.check_all_fks(_loose(t)), sql(FK_SQL, "items", "headers"))
_on_tables(
    "i9_quality_report",
    lambda t: quality.quality_report(_loose(t)),
    sql(
        f"""SELECT table_name, rule, CAST(sum(row_count) AS BIGINT) AS violations
            FROM ({FK_SQL}
                  UNION ALL
                  SELECT 'transaction_items', 'UNIQUE ItemID', NULL, count(*) - count(DISTINCT ItemID) FROM items)
            GROUP BY ALL""",
        "items", "headers",
    ),
)
_on_tables(
    "i10_row_counts",
    quality.row_counts,
    sql(
        " UNION ALL ".join(
            f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {SQL_NAMES.get(n, n)}" for n in RULES
        ),
        *[SQL_NAMES.get(n, n) for n in RULES],
    ),
)



def _appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit log, appended to a store in two batches and read back."""
    log, store = retail_tables(spark, sf_dir)["audit_log"], f"{_fresh_folder(spark)}/audit"
    append_rows(log.filter("Old_Value IS NULL"), store, by="Table_Name")
    append_rows(log.filter("Old_Value IS NOT NULL"), store, by="Table_Name")
    return spark.read.schema(SCHEMAS["audit_log"]).parquet(store).select(*log.columns)


_add("i11_append_rows", _appended, sql("SELECT * FROM audit_log", "audit_log"))


def _appended_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit log in two batches; one comes twice, and one had an attempt that broke off before its commit."""
    log = retail_tables(spark, sf_dir)["audit_log"]
    store = BatchLog(spark, f"{_fresh_folder(spark)}/audit", SCHEMAS["audit_log"], by="Table_Name")
    parts = {"first": log.filter("Old_Value IS NULL"), "second": log.filter("Old_Value IS NOT NULL")}
    store.write(parts["second"], "second", "broken")
    for batch in ("first", "second", "first"):
        store.append(parts[batch], batch)
    return store.read()


_add("i11_append_batches", _appended_once, sql("SELECT * FROM audit_log", "audit_log"))

# ---- joins, filters, projections -------------------------------------------

ALERT = "FROM shelf WHERE low AND Cat_Active = 1"
_on_tables(
    "a1_product_dashboard",
    reports.product_dashboard,
    sql(
        """SELECT ProductID, Product, Category, Cat_Active, v.Name AS Supplier, Unit_Price, Quantity AS Stock_Qty,
                  Restock_Level, CASE WHEN low THEN 'LOW STOCK' ELSE 'OK' END AS Stock_Status
           FROM shelf JOIN suppliers v USING (SupplierID)""",
        "shelf", "suppliers",
    ),
)
_on_tables(
    "a2_transaction_history",
    reports.transaction_history,
    sql(
        """SELECT TransactionID, Trans_Type, Username, Role, Product, Quantity, Unit_Price, Subtotal, Trans_Date
           FROM lines JOIN users USING (UserID)""",
        "lines", "users",
    ),
)
_on_tables(
    "a3_restock_alert",
    reports.restock_alert,
    sql(
        f"""SELECT ProductID, Product, Category, Quantity AS Current_Stock, Restock_Level,
                   Restock_Level - Quantity AS Units_Needed {ALERT}""",
        "shelf",
    ),
)
R1_SQL = sql(
    """SELECT Product, Category, Quantity AS Current_Stock, Restock_Level, Restock_Level - Quantity AS Units_Needed,
              v.Name AS Supplier, v.Contact AS Supplier_Contact
       FROM shelf JOIN suppliers v USING (SupplierID) WHERE low AND Cat_Active = 1""",
    "shelf", "suppliers",
)
_on_tables("r1_restock_alert_supplier", reports.restock_alert_supplier, R1_SQL)
_on_tables("p0_stock_listing", reports.stock_listing, sql("SELECT Product, Quantity, Restock_Level FROM shelf", "shelf"))
_on_tables(
    "p1_product_catalog",
    reports.product_catalog,
    sql(
        """SELECT ProductID, CategoryID, Product, Category, Cat_Active, v.Name AS Supplier, Unit_Price,
                  Quantity AS Stock_Qty, Restock_Level
           FROM shelf JOIN suppliers v USING (SupplierID)""",
        "shelf", "suppliers",
    ),
)
_on_tables(
    "p2_user_history",
    lambda t: reports.user_history(t, USER),
    sql(
        f"""SELECT TransactionID, Trans_Type, Product AS Product_Name, Quantity, Subtotal, Trans_Date
            FROM lines WHERE UserID = {USER}""",
        "lines",
    ),
)
_on_tables(
    "p3_active_suppliers",
    reports.active_suppliers,
    sql("SELECT SupplierID, Name FROM suppliers WHERE Is_Active = 1", "suppliers"),
)
for suffix, active in (("", None), ("_active", True), ("_inactive", False)):
    where = "" if active is None else f" WHERE IS_ACTIVE = {int(active)}"
    _on_tables(
        f"p4_categories{suffix}",
        partial(reports.categories, active=active),
        sql(f"SELECT CategoryID, Name, IS_ACTIVE FROM category{where}", "category"),
    )
_on_tables(
    "p5_user_directory",
    reports.user_directory,
    sql("SELECT UserID, Username, Email, Role, Is_Active FROM users", "users"),
)

# ---- aggregates ------------------------------------------------------------

_on_tables(
    "a4_supplier_price_range",
    reports.supplier_price_range,
    sql(
        f"""SELECT v.Name AS Supplier, Contact, count(*) AS Total_Products, min(Unit_Price) AS Min_Price,
                   max(Unit_Price) AS Max_Price, {mean('sum(Unit_Price)', 'count(*)')} AS Avg_Price
            FROM products JOIN suppliers v USING (SupplierID) GROUP BY v.Name, Contact""",
        "products", "suppliers",
    ),
)
REVENUE = "FROM lines JOIN category c USING (CategoryID) WHERE Trans_Type = 'SALE' GROUP BY c.Name"
_on_tables(
    "b1_category_revenue",
    reports.category_revenue,
    sql(
        f"""SELECT c.Name AS Category, count(DISTINCT TransactionID) AS Total_Transactions,
                   CAST(sum(Subtotal) AS DECIMAL(28,2)) AS Total_Revenue {REVENUE}""",
        "lines", "category",
    ),
)
_on_tables(
    "b2_category_revenue_over",
    reports.category_revenue_over,
    sql(
        f"""SELECT c.Name AS Category, CAST(sum(Subtotal) AS DECIMAL(28,2)) AS Total_Revenue {REVENUE}
            HAVING sum(Subtotal) > 500""",
        "lines", "category",
    ),
)
_on_tables(
    "b3_category_stock",
    reports.category_stock,
    sql(
        f"""SELECT Category, Cat_Active AS IS_ACTIVE, count(*) AS Product_Count,
                   CAST(sum(Quantity) AS BIGINT) AS Total_Stock, min(Quantity) AS Min_Stock,
                   max(Quantity) AS Max_Stock, {mean('sum(Quantity)', 'count(*)')} AS Avg_Stock
            FROM shelf GROUP BY Category, Cat_Active""",
        "shelf",
    ),
)
_on_tables(
    "b4_user_volume",
    reports.user_volume,
    sql(
        """SELECT Username, Role, count(TransactionID) AS Total_Transactions,
                  CAST(coalesce(sum(Total_Amount), 0) AS DECIMAL(28,2)) AS Total_Amount_Handled
           FROM users LEFT JOIN headers USING (UserID) GROUP BY ALL""",
        "users", "headers",
    ),
)
_on_tables(
    "b5_monthly_summary",
    reports.monthly_summary,
    sql(
        """SELECT strftime(Trans_Date, '%Y-%m') AS Month, Trans_Type, count(*) AS Transaction_Count,
                  CAST(sum(Total_Amount) AS DECIMAL(28,2)) AS Total_Amount
           FROM headers GROUP BY ALL""",
        "headers",
    ),
)
_on_tables(
    "r2_sales_performance",
    reports.sales_performance,
    sql(
        f"""SELECT Product, c.Name AS Category, count(*) AS Times_Sold,
                   CAST(sum(Quantity) AS BIGINT) AS Total_Units_Sold,
                   CAST(sum(Subtotal) AS DECIMAL(28,2)) AS Total_Revenue,
                   {mean('sum(Subtotal)', 'count(*)')} AS Avg_Sale_Value
            FROM lines JOIN category c USING (CategoryID) WHERE Trans_Type = 'SALE' GROUP BY Product, c.Name""",
        "lines", "category",
    ),
)
_on_tables(
    "r3_category_health",
    reports.category_health,
    sql(
        f"""SELECT c.Name AS Category, c.IS_ACTIVE, count(p.ProductID) AS Products,
                   CAST(sum(Quantity) AS BIGINT) AS Total_Stock,
                   CASE c.IS_ACTIVE WHEN 1 THEN '{reports.SELL_AND_RESTOCK}' ELSE '{reports.SELL_ONLY}' END AS Policy
            FROM category c LEFT JOIN products p USING (CategoryID) LEFT JOIN stock USING (ProductID)
            GROUP BY c.Name, c.IS_ACTIVE""",
        "category", "products", "stock",
    ),
)
_on_tables(
    "r5_user_activity",
    reports.user_activity,
    sql(
        """SELECT Username, Role, count(TransactionID) AS Total_Transactions,
                  count(*) FILTER (Trans_Type = 'SALE') AS Sales, count(*) FILTER (Trans_Type = 'RETURN') AS Returns,
                  count(*) FILTER (Trans_Type = 'RESTOCK') AS Restocks,
                  CAST(coalesce(sum(Total_Amount), 0) AS DECIMAL(28,2)) AS Total_Value_Handled
           FROM users LEFT JOIN headers USING (UserID) GROUP BY Username, Role""",
        "users", "headers",
    ),
)


def _health_sql() -> str:
    count = "CAST(count(*) AS VARCHAR)"
    amount = number("sum(Total_Amount)")
    sources = {
        "users": (count, "users"),
        "active_users": (count, "users WHERE Is_Active = 1"),
        "categories": (count, "category"),
        "active_categories": (count, "category WHERE IS_ACTIVE = 1"),
        "inactive_categories": (count, "category WHERE IS_ACTIVE = 0"),
        "suppliers": (count, "suppliers"),
        "products": (count, "products"),
        "restock": (count, "shelf WHERE low AND Cat_Active = 1"),
        "transactions": (count, "headers"),
        "sales": (amount, "headers WHERE Trans_Type = 'SALE'"),
        "returns": (amount, "headers WHERE Trans_Type = 'RETURN'"),
        "audit": (count, "audit_log"),
        "alerts": (count, "reports WHERE Report_Type = 'STOCK_ALERT'"),
    }
    rows = [f"SELECT '{reports.LABELS[k]}' AS Metric, {v} AS Value FROM {src}" for k, (v, src) in sources.items()]
    return sql("\nUNION ALL ".join(rows), "users", "suppliers", "shelf", "headers", "audit_log", "reports")


_on_tables("h1_health_metrics", reports.health_metrics, _health_sql())

# ---- subqueries, semi and anti joins ---------------------------------------

_on_tables(
    "c1_below_avg_stock",
    reports.below_avg_stock,
    sql(
        """SELECT Product, Category, Quantity, Restock_Level FROM shelf
           WHERE Quantity * (SELECT count(*) FROM stock) < (SELECT sum(Quantity) FROM stock)""",
        "shelf",
    ),
)
_on_tables(
    "c2_never_sold",
    reports.never_sold,
    sql(
        """SELECT ProductID, Product, Category, Quantity AS Current_Stock
           FROM shelf ANTI JOIN sold USING (ProductID)""",
        "shelf", "sold",
    ),
)
_on_tables(
    "c3_top_priced",
    reports.top_priced,
    sql(
        """SELECT ProductID, p.Name AS Product, c.Name AS Category, Unit_Price
           FROM products p JOIN category c USING (CategoryID)
           QUALIFY rank() OVER (PARTITION BY CategoryID ORDER BY Unit_Price DESC) = 1""",
        "products", "category",
    ),
)
_on_tables(
    "c4_above_avg_users",
    reports.above_avg_users,
    sql(
        """SELECT Username, Role, count(*) AS Trans_Count FROM users JOIN headers USING (UserID)
           GROUP BY Username, Role
           HAVING count(*) * (SELECT count(DISTINCT UserID) FROM headers) > (SELECT count(*) FROM headers)""",
        "users", "headers",
    ),
)
_on_tables(
    "c5_low_stock_exists",
    reports.low_stock_exists,
    sql(f"SELECT Product, Quantity, Restock_Level {ALERT}", "shelf"),
)

# ---- set operations --------------------------------------------------------

_on_tables(
    "d1_flagged_products",
    reports.flagged_products,
    sql(
        """SELECT ProductID, Product, 'LOW STOCK' AS Flag FROM shelf WHERE low
           UNION SELECT ProductID, Product, 'INACTIVE CATEGORY' FROM shelf WHERE Cat_Active = 0""",
        "shelf",
    ),
)
_on_tables(
    "d2_sales_and_returns",
    reports.sales_and_returns,
    sql(
        """SELECT Trans_Type, Product, Quantity, Subtotal FROM lines WHERE Trans_Type = 'SALE'
           UNION ALL SELECT Trans_Type, Product, Quantity, Subtotal FROM lines WHERE Trans_Type = 'RETURN'""",
        "lines",
    ),
)
_on_tables(
    "d3_stuck_products",
    reports.stuck_products,
    sql("SELECT ProductID, Product AS Name FROM shelf WHERE low AND Cat_Active = 0", "shelf"),
)
_on_tables(
    "d4_actionable_restock",
    reports.actionable_restock,
    sql("SELECT ProductID, Product AS Name FROM shelf WHERE low AND Cat_Active <> 0", "shelf"),
)
_on_tables(
    "d5_users_without_sale",
    reports.users_without_sale,
    sql(
        """SELECT UserID, Username, Role FROM users
           ANTI JOIN (FROM headers WHERE Trans_Type = 'SALE') USING (UserID)""",
        "users", "headers",
    ),
)

# ---- ordering and top-n ----------------------------------------------------

_on_tables(
    "l1_latest_audit",
    lambda t: reports.latest_audit(t, "PRODUCTS"),
    sql(
        """SELECT LogID, Operation, Old_Value, New_Value, Description FROM audit_log
           WHERE LogID = (SELECT max(LogID) FROM audit_log WHERE Table_Name = 'PRODUCTS')""",
        "audit_log",
    ),
)
AUDIT = "LogID, Table_Name, Operation, Record_ID, Changed_By, Old_Value, New_Value"
_on_tables(
    "l2_audit_review",
    reports.audit_review,
    sql(f"SELECT {AUDIT}, upper(strftime(Change_Date, '%d-%b %H:%M:%S')) AS Changed_At FROM audit_log", "audit_log"),
)
_on_tables(
    "r4_audit_tail",
    reports.audit_tail,
    sql(
        f"""SELECT {AUDIT}, upper(strftime(Change_Date, '%d-%b-%y %H:%M:%S')) AS Changed_At
            FROM audit_log ORDER BY LogID DESC LIMIT 20""",
        "audit_log",
    ),
)
_on_tables(
    "l3_audit_feed",
    reports.audit_feed,
    sql(
        """SELECT LogID, Table_Name, Operation, Changed_By, Old_Value, New_Value,
                  strftime(Change_Date, '%Y-%m-%d %H:%M:%S') AS Change_Date, Description
           FROM audit_log ORDER BY LogID DESC LIMIT 50""",
        "audit_log",
    ),
)
_on_tables(
    "l4_report_listing",
    reports.report_listing,
    sql("SELECT ReportID, Report_Type, Generated_At, Report_Data FROM reports", "reports"),
)

# ---- functions -------------------------------------------------------------


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber AS request_id", "IF(l_orderkey % 101 = 4, -5, l_partkey) AS product_id",
        "CAST(l_quantity AS bigint) AS quantity",
    )
    return lookups.price_quotes(requests, retail_tables(spark, sf_dir)["products"])


_add(
    "f1_price_quotes",
    _quotes,
    sql(
        """SELECT cmd_id AS request_id, product_id, CAST(l.l_quantity AS BIGINT) AS quantity,
                  CAST(Unit_Price * CAST(l.l_quantity AS BIGINT) AS DECIMAL(18,2)) AS total_price,
                  CAST(CASE WHEN ProductID IS NULL THEN -20010 END AS INTEGER) AS error_code,
                  CASE WHEN ProductID IS NULL
                       THEN 'ERROR: Product ID ' || product_id || ' not found or inactive.' END AS error
           FROM (SELECT *, l_orderkey * 8 + l_linenumber AS cmd_id,
                        CASE WHEN l_orderkey % 101 = 4 THEN -5 ELSE l_partkey END AS product_id FROM lineitem) l
                LEFT JOIN (FROM products WHERE Is_Active = 1) p ON l.product_id = p.ProductID""",
        "products",
    ),
)
STATUS = """CASE WHEN Quantity = 0 THEN 'OUT OF STOCK' WHEN Quantity < Restock_Level THEN 'LOW STOCK' ELSE 'OK' END"""
_on_tables(
    "f2_stock_status",
    lambda t: lookups.stock_status(t["products"], t["stock_management"]),
    sql(f"SELECT ProductID, Product, Quantity, Restock_Level, {STATUS} AS Status FROM shelf", "shelf"),
)
_add(
    "f3_category_flag",
    lambda spark, sf_dir: lookups.category_flag(
        _read(spark, sf_dir, "part").selectExpr("p_partkey", "p_partkey % 40 AS CategoryID"),
        retail_tables(spark, sf_dir)["category"],
    ),
    sql(
        """SELECT p_partkey, p_partkey % 40 AS CategoryID, coalesce(IS_ACTIVE, -1) AS Function_Result
           FROM part LEFT JOIN category c ON p_partkey % 40 = c.CategoryID""",
        "category",
    ),
)
_on_tables(
    "f4_product_sales",
    lookups.product_sales,
    sql(
        """SELECT p.ProductID, p.Name AS Product,
                  CAST(coalesce(sum(Subtotal), 0) AS DECIMAL(28,2)) AS Total_Sales_Revenue
           FROM products p LEFT JOIN sold USING (ProductID) GROUP BY p.ProductID, p.Name""",
        "products", "sold",
    ),
)


def _dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders")
    cents = (F.col("o_totalprice").cast("decimal(12,2)") * 1).cast("decimal(12,2)")
    small = (F.col("o_orderkey") % 300).cast("decimal(12,2)") / 100
    note = F.when(F.col("o_orderkey") % 3 != 0, F.lit("x"))
    return rows.select(
        "o_orderkey", d.number_text(cents).alias("amount"), d.number_text(small).alias("small"),
        d.number_text(-small).alias("negative"), d.month_text("o_orderdate").alias("month"),
        d.short_time("o_orderdate").alias("short"), d.dated_time("o_orderdate").alias("dated"),
        d.iso_time("o_orderdate").alias("iso"), d.pad("o_orderpriority", 6).alias("cut"),
        d.pad("o_orderkey", 12).alias("padded"), d.text("<", note, ">").alias("joined"),
        d.nvl(note, "-").alias("filled"),
    )


_add(
    "f5_dialect",
    _dialect,
    f"""SELECT o_orderkey, {number('o_totalprice')} AS amount,
               {number('(o_orderkey % 300) / 100.0')} AS small, {number('-(o_orderkey % 300) / 100.0')} AS negative,
               strftime(o_orderdate, '%Y-%m') AS month, upper(strftime(o_orderdate, '%d-%b %H:%M:%S')) AS short,
               upper(strftime(o_orderdate, '%d-%b-%y %H:%M:%S')) AS dated,
               strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS iso, rpad(o_orderpriority, 6, ' ') AS cut,
               rpad(CAST(o_orderkey AS VARCHAR), 12, ' ') AS padded,
               CASE WHEN o_orderkey % 3 <> 0 THEN '<x>' ELSE '<>' END AS joined,
               CASE WHEN o_orderkey % 3 <> 0 THEN 'x' ELSE '-' END AS filled
        FROM orders""",
)

# ---- printed reports -------------------------------------------------------


def _pad(value: str, width: int) -> str:
    return f"rpad(CAST({value} AS VARCHAR), {width}, ' ')"


_on_tables(
    "k1_restock_alert_lines",
    report_lines.restock_alert_lines,
    sql(
        f"""SELECT ProductID, {_pad('Product', 25)} || {_pad('Category', 15)} || {_pad('Quantity', 8)}
                   || {_pad('Restock_Level', 13)} || (Restock_Level - Quantity) AS Line {ALERT}""",
        "shelf",
    ),
)
_on_tables(
    "k1_restock_alert_count",
    report_lines.restock_alert_count,
    sql(f"SELECT count(*) AS Total_Needing_Restock {ALERT}", "shelf"),
)
_on_tables(
    "k2_stock_report_lines",
    report_lines.stock_report_lines,
    sql(
        f"""SELECT ProductID, {_pad('Product', 25)} || {_pad('Category', 15)} || '  Qty: ' || {_pad('Quantity', 5)}
                   || '  Status: ' || {STATUS}
                   || CASE WHEN Cat_Active = 0 THEN ' [CATEGORY INACTIVE]' ELSE '' END AS Line
            FROM shelf""",
        "shelf",
    ),
)
_on_tables(
    "k3_transactions_by_type",
    lambda t: report_lines.transactions_by_type(t, "SALE"),
    sql(
        f"""SELECT TransactionID, Username, Product AS Product_Name, Quantity, Unit_Price, Subtotal, Trans_Date,
                   'TxnID: ' || {_pad('TransactionID', 5)} || 'User: ' || {_pad('Username', 15)}
                   || 'Product: ' || {_pad('Product', 22)} || 'Qty: ' || {_pad('Quantity', 5)}
                   || 'Subtotal: Rs.' || {number('Subtotal')} AS Line
            FROM lines JOIN users USING (UserID) WHERE Trans_Type = 'SALE'""",
        "lines", "users",
    ),
)
_on_tables(
    "k3_type_total",
    lambda t: report_lines.type_total(t, "SALE"),
    sql("SELECT CAST(sum(Subtotal) AS DECIMAL(28,2)) AS Total_Revenue FROM lines WHERE Trans_Type = 'SALE'", "lines"),
)
_on_tables(
    "k4_stock_alert_reports",
    lambda t: report_lines.stock_alert_reports(t, 1, MONTHS),
    sql(
        f"""SELECT CAST((SELECT max(ReportID) FROM reports) + row_number() OVER (ORDER BY ProductID) AS BIGINT)
                       AS ReportID,
                   'STOCK_ALERT' AS Report_Type, CAST(1 AS BIGINT) AS Generated_By,
                   TIMESTAMP '2024-02-01 00:00:00' AS Generated_At,
                   'Product: ' || Product || ' | Category: ' || Category || ' | Stock: ' || Quantity
                   || ' | Needed: ' || (Restock_Level - Quantity) AS Report_Data {ALERT}""",
        "shelf", "reports",
    ),
)
for suffix, kind in (("", None), ("_sale", "SALE")):
    only = f" AND Trans_Type = '{kind}'" if kind else ""
    _on_tables(
        f"v1_view_transactions{suffix}",
        partial(report_lines.view_transactions, user_id=USER, kind=kind),
        sql(
            f"""SELECT TransactionID, Trans_Type, Product AS Product_Name, Quantity, Subtotal, Trans_Date,
                       'TxnID:' || {_pad('TransactionID', 5)} || ' Type:' || {_pad('Trans_Type', 9)}
                       || ' Product:' || {_pad('Product', 23)} || ' Qty:' || {_pad('Quantity', 5)}
                       || ' Amount: Rs.' || {number('Subtotal')} AS Line
                FROM lines WHERE UserID = {USER}{only}""",
            "lines",
        ),
    )
    _add(
        f"v2_view_transactions_total{suffix}",
        lambda spark, sf_dir, kind=kind: report_lines.view_transactions_total(
            retail_tables(spark, sf_dir), _askers(spark, sf_dir), kind
        ),
        sql(
            f"""SELECT user_id, Username, CASE WHEN Username IS NOT NULL THEN n END AS item_count,
                       CASE WHEN Username IS NOT NULL THEN amount END AS total_value,
                       CASE WHEN Username IS NULL THEN 'ERROR: User ID ' || user_id || ' not found.' END AS error
                FROM (SELECT a.user_id, any_value(Username) AS Username, count(TransactionID) AS n,
                             CAST(coalesce(sum(Subtotal), 0) AS DECIMAL(28,2)) AS amount
                      FROM (SELECT CASE WHEN c_custkey % 9 = 4 THEN -c_custkey ELSE c_custkey END AS user_id
                            FROM customer) a
                           LEFT JOIN users u ON u.UserID = a.user_id
                           LEFT JOIN (FROM lines WHERE true{only}) l ON l.UserID = a.user_id
                      GROUP BY a.user_id)""",
            "lines", "users",
        ),
    )

# ---- the ledger ------------------------------------------------------------


def _ledger(spark: SparkSession, sf_dir: str, rules: str = "package") -> ledger.Ledger:
    return ledger.apply_stock_commands(retail_commands(spark, sf_dir), retail_tables(spark, sf_dir), rules)


COMMAND = "cmd_id, event_ts, user_id, product_id, quantity, cmd_type"
DECIDED = f"{COMMAND}, accepted, code, stock_before, stock_after".split(", ")
for rules in ("package", "procedure"):
    judged = "judged" if rules == "package" else "judged_by_procedure"
    suffix = "" if rules == "package" else "_by_procedure"
    _add(
        f"m1_stock_ledger{suffix}",
        lambda spark, sf_dir, rules=rules: _ledger(spark, sf_dir, rules).decided.select(*DECIDED),
        sql(f"SELECT {', '.join(DECIDED)} FROM decided", judged, extra=fold(judged, rules), recursive=True),
    )
    _add(
        f"m2_screen_commands{suffix}",
        lambda spark, sf_dir, rules=rules: ledger.screen_commands(
            retail_commands(spark, sf_dir), retail_tables(spark, sf_dir), rules
        ).select(*COMMAND.split(", "), "code", "late_code"),
        sql(f"SELECT {COMMAND}, code, late_code FROM {judged}", judged),
    )

_add(
    "m1_stock_ledger_blocks",  # the same verdicts when products lie in many blocks
    lambda spark, sf_dir: ledger.apply_stock_commands(
        retail_commands(spark, sf_dir), retail_tables(spark, sf_dir), blocks=64
    ).decided.select(*DECIDED),
    ORACLE["m1_stock_ledger"],
)
KNOWN_UNTIL = "1995-04-01 00:00:00"
_add(
    "m1_stock_ledger_unknown_users",  # blocks in which no command has an effect pass the stock on
    lambda spark, sf_dir: ledger.apply_stock_commands(
        retail_commands(spark, sf_dir).withColumn(
            "user_id", F.expr(f"IF(event_ts > timestamp_ntz'{KNOWN_UNTIL}', -1, user_id)")
        ),
        retail_tables(spark, sf_dir), blocks=64,
    ).decided.select(*DECIDED),
    ORACLE["m1_stock_ledger"].replace(
        "CASE WHEN l_orderkey % 97 = 3 THEN", f"CASE WHEN l_orderkey % 97 = 3 OR o_orderdate > TIMESTAMP '{KNOWN_UNTIL}' THEN"
    ),
)

TAKEN = """,
    taken AS (
        SELECT *, row_number() OVER (ORDER BY event_ts, cmd_id, product_id, quantity) AS n,
               CAST(CASE WHEN cmd_type = 'RESTOCK' THEN 0 ELSE Unit_Price END AS DECIMAL(10,2)) AS price,
               CAST(CASE WHEN cmd_type = 'RESTOCK' THEN 0 ELSE Unit_Price END * quantity AS DECIMAL(12,2)) AS amount
        FROM decided WHERE accepted)"""
NUMBERED = fold() + TAKEN
HEADER = "CAST((SELECT max(TransactionID) FROM headers) + n AS BIGINT)"
_add(
    "m1_rejected_commands",
    lambda spark, sf_dir: _ledger(spark, sf_dir).rejected,
    sql(
        f"""SELECT {COMMAND}, code,
                   CASE WHEN code IN ('-20030', '-20032', '-20024')
                        THEN 'ERROR: Product ID ' || product_id || ' not found or inactive.'
                        WHEN code = '-20031' THEN 'ERROR: Insufficient stock for "' || product_name
                             || '". Available: ' || stock_before || ', Requested: ' || quantity
                        WHEN code = '-20025' THEN 'ERROR: Cannot restock "' || product_name || '". Category "'
                             || category_name || '" is inactive (IS_ACTIVE=0).'
                        WHEN code = '-20004' THEN 'ERROR: Invalid transaction type. Use SALE or RETURN.'
                        WHEN code = 'CHK_QTY' THEN 'quantity must be above 0'
                        ELSE 'unknown user ' || user_id END AS message
            FROM decided WHERE NOT accepted""",
        "judged", extra=fold(), recursive=True,
    ),
)
_add(
    "m3_ledger_headers",
    lambda spark, sf_dir: _ledger(spark, sf_dir).transactions,
    sql(
        f"""SELECT {HEADER} AS TransactionID, user_id AS UserID, cmd_type AS Trans_Type, event_ts AS Trans_Date,
                   amount AS Total_Amount,
                   CASE cmd_type WHEN 'RESTOCK' THEN 'PKG Restock: ' || product_name || ' +' || quantity
                        WHEN 'SALE' THEN coalesce(notes, 'Sale: ' || product_name)
                        ELSE coalesce(notes, 'Return: ' || product_name) END AS Notes
            FROM taken""",
        "judged", "headers", extra=NUMBERED, recursive=True,
    ),
)
_add(
    "m3_ledger_items",
    lambda spark, sf_dir: _ledger(spark, sf_dir).items,
    sql(
        f"""SELECT CAST((SELECT max(ItemID) FROM items) + n AS BIGINT) AS ItemID, {HEADER} AS TransactionID,
                   product_id AS ProductID, quantity AS Quantity, price AS Unit_Price, amount AS Subtotal
            FROM taken""",
        "judged", "headers", "items", extra=NUMBERED, recursive=True,
    ),
)
_add(
    "m4_command_audit",
    lambda spark, sf_dir: _ledger(spark, sf_dir).audit,
    sql(
        f"""SELECT CAST((SELECT max(LogID) FROM audit_log) + n AS BIGINT) AS LogID,
                   CASE cmd_type WHEN 'RESTOCK' THEN 'STOCK_MANAGEMENT' ELSE 'TRANSACTIONS' END AS Table_Name,
                   CASE cmd_type WHEN 'RESTOCK' THEN 'UPDATE' ELSE 'INSERT' END AS Operation,
                   CASE cmd_type WHEN 'RESTOCK' THEN product_id ELSE {HEADER} END AS Record_ID,
                   actor AS Changed_By, event_ts AS Change_Date,
                   CASE cmd_type WHEN 'RESTOCK' THEN 'Qty=' || stock_before END AS Old_Value,
                   CASE cmd_type WHEN 'RESTOCK' THEN 'Qty=' || stock_after
                        ELSE cmd_type || ' Qty=' || quantity || ' Total=' || {number('amount')} END AS New_Value,
                   CASE cmd_type WHEN 'RESTOCK' THEN 'Restock via PKG_ADMIN_OPS for: '
                        WHEN 'SALE' THEN 'Sale via PKG_USER_OPS: ' ELSE 'Return via PKG_USER_OPS: ' END
                   || product_name AS Description
            FROM taken""",
        "judged", "headers", "audit_log", extra=NUMBERED, recursive=True,
    ),
)
BY_PROCEDURE = fold("judged_by_procedure", "procedure") + TAKEN
_add(
    "m3_ledger_headers_by_procedure",
    lambda spark, sf_dir: _ledger(spark, sf_dir, "procedure").transactions,
    sql(
        f"""SELECT {HEADER} AS TransactionID, user_id AS UserID, cmd_type AS Trans_Type, event_ts AS Trans_Date,
                   amount AS Total_Amount,
                   CASE cmd_type WHEN 'RESTOCK' THEN 'Restock: ' || product_name || ' +' || quantity || ' units'
                        ELSE notes END AS Notes
            FROM taken""",
        "judged_by_procedure", "headers", extra=BY_PROCEDURE, recursive=True,
    ),
)
_add(
    "m4_command_audit_by_procedure",
    lambda spark, sf_dir: _ledger(spark, sf_dir, "procedure").audit,
    sql(
        f"""SELECT CAST((SELECT max(LogID) FROM audit_log) + n AS BIGINT) AS LogID,
                   CASE cmd_type WHEN 'RESTOCK' THEN 'STOCK_MANAGEMENT' ELSE 'TRANSACTIONS' END AS Table_Name,
                   CASE cmd_type WHEN 'RESTOCK' THEN 'UPDATE' ELSE 'INSERT' END AS Operation,
                   CASE cmd_type WHEN 'RESTOCK' THEN product_id ELSE {HEADER} END AS Record_ID,
                   actor AS Changed_By, event_ts AS Change_Date,
                   CASE cmd_type WHEN 'RESTOCK' THEN 'Qty=' || stock_before END AS Old_Value,
                   CASE cmd_type WHEN 'RESTOCK' THEN 'Qty=' || stock_after
                        ELSE 'Type=' || cmd_type || ' Product=' || product_name || ' Qty=' || quantity END AS New_Value,
                   CASE cmd_type WHEN 'RESTOCK' THEN 'Restock by procedure for product: ' || product_name
                        ELSE 'Transaction processed by procedure' END AS Description
            FROM taken""",
        "judged_by_procedure", "headers", "audit_log", extra=BY_PROCEDURE, recursive=True,
    ),
)
_add(
    "m5_stock_after",
    lambda spark, sf_dir: _ledger(spark, sf_dir).stock,
    sql(
        """SELECT StockID, ProductID, CAST(s.Quantity + coalesce(sum(effect), 0) AS BIGINT) AS Quantity, Restock_Level,
                  coalesce(max(event_ts), Last_Updated) AS Last_Updated
           FROM stock s LEFT JOIN (FROM decided WHERE accepted) x ON x.product_id = s.ProductID
           GROUP BY StockID, ProductID, s.Quantity, Restock_Level, Last_Updated""",
        "judged", extra=fold(), recursive=True,
    ),
)

# ---- administrative changes ------------------------------------------------


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr(
        "event_id AS change_id", f"{EPOCH} + make_dt_interval(CAST(event_id * 7 % 2400 AS int)) AS event_ts",
        "user_id % 30 AS CategoryID", "IF(event_type IN ('view', 'click'), 1, 0) AS IS_ACTIVE",
        "concat('U', user_id) AS actor",
    )


TURNS = f"""
    turns AS (
        SELECT event_id AS change_id, {START} + to_days(CAST(event_id * 7 % 2400 AS INTEGER)) AS event_ts,
               user_id % 30 AS CategoryID, CAST(event_type IN ('view', 'click') AS INTEGER) AS flag,
               'U' || user_id AS actor
        FROM events),
    history AS (
        SELECT turns.*, c.Name AS category_name,
               coalesce(lag(flag) OVER (PARTITION BY turns.CategoryID ORDER BY event_ts, change_id), c.IS_ACTIVE)
                   AS flag_before
        FROM turns LEFT JOIN category c ON c.CategoryID = turns.CategoryID),
    outcomes AS (
        SELECT *, CASE WHEN category_name IS NULL THEN 'rejected' WHEN flag = 0 AND flag_before = 0 THEN 'no-op'
                       ELSE 'applied' END AS status
        FROM history)"""


def _category_status(spark: SparkSession, sf_dir: str) -> changes.Applied:
    t = retail_tables(spark, sf_dir)
    return changes.apply_category_status(_turns(spark, sf_dir), t["category"], t["products"])


_add(
    "m6_category_outcomes",
    lambda spark, sf_dir: _category_status(spark, sf_dir).outcomes.select(
        "change_id", "event_ts", "CategoryID", "status", "code", "message"
    ),
    sql(
        """SELECT change_id, event_ts, CategoryID, status,
                  CASE status WHEN 'rejected' THEN '-20026' END AS code,
                  CASE status WHEN 'rejected' THEN 'ERROR: Category ID ' || CategoryID || ' does not exist.' END
                      AS message
           FROM outcomes""",
        "category", extra=TURNS,
    ),
)
_add(
    "m6_category_status",
    lambda spark, sf_dir: _category_status(spark, sf_dir).table,
    sql(
        """SELECT c.* REPLACE (coalesce(f.flag, c.IS_ACTIVE) AS IS_ACTIVE)
           FROM category c LEFT JOIN (SELECT CategoryID, arg_max(flag, (event_ts, change_id)) AS flag
                                      FROM turns GROUP BY CategoryID) f USING (CategoryID)""",
        "category", extra=TURNS,
    ),
)
AFFECTED = """(SELECT CategoryID, count(*) AS n FROM products WHERE Is_Active = 1 GROUP BY CategoryID)"""
_add(
    "m6_category_audit",
    lambda spark, sf_dir: _category_status(spark, sf_dir).audit,
    sql(
        f"""SELECT 'CATEGORY' AS Table_Name, 'UPDATE' AS Operation, CategoryID AS Record_ID, actor AS Changed_By,
                   event_ts AS Change_Date, 'IS_ACTIVE=1' AS Old_Value, 'IS_ACTIVE=0' AS New_Value,
                   'Soft delete via PKG_ADMIN_OPS: "' || category_name || '" | ' || coalesce(n, 0)
                   || ' product(s) affected' AS Description
            FROM outcomes LEFT JOIN {AFFECTED} a USING (CategoryID) WHERE status = 'applied' AND flag = 0""",
        "category", "products", extra=TURNS,
    ),
)
_add(
    "m7_affected_products",
    lambda spark, sf_dir: changes.affected_products(_turns(spark, sf_dir), retail_tables(spark, sf_dir)["products"]),
    sql(
        f"""SELECT CategoryID, coalesce(n, 0) AS affected
            FROM (SELECT DISTINCT CategoryID FROM turns WHERE flag = 0) LEFT JOIN {AFFECTED} a USING (CategoryID)""",
        "category", "products", extra=TURNS,
    ),
)


def _added_products(spark: SparkSession, sf_dir: str) -> changes.Added:
    part, supplier = _read(spark, sf_dir, "part"), _read(spark, sf_dir, "supplier")
    rows = part.withColumn("_n", supplier.agg(F.count(F.lit(1))).scalar()).selectExpr(
        "p_partkey AS row_id", f"{EPOCH} AS event_ts", "p_name AS Name", "p_partkey % 30 AS CategoryID",
        "IF(p_partkey % 50 = 7, -1, p_partkey % _n) AS SupplierID",
        "CAST(IF(p_partkey % 41 = 1, 0, p_retailprice) AS decimal(10,2)) AS Unit_Price",
        "IF(p_partkey % 3 = 0, NULL, CAST(p_size AS bigint)) AS Quantity",
        "IF(p_partkey % 2 = 0, NULL, p_partkey % 40) AS Restock_Level", "'admin' AS actor",
    )
    return changes.add_products(rows, retail_tables(spark, sf_dir))


NEW_PRODUCTS = f"""
    asked AS (
        SELECT p_partkey AS row_id, {START} AS event_ts, p_name AS Name, p_partkey % 30 AS CategoryID,
               CASE WHEN p_partkey % 50 = 7 THEN -1 ELSE p_partkey % (SELECT count(*) FROM supplier) END AS SupplierID,
               CAST(CASE WHEN p_partkey % 41 = 1 THEN 0 ELSE p_retailprice END AS DECIMAL(10,2)) AS Unit_Price,
               CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS BIGINT) END AS Quantity,
               CASE WHEN p_partkey % 2 <> 0 THEN p_partkey % 40 END AS Restock_Level
        FROM part),
    verdicts AS (
        SELECT a.*, c.Name AS category_name,
               CASE WHEN c.CategoryID IS NULL THEN '-20020' WHEN c.IS_ACTIVE = 0 THEN '-20021'
                    WHEN coalesce(s.Is_Active, 0) = 0 THEN '-20022' WHEN Unit_Price <= 0 THEN 'CHK_PRICE' END AS code
        FROM asked a LEFT JOIN category c USING (CategoryID) LEFT JOIN suppliers s USING (SupplierID)),
    good AS (SELECT *, row_number() OVER (ORDER BY row_id) AS n FROM verdicts WHERE code IS NULL)"""
NEW_PRODUCT_ID = "CAST((SELECT max(ProductID) FROM products) + n AS BIGINT)"
_add(
    "m8_added_products",
    lambda spark, sf_dir: _added_products(spark, sf_dir).rows,
    sql(
        f"""SELECT {NEW_PRODUCT_ID} AS ProductID, Name, CategoryID, SupplierID, Unit_Price,
                   CAST(1 AS INTEGER) AS Is_Active, event_ts AS Created_At FROM good""",
        "category", "suppliers", "products", extra=NEW_PRODUCTS,
    ),
)
_add(
    "m8_added_stock",
    lambda spark, sf_dir: _added_products(spark, sf_dir).stock,
    sql(
        f"""SELECT CAST((SELECT max(StockID) FROM stock) + n AS BIGINT) AS StockID, {NEW_PRODUCT_ID} AS ProductID,
                   coalesce(Quantity, 0) AS Quantity, coalesce(Restock_Level, 10) AS Restock_Level,
                   event_ts AS Last_Updated FROM good""",
        "category", "suppliers", "products", "stock", extra=NEW_PRODUCTS,
    ),
)
_add(
    "m8_rejected_products",
    lambda spark, sf_dir: _added_products(spark, sf_dir).rejected.select("row_id", "Name", "code", "message"),
    sql(
        """SELECT row_id, Name, code,
                  CASE code WHEN '-20020' THEN 'ERROR: Category ID ' || CategoryID || ' does not exist.'
                       WHEN '-20021' THEN 'ERROR: Cannot add product to inactive category "' || category_name
                                          || '". Activate the category first.'
                       WHEN '-20022' THEN 'ERROR: Supplier ID ' || SupplierID || ' not found or inactive.'
                       ELSE 'table constraint violated' END AS message
           FROM verdicts WHERE code IS NOT NULL""",
        "category", "suppliers", extra=NEW_PRODUCTS,
    ),
)
_add(
    "m8_product_audit",
    lambda spark, sf_dir: _added_products(spark, sf_dir).audit,
    sql(
        f"""SELECT 'PRODUCTS' AS Table_Name, 'INSERT' AS Operation, {NEW_PRODUCT_ID} AS Record_ID,
                   'admin' AS Changed_By, event_ts AS Change_Date, CAST(NULL AS VARCHAR) AS Old_Value,
                   'Name=' || Name || ' Price=' || {number('Unit_Price')} AS New_Value,
                   'New product added via PKG_ADMIN_OPS.Add_Product' AS Description FROM good""",
        "category", "suppliers", "products", extra=NEW_PRODUCTS,
    ),
)


def _added_suppliers(spark: SparkSession, sf_dir: str) -> changes.Added:
    rows = _read(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS row_id", f"{EPOCH} AS event_ts",
        "IF(s_suppkey % 3 = 0, s_name, concat('Vendor ', s_suppkey - s_suppkey % 3)) AS Name",
        "concat('N', s_nationkey) AS Contact", "concat('v', s_suppkey, '@example.com') AS Email",
        "CAST(NULL AS string) AS Address", "'admin' AS actor",
    )
    return changes.add_suppliers(rows, retail_tables(spark, sf_dir)["suppliers"])


NEW_SUPPLIERS = f"""
    asked AS (
        SELECT s_suppkey AS row_id, {START} AS event_ts, 'N' || s_nationkey AS Contact,
               CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'Vendor ' || (s_suppkey - s_suppkey % 3) END AS Name,
               'v' || s_suppkey || '@example.com' AS Email
        FROM supplier),
    firsts AS (SELECT * FROM asked WHERE Name NOT IN (SELECT s_name FROM supplier)
               QUALIFY row_number() OVER (PARTITION BY Name ORDER BY row_id) = 1),
    good AS (SELECT *, row_number() OVER (ORDER BY row_id) AS n FROM firsts)"""
_add(
    "m9_added_suppliers",
    lambda spark, sf_dir: _added_suppliers(spark, sf_dir).rows,
    sql(
        """SELECT CAST((SELECT max(SupplierID) FROM suppliers) + n AS BIGINT) AS SupplierID, Name, Contact, Email,
                  CAST(NULL AS VARCHAR) AS Address, CAST(1 AS INTEGER) AS Is_Active, event_ts AS Created_At
           FROM good""",
        "suppliers", extra=NEW_SUPPLIERS,
    ),
)
_add(
    "m9_rejected_suppliers",
    lambda spark, sf_dir: _added_suppliers(spark, sf_dir).rejected.select("row_id", "Name", "code", "message"),
    sql(
        """SELECT row_id, Name, '-20023' AS code, 'ERROR: Supplier "' || Name || '" already exists.' AS message
           FROM asked WHERE row_id NOT IN (SELECT row_id FROM good)""",
        extra=NEW_SUPPLIERS,
    ),
)


_add(
    "m9_supplier_audit",
    lambda spark, sf_dir: _added_suppliers(spark, sf_dir).audit,
    sql(
        """SELECT 'SUPPLIERS' AS Table_Name, 'INSERT' AS Operation,
                  CAST((SELECT max(SupplierID) FROM suppliers) + n AS BIGINT) AS Record_ID, 'admin' AS Changed_By,
                  event_ts AS Change_Date, CAST(NULL AS VARCHAR) AS Old_Value, 'Name=' || Name AS New_Value,
                  'New supplier added via PKG_ADMIN_OPS.Add_Supplier' AS Description
           FROM good""",
        "suppliers", extra=NEW_SUPPLIERS,
    ),
)


def _added_categories(spark: SparkSession, sf_dir: str) -> changes.Added:
    rows = _read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS row_id", f"{EPOCH} AS event_ts", "IF(p_partkey % 3 = 0, p_brand, p_name) AS Name",
        "p_type AS Description",
    )
    return changes.add_dimension_rows(rows, retail_tables(spark, sf_dir)["category"], "category")


_add(
    "m10_added_categories",
    lambda spark, sf_dir: _added_categories(spark, sf_dir).rows,
    sql(
        f"""SELECT CAST((SELECT max(CategoryID) FROM category) + row_number() OVER (ORDER BY p_partkey) AS BIGINT)
                       AS CategoryID, p_name AS Name, p_type AS Description, CAST(1 AS INTEGER) AS IS_ACTIVE,
                   {START} AS Created_At
            FROM (FROM part WHERE p_partkey % 3 <> 0 AND p_name NOT IN (SELECT Name FROM category)
                  QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1)""",
        "category",
    ),
)


def _added_users(spark: SparkSession, sf_dir: str) -> changes.Added:
    rows = _read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS row_id", f"{EPOCH} AS event_ts", "IF(c_custkey % 47 = 3, NULL, c_name) AS Username",
        "IF(c_custkey % 5 = 0, concat(lower(c_name), '@example.com'), concat('n', c_custkey - c_custkey % 2, '@x.org')) "
        "AS Email",
        "IF(c_custkey % 53 = 5, 'BOSS', 'STAFF') AS Role",
    )
    return changes.add_dimension_rows(rows, retail_tables(spark, sf_dir)["users"], "users")


NEW_USERS = """
    asked AS (
        SELECT c_custkey AS row_id, c_name AS Username,
               CASE WHEN c_custkey % 47 = 3 THEN 'NOT_NULL' WHEN c_custkey % 53 = 5 THEN 'CHK_ROLE' END AS code,
               CASE WHEN c_custkey % 5 = 0 THEN lower(c_name) || '@example.com'
                    ELSE 'n' || (c_custkey - c_custkey % 2) || '@x.org' END AS Email
        FROM customer),
    firsts AS (SELECT * FROM asked WHERE code IS NULL AND Email NOT IN (SELECT Email FROM users)
               QUALIFY row_number() OVER (PARTITION BY Email ORDER BY row_id) = 1)"""
_add(
    "m10_added_users",
    lambda spark, sf_dir: _added_users(spark, sf_dir).rows,
    sql(
        f"""SELECT CAST((SELECT max(UserID) FROM users) + row_number() OVER (ORDER BY row_id) AS BIGINT) AS UserID,
                   Username, Email, 'STAFF' AS Role, CAST(1 AS INTEGER) AS Is_Active, {START} AS Created_At
            FROM firsts""",
        "users", extra=NEW_USERS,
    ),
)
_add(
    "m10_rejected_users",
    lambda spark, sf_dir: _added_users(spark, sf_dir).rejected.select("row_id", "Email", "code"),
    sql(
        """SELECT row_id, Email, coalesce(code, 'UNIQUE_EMAIL') AS code FROM asked
           WHERE row_id NOT IN (SELECT row_id FROM firsts)""",
        "users", extra=NEW_USERS,
    ),
)
_add(
    "m11_price_updates",
    lambda spark, sf_dir: changes.apply_updates(
        retail_tables(spark, sf_dir)["products"],
        _read(spark, sf_dir, "lineitem").selectExpr(
            "l_partkey AS ProductID", "l_shipdate AS event_ts", "l_orderkey * 8 + l_linenumber AS change_id",
            "IF(l_linenumber = 7, NULL, CAST(l_extendedprice AS decimal(10,2))) AS Unit_Price",
            "CAST(l_extendedprice AS decimal(10,2)) AS tie",
        ),
        "ProductID", ["Unit_Price"], ("event_ts", "change_id", "tie"), "products",
    ),
    sql(
        """SELECT p.* REPLACE (coalesce(u.price, p.Unit_Price) AS Unit_Price)
           FROM products p LEFT JOIN (
                SELECT l_partkey AS ProductID,
                       arg_max(CAST(l_extendedprice AS DECIMAL(10,2)),
                               (l_shipdate, l_orderkey * 8 + l_linenumber, l_extendedprice)) AS price
                FROM lineitem WHERE l_linenumber <> 7 GROUP BY l_partkey) u USING (ProductID)""",
        "products",
    ),
)
_add(
    "m11_rejected_updates",
    lambda spark, sf_dir: changes.screen_updates(
        _read(spark, sf_dir, "lineitem").selectExpr(
            "l_partkey AS ProductID", "l_shipdate AS event_ts", "l_orderkey * 8 + l_linenumber AS change_id",
            "CAST(CASE l_linenumber WHEN 7 THEN NULL WHEN 6 THEN 0 WHEN 5 THEN -l_extendedprice ELSE l_extendedprice END "
            "AS decimal(10,2)) AS Unit_Price",
            "IF(l_orderkey % 50 = 0, 7, 1) AS Is_Active",
        ),
        "products", ["Unit_Price", "Is_Active"],
    )[1].select("ProductID", "change_id", "code"),
    """SELECT l_partkey AS ProductID, l_orderkey * 8 + l_linenumber AS change_id,
              CASE WHEN l_orderkey % 50 = 0 THEN 'CHK_FLAG' ELSE 'CHK_PRICE' END AS code
       FROM lineitem WHERE l_orderkey % 50 = 0 OR l_linenumber IN (5, 6)""",
)
_add(
    "m11_user_status",
    lambda spark, sf_dir: changes.apply_updates(
        retail_tables(spark, sf_dir)["users"],
        _read(spark, sf_dir, "events").selectExpr(
            "user_id AS UserID", "ts AS event_ts", "event_id AS change_id", "IF(event_type = 'error', 0, 1) AS Is_Active"
        ),
        "UserID", ["Is_Active"], table="users",
    ),
    sql(
        """SELECT u.* REPLACE (coalesce(e.flag, u.Is_Active) AS Is_Active)
           FROM users u LEFT JOIN (
                SELECT user_id AS UserID, arg_max(CAST(event_type <> 'error' AS INTEGER), (ts, event_id)) AS flag
                FROM events GROUP BY user_id) e USING (UserID)""",
        "users",
    ),
)


def _day_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger commands mixed with category changes and price changes in one time order."""
    cmds = retail_commands(spark, sf_dir)
    turns = _turns(spark, sf_dir).selectExpr(
        "change_id AS cmd_id", "event_ts", "IF(IS_ACTIVE = 1, 'CATEGORY_ON', 'CATEGORY_OFF') AS cmd_type",
        "CategoryID AS category_id", "actor",
    )
    prices = _read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS cmd_id", "o_orderdate AS event_ts", "'SET_PRICE' AS cmd_type",
        "o_orderkey * 13 % 2100 AS product_id", "CAST(o_totalprice AS decimal(10,2)) AS unit_price",
    )
    log = cmds.unionByName(turns, allowMissingColumns=True).unionByName(prices, allowMissingColumns=True)
    missing = [F.lit(None).alias(f.name) for f in LOG_SCHEMA if f.name not in log.columns]
    return log.select("*", *missing).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LOG_SCHEMA])


# the status and price in force: the latest change not after the command's place
DAY = TURNS + """,
    valid AS (SELECT CategoryID, event_ts, change_id, flag FROM outcomes WHERE status <> 'rejected'
              UNION ALL SELECT CategoryID, TIMESTAMP '0001-01-01', -1, IS_ACTIVE FROM category),
    prices AS (SELECT o_orderkey * 13 % 2100 AS ProductID, o_orderdate AS event_ts, o_orderkey AS cmd_id,
                      CAST(o_totalprice AS DECIMAL(10,2)) AS price FROM orders
               UNION ALL SELECT ProductID, TIMESTAMP '0001-01-01', -1, Unit_Price FROM products),
    day AS (
        SELECT f.* EXCLUDE (flag, Unit_Price), c.flag, p.price AS Unit_Price
        FROM (SELECT facts.*, CategoryID FROM facts LEFT JOIN products ON product_id = ProductID) f
             ASOF LEFT JOIN (SELECT *, {'t': event_ts, 'i': change_id} AS place FROM valid) c
                  ON f.CategoryID = c.CategoryID AND {'t': f.event_ts, 'i': f.cmd_id} >= c.place
             ASOF LEFT JOIN (SELECT *, {'t': event_ts, 'i': cmd_id} AS place FROM prices) p
                  ON f.product_id = p.ProductID AND {'t': f.event_ts, 'i': f.cmd_id} >= p.place),
    day_judged AS (
        SELECT *,
               CASE WHEN cmd_type NOT IN ('SALE', 'RETURN', 'RESTOCK') THEN '-20004'
                    WHEN NOT usable THEN CASE cmd_type WHEN 'SALE' THEN '-20030' WHEN 'RETURN' THEN '-20032'
                                              ELSE '-20024' END
                    WHEN cmd_type = 'RESTOCK' AND flag = 0 THEN '-20025' END AS code,
               CASE WHEN quantity <= 0 THEN 'CHK_QTY' WHEN NOT user_known THEN 'FK_USER' END AS late_code
        FROM day),""" + fold("day_judged")
_add(
    "m12_replay",
    lambda spark, sf_dir: replay(_day_log(spark, sf_dir), retail_tables(spark, sf_dir)).ledger.decided.select(
        *DECIDED, F.col("Unit_Price").alias("price")
    ),
    sql(
        f"SELECT {', '.join(DECIDED)}, Unit_Price AS price FROM decided",
        "facts", extra=DAY, recursive=True,
    ),
)
_add(
    "m12_replay_outcomes",
    lambda spark, sf_dir: replay(_day_log(spark, sf_dir), retail_tables(spark, sf_dir)).outcomes,
    sql(
        """SELECT cmd_id, event_ts, cmd_type, CASE WHEN accepted THEN 'applied' ELSE 'rejected' END AS status, code
           FROM decided
           UNION ALL
           SELECT change_id, event_ts, CASE flag WHEN 1 THEN 'CATEGORY_ON' ELSE 'CATEGORY_OFF' END, status,
                  CASE status WHEN 'rejected' THEN '-20026' END FROM outcomes
           UNION ALL
           SELECT o_orderkey, o_orderdate, 'SET_PRICE',
                  CASE WHEN o_orderkey * 13 % 2100 IN (SELECT ProductID FROM products)
                       THEN CASE WHEN CAST(o_totalprice AS DECIMAL(10,2)) > 0 THEN 'applied' ELSE 'rejected' END
                       ELSE 'no-op' END,
                  CASE WHEN o_orderkey * 13 % 2100 IN (SELECT ProductID FROM products)
                            AND CAST(o_totalprice AS DECIMAL(10,2)) <= 0 THEN 'CHK_PRICE' END
           FROM orders""",
        "facts", extra=DAY, recursive=True,
    ),
)



def _admin_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New products, some with a bad value or an id that is taken, and price changes a day later."""
    part = _read(spark, sf_dir, "part")
    n_suppliers = _read(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()
    ids = "p_partkey + 1000000 - p_partkey % 2 AS product_id"
    added = part.withColumn("_n", n_suppliers).selectExpr(
        "p_partkey AS cmd_id", f"{EPOCH} AS event_ts", "'ADD_PRODUCT' AS cmd_type",
        "IF(p_partkey % 31 = 0, p_partkey, p_partkey + 1000000 - p_partkey % 2) AS product_id",
        "IF(p_partkey % 17 = 0, NULL, p_name) AS name", "p_partkey % 30 AS category_id", "p_partkey % _n AS supplier_id",
        "CAST(IF(p_partkey % 41 = 1, 0, p_retailprice) AS decimal(10,2)) AS unit_price",
        "IF(p_partkey % 43 = 2, -1, CAST(p_size AS bigint)) AS quantity", "p_partkey % 40 AS restock_level", "'admin' AS actor",
    )
    prices = part.filter("p_partkey % 3 = 0").selectExpr(
        "p_partkey AS cmd_id", f"{EPOCH} + INTERVAL 1 DAY AS event_ts", "'SET_PRICE' AS cmd_type", ids,
        "CAST(IF(p_partkey % 5 = 0, 0, p_retailprice + 1.25) AS decimal(10,2)) AS unit_price",
    )
    log = added.unionByName(prices, allowMissingColumns=True)
    missing = [F.lit(None).alias(f.name) for f in LOG_SCHEMA if f.name not in log.columns]
    return log.select("*", *missing).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LOG_SCHEMA])


def _administered(spark: SparkSession, sf_dir: str):
    return replay(_admin_log(spark, sf_dir), retail_tables(spark, sf_dir))


ADMINISTERED = f"""
    asked AS (
        SELECT p_partkey AS cmd_id, CASE WHEN p_partkey % 31 = 0 THEN p_partkey ELSE p_partkey + 1000000 - p_partkey % 2 END AS id,
               p_name AS Name, p_partkey % 30 AS CategoryID, p_partkey % (SELECT count(*) FROM supplier) AS SupplierID,
               CAST(CASE WHEN p_partkey % 41 = 1 THEN 0 ELSE p_retailprice END AS DECIMAL(10,2)) AS price,
               CAST(p_size AS BIGINT) AS quantity, p_partkey % 40 AS level
        FROM part),
    judged_rows AS (
        SELECT a.*, CASE WHEN c.CategoryID IS NULL THEN '-20020' WHEN c.IS_ACTIVE = 0 THEN '-20021'
                         WHEN coalesce(s.Is_Active, 0) = 0 THEN '-20022' WHEN cmd_id % 17 = 0 THEN 'NOT_NULL'
                         WHEN price <= 0 THEN 'CHK_PRICE' WHEN cmd_id % 43 = 2 THEN 'CHK_QTY' END AS broken
        FROM asked a LEFT JOIN category c USING (CategoryID) LEFT JOIN suppliers s USING (SupplierID)),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY id, broken IS NULL ORDER BY cmd_id) AS turn FROM judged_rows),
    verdicts AS (
        SELECT *, coalesce(broken, CASE WHEN turn > 1 OR id IN (SELECT ProductID FROM products) THEN 'UNIQUE_ID' END) AS code
        FROM ranked),
    good AS (SELECT *, row_number() OVER (ORDER BY cmd_id) AS n FROM verdicts WHERE code IS NULL),
    priced AS (
        SELECT p_partkey AS cmd_id, p_partkey + 1000000 - p_partkey % 2 AS id, p_partkey % 5 <> 0 AS positive,
               CAST(p_retailprice + 1.25 AS DECIMAL(10,2)) AS price
        FROM part WHERE p_partkey % 3 = 0),
    changed AS (
        SELECT p.*, g.Name, coalesce(lag(p.price) OVER (PARTITION BY p.id ORDER BY p.cmd_id), g.price) AS old
        FROM priced p JOIN good g USING (id) WHERE positive)"""
_add(
    "m12_admin_outcomes",
    lambda spark, sf_dir: _administered(spark, sf_dir).outcomes.select("cmd_id", "cmd_type", "status", "code"),
    sql(
        """SELECT cmd_id, 'ADD_PRODUCT' AS cmd_type, CASE WHEN code IS NULL THEN 'applied' ELSE 'rejected' END AS status, code
           FROM verdicts
           UNION ALL
           SELECT cmd_id, 'SET_PRICE', CASE WHEN id NOT IN (SELECT id FROM good) THEN 'no-op'
                                            WHEN positive THEN 'applied' ELSE 'rejected' END,
                  CASE WHEN id IN (SELECT id FROM good) AND NOT positive THEN 'CHK_PRICE' END
           FROM priced""",
        "category", "suppliers", "products", extra=ADMINISTERED,
    ),
)
_add(
    "m12_products",
    lambda spark, sf_dir: _administered(spark, sf_dir).tables["products"],
    sql(
        f"""SELECT * FROM products
            UNION ALL
            SELECT id, Name, CategoryID, SupplierID,
                   coalesce((SELECT arg_max(c.price, c.cmd_id) FROM changed c WHERE c.id = good.id), price), 1, {START}
            FROM good""",
        "category", "suppliers", "products", extra=ADMINISTERED,
    ),
)
_add(
    "m12_stock",
    lambda spark, sf_dir: _administered(spark, sf_dir).tables["stock_management"],
    sql(
        f"""SELECT * FROM stock
            UNION ALL
            SELECT CAST((SELECT max(StockID) FROM stock) + n AS BIGINT), id, quantity, level, {START} FROM good""",
        "category", "suppliers", "products", "stock", extra=ADMINISTERED,
    ),
)
_add(
    "m12_audit",
    lambda spark, sf_dir: _administered(spark, sf_dir).admin_audit,
    sql(
        f"""SELECT 'PRODUCTS' AS Table_Name, 'INSERT' AS Operation, id AS Record_ID, 'admin' AS Changed_By,
                   {START} AS Change_Date, CAST(NULL AS VARCHAR) AS Old_Value,
                   'Name=' || Name || ' Price=' || {number('price')} AS New_Value,
                   'New product added via PKG_ADMIN_OPS.Add_Product' AS Description
            FROM good
            UNION ALL
            SELECT 'PRODUCTS', 'UPDATE', id, 'system', {START} + INTERVAL 1 DAY,
                   'Name=' || Name || ' Price=' || {number('old')} || ' Active=1',
                   'Name=' || Name || ' Price=' || {number('price')} || ' Active=1', 'Auto-logged by TRG_AUDIT_PRODUCTS'
            FROM changed""",
        "category", "suppliers", "products", extra=ADMINISTERED,
    ),
)

# ---- change capture --------------------------------------------------------

_on_tables(
    "t1_net_movement",
    lambda t: ledger.net_movement(t["transaction_items"], t["transactions"], t["stock_management"]),
    sql(
        """SELECT s.ProductID, s.Quantity AS stock_before, CAST(coalesce(m.net, 0) AS BIGINT) AS net,
                  CAST(s.Quantity + coalesce(m.net, 0) AS BIGINT) AS stock_after
           FROM stock s LEFT JOIN (
                SELECT ProductID, sum(CASE Trans_Type WHEN 'SALE' THEN -Quantity ELSE Quantity END) AS net
                FROM lines GROUP BY ProductID) m USING (ProductID)""",
        "stock", "lines",
    ),
)
_on_tables(
    "t1_stock_from_items",
    lambda t: ledger.stock_from_items(t["transaction_items"], t["transactions"], t["stock_management"]),
    sql(
        """SELECT ItemID, TransactionID, ProductID, Trans_Type, Quantity, running_stock,
                  CASE WHEN running_stock < 0 THEN '-20041' END AS code
           FROM (SELECT l.ItemID, l.TransactionID, l.ProductID, l.Trans_Type, l.Quantity,
                        CAST(s.Quantity + sum(CASE Trans_Type WHEN 'SALE' THEN -l.Quantity ELSE l.Quantity END)
                             OVER (PARTITION BY ProductID ORDER BY Trans_Date, TransactionID, ItemID, l.Quantity
                                   ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_stock
                 FROM lines l JOIN stock s USING (ProductID))""",
        "stock", "lines",
    ),
)


def _new_products(t: Tables) -> DataFrame:
    old = t["products"]
    kept = old.filter("ProductID % 17 <> 0").withColumns(
        {
            "Unit_Price": F.expr("CAST(IF(ProductID % 13 = 0, Unit_Price + 1.25, Unit_Price) AS decimal(10,2))"),
            "CategoryID": F.expr("IF(ProductID % 31 = 0, CategoryID + 1, CategoryID)"),
        }
    )
    return kept.unionByName(old.withColumn("ProductID", F.col("ProductID") + 1_000_000_000_000))


_on_tables(
    "t2_audit_products",
    lambda t: audit.audit_products(t["products"], _new_products(t)),
    sql(
        f"""SELECT 'PRODUCTS' AS Table_Name, Operation, Record_ID, Old_Value, New_Value,
                   'Auto-logged by TRG_AUDIT_PRODUCTS' AS Description
            FROM (
              SELECT 'INSERT' AS Operation, ProductID + 1000000000000 AS Record_ID, CAST(NULL AS VARCHAR) AS Old_Value,
                     'Name=' || Name || ' Price=' || {number('Unit_Price')} || ' CatID=' || CategoryID || ' Active='
                     || Is_Active AS New_Value
              FROM products
              UNION ALL
              SELECT 'DELETE', ProductID, 'Name=' || Name || ' Price=' || {number('Unit_Price')}, NULL
              FROM products WHERE ProductID % 17 = 0
              UNION ALL
              SELECT 'UPDATE', ProductID,
                     'Name=' || Name || ' Price=' || {number('Unit_Price')} || ' Active=' || Is_Active,
                     'Name=' || Name || ' Price='
                     || {number("(Unit_Price + CASE WHEN ProductID % 13 = 0 THEN 1.25 ELSE 0 END)")}
                     || ' Active=' || Is_Active
              FROM products WHERE ProductID % 17 <> 0 AND (ProductID % 13 = 0 OR ProductID % 31 = 0))""",
        "products",
    ),
)
_on_tables(
    "t3_audit_category",
    lambda t: audit.audit_category(
        t["category"],
        t["category"].withColumns(
            {
                "IS_ACTIVE": F.expr("IF(CategoryID % 2 = 0, 1 - IS_ACTIVE, IS_ACTIVE)"),
                "Name": F.expr("IF(CategoryID % 3 = 0, concat(Name, ' new'), Name)"),
            }
        ),
    ),
    sql(
        """SELECT 'CATEGORY' AS Table_Name, 'UPDATE' AS Operation, CategoryID AS Record_ID,
                  'Name=' || Name || ' IS_ACTIVE=' || IS_ACTIVE AS Old_Value,
                  'Name=' || later || ' IS_ACTIVE=' || flag AS New_Value,
                  CASE WHEN IS_ACTIVE > flag
                       THEN 'SOFT DELETE: Category "' || later || '" deactivated. Products can sell, NOT restock.'
                       WHEN IS_ACTIVE < flag
                       THEN 'REACTIVATED: Category "' || later || '" is now active. Restocking allowed.'
                       ELSE 'UPDATE on Category "' || later || '"' END AS Description
           FROM (SELECT *, CASE WHEN CategoryID % 2 = 0 THEN 1 - IS_ACTIVE ELSE IS_ACTIVE END AS flag,
                        Name || CASE WHEN CategoryID % 3 = 0 THEN ' new' ELSE '' END AS later FROM category)
           WHERE flag <> IS_ACTIVE OR later <> Name""",
        "category",
    ),
)
_on_tables(
    "t4_audit_stock",
    lambda t: audit.audit_stock(
        t["stock_management"],
        t["stock_management"].withColumn("Quantity", F.expr("Quantity + ProductID % 5 - 2")),
        t["products"],
    ),
    sql(
        """SELECT 'STOCK_MANAGEMENT' AS Table_Name, 'UPDATE' AS Operation, ProductID AS Record_ID,
                  'Qty=' || Quantity AS Old_Value, 'Qty=' || (Quantity + delta) AS New_Value,
                  'Stock change for "' || Product || '" | Delta: '
                  || CASE WHEN delta > 0 THEN '+' || delta ELSE '-' || -delta END AS Description
           FROM (SELECT *, ProductID % 5 - 2 AS delta FROM shelf) WHERE delta <> 0""",
        "shelf",
    ),
)


def _screened_items(t: Tables) -> audit.Screened:
    loose = _loose(t)
    items = loose["transaction_items"].withColumn(
        "TransactionID", F.expr("IF(TransactionID % 211 = 0, -1, TransactionID)")
    )
    return audit.block_restock(items, t["transactions"], t["products"], t["category"])


SCREENED = """
    loose AS (
        SELECT i.* REPLACE (CASE WHEN ProductID % 19 = 0 THEN -1 - ProductID ELSE ProductID END AS ProductID,
                            CASE WHEN TransactionID % 211 = 0 THEN -1 ELSE TransactionID END AS TransactionID)
        FROM items i),
    screened AS (
        SELECT l.*, p.Name AS product_name, c.Name AS category_name,
               CASE WHEN h.TransactionID IS NULL THEN '-20051'
                    WHEN h.Trans_Type = 'RESTOCK' AND c.CategoryID IS NULL THEN '-20051'
                    WHEN h.Trans_Type = 'RESTOCK' AND c.IS_ACTIVE = 0 THEN '-20050' END AS code
        FROM loose l LEFT JOIN headers h USING (TransactionID) LEFT JOIN products p USING (ProductID)
             LEFT JOIN category c USING (CategoryID))"""
_on_tables(
    "t5_allowed_items",
    lambda t: _screened_items(t).allowed,
    sql(
        """SELECT ItemID, TransactionID, ProductID, Quantity, Unit_Price, Subtotal FROM screened
           WHERE code IS NULL""",
        "items", "headers", "products", "category", extra=SCREENED,
    ),
)
_on_tables(
    "t5_blocked_items",
    lambda t: _screened_items(t).blocked,
    sql(
        """SELECT ItemID, TransactionID, ProductID, Quantity, Unit_Price, Subtotal, code,
                  CASE code WHEN '-20050' THEN 'TRIGGER BLOCKED: Cannot restock "' || product_name || '". Category "'
                       || category_name || '" is inactive (IS_ACTIVE=0). This is enforced at database trigger level.'
                       ELSE 'TRG_BLOCK_RESTOCK: Product or Transaction not found.' END AS message
           FROM screened WHERE code IS NOT NULL""",
        "items", "headers", "products", "category", extra=SCREENED,
    ),
)

# ---- streams ---------------------------------------------------------------


def _feed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # the pattern matches a file or a folder of that name; a plain path would have to be a folder
    schema = _file_schema(spark, f"{sf_dir}/{name}.parquet")
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _run_to_end(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


COMPACT = 2  # so few that a run of four batches merges some


def _streamed(spark: SparkSession, sf_dir: str, parts: int = 4) -> tuple[Tables, str]:
    """The commands as a feed that grows by one slice of time after the other; each slice is a micro-batch."""
    t, base, cmds = retail_tables(spark, sf_dir), _fresh_folder(spark), retail_commands(spark, sf_dir)
    first, last = cmds.agg(F.min("event_ts"), F.max("event_ts")).first()
    cuts = [first + (last - first) * k / parts for k in range(1, parts)]
    at = F.lit(0)
    for cut in cuts:
        at = at + (F.col("event_ts") > F.lit(cut)).cast("int")
    with releasing(spark):  # written once, a folder for each slice, and never copied
        cmds.withColumn("slice", at).filter("slice IS NOT NULL").write.partitionBy("slice").parquet(f"{base}/feed")
    for k in range(parts):
        arrived = ",".join(map(str, range(k + 1)))
        feed = spark.readStream.schema(cmds.schema).parquet(f"{base}/feed/slice={{{arrived}}}")
        _run_to_end(stream_ledger(feed, t, base, compact=COMPACT))
    return t, base


def _stream_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, base = _streamed(spark, sf_dir)
    return stream_stock(spark, base, t["stock_management"], COMPACT)


def _stream_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_decided(spark, _streamed(spark, sf_dir)[1], COMPACT).select(*DECIDED)


_add("x1_stream_ledger", _stream_decided, ORACLE["m1_stock_ledger"])
_add("x1_stream_stock", _stream_stock, ORACLE["m5_stock_after"])


def _stream_product_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of product images: part rows that were born, died or changed price."""
    rows = _feed(spark, sf_dir, "part").selectExpr(
        "p_partkey AS ProductID", "p_name AS Name", "CAST(p_retailprice AS decimal(10,2)) AS Unit_Price",
        "p_partkey % 25 AS CategoryID", "CAST(p_partkey % 2 AS int) AS Is_Active",
    )
    names = ("ProductID", "Name", "Unit_Price", "CategoryID", "Is_Active")
    dearer = (F.col("Unit_Price") + 1).cast("decimal(10,2)").alias("Unit_Price")
    before = F.struct(*names)
    after = F.struct(*[dearer if c == "Unit_Price" else c for c in names])
    feed = rows.select(
        F.col("ProductID").alias("seq"), F.when(F.col("ProductID") % 3 != 0, before).alias("before"),
        F.when(F.col("ProductID") % 3 != 1, after).alias("after"),
    )
    base = _fresh_folder(spark)
    _run_to_end(stream_audit(feed, "products", base))
    return stream_audit_rows(spark, "products", base).select(
        "seq", "Table_Name", "Operation", "Record_ID", "Old_Value", "New_Value", "Description"
    )


_add(
    "x2_stream_audit",
    _stream_product_audit,
    sql(
        f"""SELECT id AS seq, 'PRODUCTS' AS Table_Name,
                   CASE id % 3 WHEN 0 THEN 'INSERT' WHEN 1 THEN 'DELETE' ELSE 'UPDATE' END AS Operation,
                   id AS Record_ID,
                   CASE id % 3 WHEN 1 THEN old WHEN 2 THEN old || flag END AS Old_Value,
                   CASE id % 3 WHEN 0 THEN new || ' CatID=' || id % 25 || flag WHEN 2 THEN new || flag END AS New_Value,
                   'Auto-logged by TRG_AUDIT_PRODUCTS' AS Description
            FROM images""",
        extra=f"""
        images AS (
            SELECT p_partkey AS id, ' Active=' || p_partkey % 2 AS flag,
                   'Name=' || p_name || ' Price=' || {number('p_retailprice')} AS old,
                   'Name=' || p_name || ' Price=' || {number('(CAST(p_retailprice AS DECIMAL(10,2)) + 1)')} AS new
            FROM part)""",
    ),
)


def _stream_stock_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _feed(spark, sf_dir, "part").selectExpr("p_partkey AS ProductID", "CAST(p_size AS bigint) AS Quantity")
    before, after = F.struct("ProductID", "Quantity"), F.expr("struct(ProductID, Quantity + ProductID % 5 - 2 AS Quantity)")
    feed = rows.select(F.col("ProductID").alias("seq"), before.alias("before"), after.alias("after"))
    base = _fresh_folder(spark)
    _run_to_end(stream_audit(feed, "stock", base, retail_tables(spark, sf_dir)["products"]))
    return stream_audit_rows(spark, "stock", base).select("seq", "Record_ID", "Old_Value", "New_Value", "Description")


_add(
    "x2_stream_stock_audit",
    _stream_stock_audit,
    """SELECT p_partkey AS seq, p_partkey AS Record_ID, 'Qty=' || p_size AS Old_Value,
              'Qty=' || (p_size + p_partkey % 5 - 2) AS New_Value,
              'Stock change for "' || p_name || '" | Delta: '
              || CASE WHEN p_partkey % 5 > 2 THEN '+' || (p_partkey % 5 - 2) ELSE '-' || (2 - p_partkey % 5) END
                  AS Description
       FROM part""",
)

# ---- header and item joins without a shuffle of items ------------------------

_bucketed("a2_transaction_history", lambda spark, sf_dir, t: reports.transaction_history(t))
_bucketed("b1_category_revenue", lambda spark, sf_dir, t: reports.category_revenue(t))
_bucketed("d2_sales_and_returns", lambda spark, sf_dir, t: reports.sales_and_returns(t))
_bucketed("v2_view_transactions_total", lambda spark, sf_dir, t: report_lines.view_transactions_total(t, _askers(spark, sf_dir)))
