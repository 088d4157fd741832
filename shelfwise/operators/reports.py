"""Report queries: joins, aggregates, subqueries, set operations and top-n lists.

Facts are filtered and pre-aggregated on their own key before they meet a
dimension, so a key that holds a large share of the rows is reduced inside the
map tasks. No side is broadcast by hint: Spark decides from the measured size
(``spark.sql.autoBroadcastJoinThreshold``, and AQE at run time), and otherwise
sort-merges with skewed partitions split. Sorts end in a key so that equal
leading values still spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfwise.functions.dialect import (
    average, dated_time, iso_time, low_stock, month_text, number_text, nvl, ratio, short_time, total,
)
from shelfwise.model import TOTAL
from shelfwise.sources.tables import Tables

def row_count():
    return F.count(F.lit(1))


def down(column: str):
    return F.col(column).desc_nulls_first()


def up(column: str):
    return F.col(column).asc_nulls_last()


def _products(t: Tables) -> DataFrame:
    return t["products"].select(
        "ProductID", F.col("Name").alias("Product"), "CategoryID", "SupplierID", "Unit_Price"
    )


def _categories(t: Tables) -> DataFrame:
    return t["category"].select("CategoryID", F.col("Name").alias("Category"), F.col("IS_ACTIVE").alias("Cat_Active"))


def _suppliers(t: Tables) -> DataFrame:
    return t["suppliers"].select("SupplierID", F.col("Name").alias("Supplier"), "Contact")


def _stock(t: Tables) -> DataFrame:
    return t["stock_management"].select("ProductID", "Quantity", "Restock_Level")


def _headers(t: Tables, kind: str | None = None) -> DataFrame:
    headers = t["transactions"].select("TransactionID", "UserID", "Trans_Type", "Trans_Date")
    return headers if kind is None else headers.filter(F.col("Trans_Type") == kind)


def _items(t: Tables) -> DataFrame:
    return t["transaction_items"].select(
        "ItemID", "TransactionID", "ProductID", "Quantity", F.col("Unit_Price").alias("Item_Price"), "Subtotal"
    )


def _stocked(t: Tables) -> DataFrame:
    return _products(t).join(_stock(t), "ProductID").join(_categories(t), "CategoryID")


def low_in_active(t: Tables) -> DataFrame:
    """Products below their restock level whose category may be restocked."""
    short = _stock(t).filter(low_stock())
    active = _categories(t).filter("Cat_Active = 1")
    return _products(t).join(short, "ProductID").join(active, "CategoryID").withColumn(
        "Units_Needed", F.col("Restock_Level") - F.col("Quantity")
    )


# ---- joins and projections -------------------------------------------------

def product_dashboard(t: Tables) -> DataFrame:
    return (
        _stocked(t).join(_suppliers(t), "SupplierID")
        .orderBy(up("Category"), up("Product"), "ProductID")
        .select(
            "ProductID", "Product", "Category", "Cat_Active", "Supplier", "Unit_Price",
            F.col("Quantity").alias("Stock_Qty"), "Restock_Level",
            F.when(low_stock(), "LOW STOCK").otherwise("OK").alias("Stock_Status"),
        )
    )


def transaction_history(t: Tables) -> DataFrame:
    people = t["users"].select("UserID", "Username", "Role")
    return (
        _items(t).join(_headers(t), "TransactionID").join(people, "UserID")
        .join(_products(t).select("ProductID", "Product"), "ProductID")
        .orderBy(down("Trans_Date"), "TransactionID", "ItemID")
        .select(
            "TransactionID", "Trans_Type", "Username", "Role", "Product", "Quantity",
            F.col("Item_Price").alias("Unit_Price"), "Subtotal", "Trans_Date",
        )
    )


def restock_alert(t: Tables) -> DataFrame:
    return low_in_active(t).orderBy(down("Units_Needed"), "ProductID").select(
        "ProductID", "Product", "Category", F.col("Quantity").alias("Current_Stock"), "Restock_Level", "Units_Needed"
    )


def restock_alert_supplier(t: Tables) -> DataFrame:
    return (
        low_in_active(t).join(_suppliers(t), "SupplierID").orderBy(down("Units_Needed"), "ProductID")
        .select(
            "Product", "Category", F.col("Quantity").alias("Current_Stock"), "Restock_Level", "Units_Needed",
            "Supplier", F.col("Contact").alias("Supplier_Contact"),
        )
    )


def stock_listing(t: Tables) -> DataFrame:
    return (
        _products(t).join(_stock(t), "ProductID").orderBy(up("Product"), "ProductID")
        .select("Product", "Quantity", "Restock_Level")
    )


def product_catalog(t: Tables) -> DataFrame:
    return (
        _stocked(t).join(_suppliers(t), "SupplierID").orderBy(up("Category"), up("Product"), "ProductID")
        .select(
            "ProductID", "CategoryID", "Product", "Category", "Cat_Active", "Supplier", "Unit_Price",
            F.col("Quantity").alias("Stock_Qty"), "Restock_Level",
        )
    )


def user_items(t: Tables, user_id: int, kind: str | None = None) -> DataFrame:
    """One user's items with their headers and product names."""
    mine = _headers(t, kind).filter(F.col("UserID") == user_id)
    return _items(t).join(mine, "TransactionID").join(
        _products(t).select("ProductID", F.col("Product").alias("Product_Name")), "ProductID"
    )


def user_history(t: Tables, user_id: int) -> DataFrame:
    return user_items(t, user_id).orderBy(down("Trans_Date"), "TransactionID", "ItemID").select(
        "TransactionID", "Trans_Type", "Product_Name", "Quantity", "Subtotal", "Trans_Date"
    )


def active_suppliers(t: Tables) -> DataFrame:
    return t["suppliers"].filter("Is_Active = 1").select("SupplierID", "Name")


def categories(t: Tables, active: bool | None = None) -> DataFrame:
    rows = t["category"].select("CategoryID", "Name", "IS_ACTIVE")
    if active is not None:
        rows = rows.filter(F.col("IS_ACTIVE") == int(active))
    return rows.orderBy(up("Name"))


def user_directory(t: Tables) -> DataFrame:
    return t["users"].select("UserID", "Username", "Email", "Role", "Is_Active").orderBy("UserID")


# ---- aggregates ------------------------------------------------------------

def supplier_price_range(t: Tables) -> DataFrame:
    per_id = t["products"].groupBy("SupplierID").agg(
        row_count().alias("n"), F.min("Unit_Price").alias("low"), F.max("Unit_Price").alias("high"),
        F.sum("Unit_Price").alias("amount"),
    )
    return (
        per_id.join(_suppliers(t), "SupplierID").groupBy("Supplier", "Contact")
        .agg(
            F.sum("n").alias("Total_Products"), F.min("low").alias("Min_Price"), F.max("high").alias("Max_Price"),
            ratio(F.sum("amount"), F.sum("n")).alias("Avg_Price"),
        )
        .orderBy(down("Total_Products"), "Supplier", "Contact")
    )


def _sales(t: Tables) -> DataFrame:
    """Items of SALE headers."""
    return _items(t).join(_headers(t, "SALE").select("TransactionID"), "TransactionID")


def _sales_per_product(t: Tables) -> DataFrame:
    """SALE items reduced to one row per product: a hot product meets no join."""
    return _sales(t).groupBy("ProductID").agg(
        F.count("ItemID").alias("times"), F.sum("Quantity").alias("units"), F.sum("Subtotal").alias("revenue"),
        F.count("Subtotal").alias("priced"),
    )


def _product_category(t: Tables) -> DataFrame:
    names = t["category"].select("CategoryID", F.col("Name").alias("Category"))
    return _products(t).select("ProductID", "Product", "CategoryID").join(names, "CategoryID")


def category_revenue(t: Tables) -> DataFrame:
    # one row per category and transaction: the distinct count becomes a plain one
    visits = _sales(t).join(_product_category(t), "ProductID").groupBy("Category", "TransactionID").agg(
        F.sum("Subtotal").alias("amount")
    )
    return (
        visits.groupBy("Category")
        .agg(row_count().alias("Total_Transactions"), total("amount").alias("Total_Revenue"))
        .orderBy(down("Total_Revenue"), "Category")
    )


def category_revenue_over(t: Tables, minimum: float = 500) -> DataFrame:
    return (
        _sales_per_product(t).join(_product_category(t), "ProductID").groupBy("Category")
        .agg(total("revenue").alias("Total_Revenue")).filter(F.col("Total_Revenue") > minimum)
        .orderBy(down("Total_Revenue"), "Category")
    )


def category_stock(t: Tables) -> DataFrame:
    return (
        _stocked(t).groupBy("Category", F.col("Cat_Active").alias("IS_ACTIVE"))
        .agg(
            F.count("ProductID").alias("Product_Count"), F.sum("Quantity").alias("Total_Stock"),
            F.min("Quantity").alias("Min_Stock"), F.max("Quantity").alias("Max_Stock"),
            average("Quantity").alias("Avg_Stock"),
        )
        .orderBy(down("IS_ACTIVE"), down("Total_Stock"), "Category")
    )


def _per_user(t: Tables) -> DataFrame:
    """Headers reduced to one row per user; a user with a third of them is counted map-side."""
    def of(kind: str):
        return F.count_if(F.col("Trans_Type") == kind)

    return t["transactions"].groupBy("UserID").agg(
        F.count("TransactionID").alias("n"), of("SALE").alias("s"), of("RETURN").alias("r"),
        of("RESTOCK").alias("k"), F.sum("Total_Amount").alias("amount"),
    )


def _with_people(t: Tables, how: str) -> DataFrame:
    people = t["users"].select("UserID", "Username", "Role")
    return people.join(_per_user(t), "UserID", how)


def user_volume(t: Tables) -> DataFrame:
    return (
        _with_people(t, "left").groupBy("Username", "Role")
        .agg(
            nvl(F.sum("n"), 0).alias("Total_Transactions"),
            nvl(total("amount"), 0).cast(TOTAL).alias("Total_Amount_Handled"),
        )
        .orderBy(down("Total_Transactions"), down("Total_Amount_Handled"), "Username", "Role")
    )


def monthly_summary(t: Tables) -> DataFrame:
    return (
        t["transactions"].groupBy(month_text("Trans_Date").alias("Month"), "Trans_Type")
        .agg(row_count().alias("Transaction_Count"), total("Total_Amount").alias("Total_Amount"))
        .orderBy("Month", "Trans_Type")
    )


def sales_performance(t: Tables) -> DataFrame:
    return (
        _sales_per_product(t).join(_product_category(t), "ProductID").groupBy("Product", "Category")
        .agg(
            F.sum("times").alias("Times_Sold"), F.sum("units").alias("Total_Units_Sold"),
            total("revenue").alias("Total_Revenue"),
            ratio(F.sum("revenue"), F.sum("priced")).alias("Avg_Sale_Value"),
        )
        .orderBy(down("Total_Revenue"), "Product", "Category")
    )


# The two policy texts.
SELL_AND_RESTOCK = "Sell + Restock Allowed"
SELL_ONLY = "Sell Only — Restock BLOCKED"


def category_health(t: Tables) -> DataFrame:
    per_category = (
        t["products"].select("ProductID", "CategoryID").join(_stock(t), "ProductID", "left")
        .groupBy("CategoryID").agg(F.count("ProductID").alias("n"), F.sum("Quantity").alias("stock"))
    )
    return (
        t["category"].select("CategoryID", F.col("Name").alias("Category"), "IS_ACTIVE")
        .join(per_category, "CategoryID", "left").groupBy("Category", "IS_ACTIVE")
        .agg(nvl(F.sum("n"), 0).alias("Products"), F.sum("stock").alias("Total_Stock"))
        .withColumn("Policy", F.when(F.col("IS_ACTIVE") == 1, SELL_AND_RESTOCK).otherwise(SELL_ONLY))
        .orderBy(down("IS_ACTIVE"), up("Category"))
    )


def user_activity(t: Tables) -> DataFrame:
    return (
        _with_people(t, "left").groupBy("Username", "Role")
        .agg(
            nvl(F.sum("n"), 0).alias("Total_Transactions"), nvl(F.sum("s"), 0).alias("Sales"),
            nvl(F.sum("r"), 0).alias("Returns"), nvl(F.sum("k"), 0).alias("Restocks"),
            nvl(total("amount"), 0).cast(TOTAL).alias("Total_Value_Handled"),
        )
        .orderBy(down("Total_Transactions"), "Username", "Role")
    )


def health_metrics(t: Tables) -> DataFrame:
    """(Metric, Value) rows: one aggregate pass per table, turned into rows by ``stack``."""
    def rows(df: DataFrame, **metrics) -> DataFrame:
        # Value texts; amounts over no rows stay NULL
        one = df.agg(*[column.alias(name) for name, column in metrics.items()])
        pairs = ", ".join(f"'{LABELS[name]}', {name}" for name in metrics)
        return one.selectExpr(f"stack({len(metrics)}, {pairs}) AS (Metric, Value)")

    everything, active = row_count().cast("string"), F.count_if(F.col("IS_ACTIVE") == 1).cast("string")

    def amount(kind: str):
        return number_text(F.sum(F.when(F.col("Trans_Type") == kind, F.col("Total_Amount"))))

    alerts = F.count_if(F.col("Report_Type") == "STOCK_ALERT").cast("string")
    parts = [
        rows(t["users"], users=everything, active_users=active),
        rows(
            t["category"], categories=everything, active_categories=active,
            inactive_categories=F.count_if(F.col("IS_ACTIVE") == 0).cast("string"),
        ),
        rows(t["suppliers"], suppliers=everything),
        rows(t["products"], products=everything),
        rows(low_in_active(t), restock=everything),
        rows(t["transactions"], transactions=everything, sales=amount("SALE"), returns=amount("RETURN")),
        rows(t["audit_log"], audit=everything),
        rows(t["reports"], alerts=alerts),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# The metric names of the dashboard.
LABELS = {
    "users": "Total Users",
    "active_users": "Active Users",
    "categories": "Total Categories",
    "active_categories": "Active Categories",
    "inactive_categories": "Inactive Categories (Soft Deleted)",
    "suppliers": "Total Suppliers",
    "products": "Total Products",
    "restock": "Products Needing Restock (Active Cat)",
    "transactions": "Total Transactions",
    "sales": "Total Sales Revenue (Rs.)",
    "returns": "Total Returns (Rs.)",
    "audit": "Total Audit Log Entries",
    "alerts": "Total Stock Alerts Logged",
}


# ---- subqueries, semi and anti joins ---------------------------------------

def below_avg_stock(t: Tables) -> DataFrame:
    """Stock under the overall mean, compared as quantity × count < sum: no rounding, one scalar subquery."""
    mean = t["stock_management"].agg(
        F.struct(F.sum("Quantity").alias("s"), F.count("Quantity").alias("n"))
    ).scalar()
    wide = F.col("Quantity").cast("decimal(38,0)")
    return (
        _stocked(t).filter(wide * mean["n"] < mean["s"]).orderBy(up("Quantity"), "ProductID")
        .select("Product", "Category", "Quantity", "Restock_Level")
    )


def never_sold(t: Tables) -> DataFrame:
    sold = _sales(t).filter(F.col("ProductID").isNotNull()).select("ProductID").distinct()
    return _stocked(t).join(sold, "ProductID", "left_anti").orderBy("ProductID").select(
        "ProductID", "Product", "Category", F.col("Quantity").alias("Current_Stock")
    )


def top_priced(t: Tables) -> DataFrame:
    best = t["products"].groupBy("CategoryID").agg(F.max("Unit_Price").alias("Unit_Price"))
    names = t["category"].select("CategoryID", F.col("Name").alias("Category"))
    return (
        _products(t).join(best, ["CategoryID", "Unit_Price"]).join(names, "CategoryID")
        .orderBy(down("Unit_Price"), "ProductID").select("ProductID", "Product", "Category", "Unit_Price")
    )


def above_avg_users(t: Tables) -> DataFrame:
    """Users with more headers than the mean over users that have any."""
    per_user = t["transactions"].groupBy("UserID").agg(F.count("TransactionID").alias("n"))
    mean = per_user.agg(F.struct(F.sum("n").alias("s"), F.count("n").alias("users"))).scalar()
    people = t["users"].select("UserID", "Username", "Role")
    return (
        people.join(per_user, "UserID").groupBy("Username", "Role").agg(F.sum("n").alias("Trans_Count"))
        .filter(F.col("Trans_Count").cast("decimal(38,0)") * mean["users"] > mean["s"])
        .orderBy(down("Trans_Count"), "Username", "Role")
    )


def low_stock_exists(t: Tables) -> DataFrame:
    active = t["category"].filter("IS_ACTIVE = 1").select("CategoryID")
    return (
        _products(t).join(_stock(t).filter(low_stock()), "ProductID").join(active, "CategoryID", "left_semi")
        .orderBy(up("Quantity"), "ProductID").select("Product", "Quantity", "Restock_Level")
    )


# ---- set operations --------------------------------------------------------

def _low(t: Tables) -> DataFrame:
    return _products(t).join(_stock(t).filter(low_stock()), "ProductID").select(
        "ProductID", F.col("Product").alias("Name")
    )


def _in_inactive(t: Tables) -> DataFrame:
    return _products(t).join(_categories(t).filter("Cat_Active = 0"), "CategoryID").select(
        "ProductID", F.col("Product").alias("Name")
    )


def flagged_products(t: Tables) -> DataFrame:
    low = _low(t).withColumn("Flag", F.lit("LOW STOCK"))
    inactive = _in_inactive(t).withColumn("Flag", F.lit("INACTIVE CATEGORY"))
    return low.unionByName(inactive).distinct().withColumnRenamed("Name", "Product").orderBy("ProductID", "Flag")


def sales_and_returns(t: Tables) -> DataFrame:
    """Both kinds come from one scan: the two filters exclude each other."""
    both = _headers(t).filter(F.col("Trans_Type").isin("SALE", "RETURN"))
    return (
        _items(t).join(both, "TransactionID").join(_products(t).select("ProductID", "Product"), "ProductID")
        .orderBy(up("Trans_Type"), up("Product"), "TransactionID", "ItemID")
        .select("Trans_Type", "Product", "Quantity", "Subtotal")
    )


def stuck_products(t: Tables) -> DataFrame:
    return _low(t).intersect(_in_inactive(t)).orderBy("ProductID")


def actionable_restock(t: Tables) -> DataFrame:
    return _low(t).subtract(_in_inactive(t)).orderBy("ProductID")


def users_without_sale(t: Tables) -> DataFrame:
    people = t["users"].filter(F.col("Role").isin("STAFF", "MANAGER", "ADMIN")).select("UserID", "Username", "Role")
    sellers = _headers(t, "SALE").select("UserID").distinct()
    sold = t["users"].join(sellers, "UserID", "left_semi").select("UserID", "Username", "Role")
    return people.subtract(sold).orderBy("UserID")


# ---- ordering and top-n ----------------------------------------------------

def latest_audit(t: Tables, table: str) -> DataFrame:
    return (
        t["audit_log"].filter(F.col("Table_Name") == table).orderBy(down("LogID")).limit(1)
        .select("LogID", "Operation", "Old_Value", "New_Value", "Description")
    )


def audit_review(t: Tables) -> DataFrame:
    return t["audit_log"].orderBy("LogID").select(
        "LogID", "Table_Name", "Operation", "Record_ID", "Changed_By", "Old_Value", "New_Value",
        short_time("Change_Date").alias("Changed_At"),
    )


def audit_tail(t: Tables, n: int = 20) -> DataFrame:
    return t["audit_log"].orderBy(down("LogID")).limit(n).select(
        "LogID", "Table_Name", "Operation", "Record_ID", "Changed_By", "Old_Value", "New_Value",
        dated_time("Change_Date").alias("Changed_At"),
    )


def audit_feed(t: Tables, n: int = 50) -> DataFrame:
    return t["audit_log"].orderBy(down("LogID")).limit(n).select(
        "LogID", "Table_Name", "Operation", "Changed_By", "Old_Value", "New_Value",
        iso_time("Change_Date").alias("Change_Date"), "Description",
    )


def report_listing(t: Tables) -> DataFrame:
    return t["reports"].orderBy("ReportID").select("ReportID", "Report_Type", "Generated_At", "Report_Data")
