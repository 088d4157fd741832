"""Printed reports as text columns, their totals as one-row aggregates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from shelfwise.functions.dialect import number_text, nvl, pad, text
from shelfwise.model import TOTAL
from shelfwise.operators.lookups import status_label
from shelfwise.operators.reports import (
    _headers, _items, _products, _stocked, down, low_in_active, up, user_items,
)
from shelfwise.sources.tables import Tables, assign_keys, next_key

# Column widths of the printed reports.
PRODUCT, CATEGORY, STOCK, LEVEL = 25, 15, 8, 13


def restock_alert_lines(t: Tables) -> DataFrame:
    return low_in_active(t).orderBy(down("Units_Needed"), "ProductID").select(
        "ProductID",
        text(
            pad("Product", PRODUCT), pad("Category", CATEGORY), pad("Quantity", STOCK), pad("Restock_Level", LEVEL),
            F.col("Units_Needed"),
        ).alias("Line"),
    )


def restock_alert_count(t: Tables) -> DataFrame:
    return low_in_active(t).agg(F.count(F.lit(1)).alias("Total_Needing_Restock"))


def stock_report_lines(t: Tables) -> DataFrame:
    mark = F.when(F.col("Cat_Active") == 0, " [CATEGORY INACTIVE]")
    return _stocked(t).orderBy(up("Category"), up("Product"), "ProductID").select(
        "ProductID",
        text(
            pad("Product", PRODUCT), pad("Category", CATEGORY), "  Qty: ", pad("Quantity", 5), "  Status: ",
            status_label(), mark,
        ).alias("Line"),
    )


def _typed_items(t: Tables, kind: str) -> DataFrame:
    people = t["users"].select("UserID", "Username")
    names = _products(t).select("ProductID", F.col("Product").alias("Product_Name"))
    return _items(t).join(_headers(t, kind), "TransactionID").join(people, "UserID").join(names, "ProductID")


def transactions_by_type(t: Tables, kind: str) -> DataFrame:
    return _typed_items(t, kind).orderBy(down("Trans_Date"), "TransactionID", "ItemID").select(
        "TransactionID", "Username", "Product_Name", "Quantity", F.col("Item_Price").alias("Unit_Price"), "Subtotal",
        "Trans_Date",
        text(
            "TxnID: ", pad("TransactionID", 5), "User: ", pad("Username", 15), "Product: ", pad("Product_Name", 22),
            "Qty: ", pad("Quantity", 5), "Subtotal: Rs.", number_text("Subtotal"),
        ).alias("Line"),
    )


def type_total(t: Tables, kind: str) -> DataFrame:
    """The total of one type's items, 0 where there is none.

    Users and products only filter here, so they are met by items already
    summed per user and product.
    """
    sums = _items(t).join(_headers(t, kind).select("TransactionID", "UserID"), "TransactionID").groupBy(
        "UserID", "ProductID"
    ).agg(F.sum("Subtotal").alias("amount"))
    kept = sums.join(t["users"].select("UserID"), "UserID", "left_semi").join(
        t["products"].select("ProductID"), "ProductID", "left_semi"
    )
    return kept.agg(nvl(F.sum("amount"), 0).cast(TOTAL).alias("Total_Revenue"))


def stock_alert_reports(t: Tables, user_id: int, ts: dt.datetime) -> DataFrame:
    """Report rows, one per low-stock product of an active category, keyed after the stored reports."""
    rows = low_in_active(t).select(
        "ProductID",
        F.lit("STOCK_ALERT").alias("Report_Type"),
        F.lit(user_id).cast("long").alias("Generated_By"),
        F.lit(ts).cast("timestamp_ntz").alias("Generated_At"),
        text(
            "Product: ", F.col("Product"), " | Category: ", F.col("Category"), " | Stock: ", F.col("Quantity"),
            " | Needed: ", F.col("Units_Needed"),
        ).alias("Report_Data"),
    )
    keyed = assign_keys(rows, "ReportID", next_key(t["reports"], "ReportID"), ["ProductID"])
    return keyed.select("ReportID", "Report_Type", "Generated_By", "Generated_At", "Report_Data")


def view_transactions(t: Tables, user_id: int, kind: str | None = None) -> DataFrame:
    return user_items(t, user_id, kind).orderBy(down("Trans_Date"), "TransactionID", "ItemID").select(
        "TransactionID", "Trans_Type", "Product_Name", "Quantity", "Subtotal", "Trans_Date",
        text(
            "TxnID:", pad("TransactionID", 5), " Type:", pad("Trans_Type", 9), " Product:", pad("Product_Name", 23),
            " Qty:", pad("Quantity", 5), " Amount: Rs.", number_text(nvl("Subtotal", 0)),
        ).alias("Line"),
    )


def view_transactions_total(t: Tables, users: DataFrame, kind: str | None = None) -> DataFrame:
    """Item count and value for each requested ``user_id``; an unknown user gives an error row.

    Items and sales, returns and restocks are counted alike.
    """
    # per user and product first, then only items whose product exists
    sums = _items(t).join(_headers(t, kind).select("TransactionID", "UserID"), "TransactionID").groupBy(
        "UserID", "ProductID"
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("Subtotal").alias("amount"))
    per_user = (
        sums.join(t["products"].select("ProductID"), "ProductID", "left_semi").groupBy("UserID")
        .agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"))
    )
    known = t["users"].select(F.col("UserID").alias("_known"), "Username")
    asked = users.select("user_id").distinct()
    joined = asked.join(known, F.col("user_id") == F.col("_known"), "left").join(
        per_user, F.col("user_id") == F.col("UserID"), "left"
    )
    found = F.col("_known").isNotNull()
    return joined.select(
        "user_id", "Username",
        F.when(found, nvl("n", 0)).alias("item_count"),
        F.when(found, nvl("amount", 0)).cast(TOTAL).alias("total_value"),
        F.when(~found, text("ERROR: User ID ", F.col("user_id"), " not found.")).alias("error"),
    )
