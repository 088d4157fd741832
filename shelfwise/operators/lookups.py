"""The stored functions as joins over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfwise.functions.dialect import text
from shelfwise.operators.reports import _sales_per_product
from shelfwise.model import TOTAL
from shelfwise.sources.tables import Tables


def price_quotes(requests: DataFrame, products: DataFrame) -> DataFrame:
    """Total price per (request_id, product_id, quantity); an unknown or inactive product gives an error row."""
    active = products.filter("Is_Active = 1").select("ProductID", "Unit_Price")
    found = F.col("ProductID").isNotNull()
    return requests.join(active, requests["product_id"] == active["ProductID"], "left").select(
        "request_id", "product_id", "quantity",
        F.round(F.col("Unit_Price") * F.col("quantity"), 2).cast("decimal(18,2)").alias("total_price"),
        F.when(~found, -20010).alias("error_code"),
        F.when(~found, text("ERROR: Product ID ", F.col("product_id"), " not found or inactive.")).alias("error"),
    )


def status_label(quantity: str = "Quantity", level: str = "Restock_Level"):
    return (
        F.when(F.col(quantity).isNull(), "NOT FOUND").when(F.col(quantity) == 0, "OUT OF STOCK")
        .when(F.col(quantity) < F.col(level), "LOW STOCK").otherwise("OK")
    )


def stock_status(products: DataFrame, stock: DataFrame) -> DataFrame:
    """(ProductID, Product, Quantity, Restock_Level, Status); products without a stock row are NOT FOUND."""
    levels = stock.select("ProductID", "Quantity", "Restock_Level")
    return products.select("ProductID", F.col("Name").alias("Product")).join(levels, "ProductID", "left").withColumn(
        "Status", status_label()
    )


def category_flag(ids: DataFrame, category: DataFrame, column: str = "CategoryID") -> DataFrame:
    """Each id with its category's flag, -1 for an unknown id."""
    flags = category.select(F.col("CategoryID").alias("_id"), F.col("IS_ACTIVE").alias("_flag"))
    return (
        ids.join(flags, F.col(column) == F.col("_id"), "left")
        .withColumn("Function_Result", F.coalesce("_flag", F.lit(-1))).drop("_id", "_flag")
    )


def product_sales(t: Tables) -> DataFrame:
    """SALE revenue of every product, 0 where there is none."""
    revenue = _sales_per_product(t).select("ProductID", "revenue")
    return t["products"].select("ProductID", F.col("Name").alias("Product")).join(revenue, "ProductID", "left").select(
        "ProductID", "Product", F.coalesce("revenue", F.lit(0)).cast(TOTAL).alias("Total_Sales_Revenue")
    )
