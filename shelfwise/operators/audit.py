"""Audit rows from two snapshots of a table, and the screening of item rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.functions.dialect import number_text, nvl, text


def _sides(old: DataFrame, new: DataFrame, key: str, how: str) -> DataFrame:
    """Rows of both snapshots side by side as structs ``o`` and ``n``."""
    before = old.select(F.col(key).alias("_k"), F.struct(*old.columns).alias("o"))
    after = new.select(F.col(key).alias("_k"), F.struct(*new.columns).alias("n"))
    return before.join(after, "_k", how)


def _differs(columns: list[str]) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    return ~same


def _flag(side: str, column: str) -> Column:
    return F.col(f"{side}.{column}")


def audit_product_images(images: DataFrame, *keep: str) -> DataFrame:
    """One audit row per pair of product images ``o`` and ``n``. The texts.

    A changed category shows as an UPDATE whose texts are equal, because the
    texts leave the category out. ``keep`` names columns to carry along.
    """
    added, gone = F.col("o").isNull(), F.col("n").isNull()

    def values(side: str, *tail) -> Column:
        return text("Name=", _flag(side, "Name"), " Price=", number_text(f"{side}.Unit_Price"), *tail)

    def active(side: str) -> tuple:
        return (" Active=", _flag(side, "Is_Active"))

    return images.select(
        *keep,
        F.lit("PRODUCTS").alias("Table_Name"),
        F.when(added, "INSERT").when(gone, "DELETE").otherwise("UPDATE").alias("Operation"),
        F.coalesce("n.ProductID", "o.ProductID").alias("Record_ID"),
        F.when(added, None).when(gone, values("o")).otherwise(values("o", *active("o"))).alias("Old_Value"),
        F.when(added, values("n", " CatID=", _flag("n", "CategoryID"), *active("n")))
        .when(gone, None).otherwise(values("n", *active("n"))).alias("New_Value"),
        F.lit("Auto-logged by TRG_AUDIT_PRODUCTS").alias("Description"),
    )


def _digest(columns: list[str]) -> Column:
    """128 bits that tell two rows apart: two hashes with different beginnings, over the values and which are NULL."""
    parts = [part for c in columns for part in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.xxhash64(F.lit("a"), *parts).alias("a"), F.xxhash64(F.lit("b"), *parts).alias("b"))


def changed_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``(_k)``: keys whose rows differ between two snapshots, or that only one of them has.

    Only keys and digests of rows are joined.
    """
    watched = [c for c in old.columns if c != key]
    before = old.select(F.col(key).alias("_k"), _digest(watched).alias("_was"))
    after = new.select(F.col(key).alias("_k"), _digest(watched).alias("_is"))
    return before.join(after, "_k", "full_outer").filter(~F.col("_was").eqNullSafe(F.col("_is"))).select("_k")


def audit_products(old: DataFrame, new: DataFrame) -> DataFrame:
    """INSERT, UPDATE and DELETE rows between two product snapshots.

    Rows are compared by digest; only the images of changed keys are brought together.
    """
    kinds = {f.name: f.dataType for f in old.schema}
    new = new.select(*[F.col(f.name).cast(kinds[f.name]).alias(f.name) if f.dataType != kinds[f.name] else f.name for f in new.schema])
    images = changed_keys(old, new, "ProductID")
    for side, df in (("o", old), ("n", new)):
        images = images.join(df.select(F.col("ProductID").alias("_k"), F.struct(*df.columns).alias(side)), "_k", "left")
    return audit_product_images(images)


def audit_category(old: DataFrame, new: DataFrame) -> DataFrame:
    """UPDATE rows between two category snapshots. The texts."""
    was, now, name = _flag("o", "IS_ACTIVE"), _flag("n", "IS_ACTIVE"), _flag("n", "Name")

    def values(side: str) -> Column:
        return text("Name=", _flag(side, "Name"), " IS_ACTIVE=", _flag(side, "IS_ACTIVE"))

    about = (
        F.when(
            (was == 1) & (now == 0),
            text('SOFT DELETE: Category "', name, '" deactivated. Products can sell, NOT restock.'),
        )
        .when(
            (was == 0) & (now == 1), text('REACTIVATED: Category "', name, '" is now active. Restocking allowed.')
        )
        .otherwise(text('UPDATE on Category "', name, '"'))
    )
    watched = [c for c in old.columns if c != "CategoryID"]
    return _sides(old, new, "CategoryID", "inner").filter(_differs(watched)).select(
        F.lit("CATEGORY").alias("Table_Name"), F.lit("UPDATE").alias("Operation"), F.col("_k").alias("Record_ID"),
        values("o").alias("Old_Value"), values("n").alias("New_Value"), about.alias("Description"),
    )


def audit_stock_images(images: DataFrame, products: DataFrame, *keep: str) -> DataFrame:
    """One audit row per pair of stock images with the signed change. The texts.

    Only products that exist are logged, as the name is looked up.
    """
    was, now = _flag("o", "Quantity"), _flag("n", "Quantity")
    delta = F.when(now > was, text("+", now - was)).otherwise(text("-", was - now))
    names = products.select(F.col("ProductID").alias("_product"), F.col("Name").alias("product_name"))
    return images.join(names, F.col("n.ProductID") == F.col("_product")).select(
        *keep,
        F.lit("STOCK_MANAGEMENT").alias("Table_Name"), F.lit("UPDATE").alias("Operation"),
        F.col("_product").alias("Record_ID"), text("Qty=", was).alias("Old_Value"),
        text("Qty=", now).alias("New_Value"),
        text('Stock change for "', F.col("product_name"), '" | Delta: ', delta).alias("Description"),
    )


def audit_stock(old: DataFrame, new: DataFrame, products: DataFrame) -> DataFrame:
    """UPDATE rows for every product whose quantity differs between two stock snapshots."""
    return audit_stock_images(_sides(old, new, "ProductID", "inner").filter(_differs(["Quantity"])), products)


@dataclass(frozen=True)
class Screened:
    allowed: DataFrame
    blocked: DataFrame


def block_restock(
    items: DataFrame, transactions: DataFrame, products: DataFrame, category: DataFrame
) -> Screened:
    """Split item rows: RESTOCK items of inactive categories and items without their parents are blocked."""
    headers = transactions.select(F.col("TransactionID").alias("_header"), "Trans_Type")
    parents = products.select("ProductID", F.col("Name").alias("product_name"), "CategoryID").join(
        category.select("CategoryID", F.col("Name").alias("category_name"), F.col("IS_ACTIVE").alias("_flag")),
        "CategoryID",
    ).select(F.col("ProductID").alias("_product"), "product_name", "category_name", "_flag")
    of = F.col("TransactionID") == F.col("_header")
    restock = F.col("Trans_Type") == "RESTOCK"
    # products are only looked up for the items of restocks
    orphans = items.join(headers, of, "left_anti")
    others = items.join(headers.filter(nvl(~restock, True)), of, "left_semi")
    restocked = items.join(headers.filter(restock), of).join(parents, F.col("ProductID") == F.col("_product"), "left")
    code = F.when(F.col("_product").isNull(), "-20051").when(F.col("_flag") == 0, "-20050")
    # The error texts
    missing = F.lit("TRG_BLOCK_RESTOCK: Product or Transaction not found.")
    message = F.when(
        F.col("code") == "-20050",
        text(
            'TRIGGER BLOCKED: Cannot restock "', F.col("product_name"), '". Category "', F.col("category_name"),
            '" is inactive (IS_ACTIVE=0). This is enforced at database trigger level.',
        ),
    ).otherwise(missing)
    judged = restocked.withColumn("code", code)
    blocked = judged.filter(F.col("code").isNotNull()).withColumn("message", message).select(*items.columns, "code", "message")
    lost = orphans.withColumns({"code": F.lit("-20051"), "message": missing})
    return Screened(
        others.unionByName(judged.filter(F.col("code").isNull()).select(*items.columns)), lost.unionByName(blocked)
    )
