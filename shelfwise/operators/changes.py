"""Batches of administrative changes: category status, new rows, column updates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.functions.dialect import number_text, nvl, text
from shelfwise.functions.scan import as_of
from shelfwise.model import RULES, SCHEMAS
from shelfwise.operators.quality import constraint_code
from shelfwise.session import cut_lineage
from shelfwise.sources.tables import Tables, apply_defaults, assign_keys, next_key

CHANGE_ORDER = ("event_ts", "change_id")
PLAIN = 2  # rounds of first rows before chains of clashes are looked for


def long_ago() -> Column:
    """The position of state that was there before any change."""
    return F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")


class Applied:
    """New table state, what became of each input row, and the audit rows (without LogID).

    The history behind outcomes and audit is only computed when one of them is asked for.
    """

    def __init__(self, changes: DataFrame, category: DataFrame, products: DataFrame, blocks: int | None):
        self._changes, self._category, self._products, self._blocks = changes, category, products, blocks

    @cached_property
    def outcomes(self) -> DataFrame:
        return category_history(self._changes, self._category, self._blocks)

    @cached_property
    def table(self) -> DataFrame:
        category = self._category
        final = self._changes.groupBy(F.col("CategoryID").alias("_changed")).agg(
            F.max_by("IS_ACTIVE", F.struct(*CHANGE_ORDER)).alias("_flag")
        )
        return category.join(final, F.col("CategoryID") == F.col("_changed"), "left").select(
            *[nvl("_flag", F.col("IS_ACTIVE")).alias("IS_ACTIVE") if c == "IS_ACTIVE" else c for c in category.columns]
        )

    @cached_property
    def audit(self) -> DataFrame:
        deleted = self.outcomes.filter("status = 'applied' AND IS_ACTIVE = 0").join(
            affected_products(self._changes, self._products), "CategoryID", "left"
        )
        return soft_delete_audit(deleted)


@dataclass(frozen=True)
class Added:
    """Accepted rows with their keys, rejected rows with code and message, audit rows."""

    rows: DataFrame
    rejected: DataFrame
    audit: DataFrame | None = None
    stock: DataFrame | None = None


def _audit(
    df: DataFrame, table: str, operation: str, record: str, old: Column, new: Column, about: Column
) -> DataFrame:
    return df.select(
        F.lit(table).alias("Table_Name"), F.lit(operation).alias("Operation"), F.col(record).alias("Record_ID"),
        nvl("actor", "system").alias("Changed_By"), F.col("event_ts").alias("Change_Date"),
        old.cast("string").alias("Old_Value"), new.cast("string").alias("New_Value"), about.alias("Description"),
    )


def with_log_ids(audit: DataFrame, audit_log: DataFrame) -> DataFrame:
    """Key audit rows after the stored log, in time order."""
    order = ["Change_Date", "Table_Name", "Record_ID", "Operation", "New_Value"]
    keyed = assign_keys(audit, "LogID", next_key(audit_log, "LogID"), order)
    return keyed.select(*[f.name for f in SCHEMAS["audit_log"]])


def affected_products(changes: DataFrame, products: DataFrame) -> DataFrame:
    """(CategoryID, affected): active products of each category that a change deactivates."""
    off = changes.filter("IS_ACTIVE = 0").select("CategoryID").distinct()
    active = products.filter("Is_Active = 1").groupBy("CategoryID").agg(F.count(F.lit(1)).alias("n"))
    return off.join(active, "CategoryID", "left").select("CategoryID", nvl("n", 0).alias("affected"))


def category_history(changes: DataFrame, category: DataFrame, blocks: int | None = None) -> DataFrame:
    """Each change with the flag before it, its ``status`` and, for an unknown category, a code."""
    initial = category.select(
        "CategoryID", long_ago().alias("event_ts"), F.lit(-1).cast("long").alias("change_id"),
        F.col("IS_ACTIVE").alias("flag_before"),
    )
    later = changes.select("CategoryID", *CHANGE_ORDER, F.col("IS_ACTIVE").alias("flag_before"))
    known = category.select(F.col("CategoryID").alias("_known"), F.col("Name").alias("category_name"))
    before = as_of(
        changes, initial.unionByName(later), "CategoryID", CHANGE_ORDER, ["flag_before"], strict=True, blocks=blocks
    ).join(known, F.col("CategoryID") == F.col("_known"), "left")
    missing = F.col("_known").isNull()
    same = (F.col("IS_ACTIVE") == 0) & (F.col("flag_before") == 0)
    return (
        before.withColumn("status", F.when(missing, "rejected").when(same, "no-op").otherwise("applied"))
        .withColumn("code", F.when(missing, "-20026"))
        .withColumn(  # fixed value: the text
            "message", F.when(missing, text("ERROR: Category ID ", F.col("CategoryID"), " does not exist."))
        )
        .drop("_known")
    )


def apply_category_status(
    changes: DataFrame, category: DataFrame, products: DataFrame, blocks: int | None = None
) -> Applied:
    """Soft deletes (flag 0) and reactivations (flag 1), in time order.

    ``changes`` holds (change_id, event_ts, CategoryID, IS_ACTIVE, actor). A
    soft delete of an inactive category does nothing and leaves no audit row.
    """
    return Applied(changes, category, products, blocks)


def soft_delete_audit(deleted: DataFrame) -> DataFrame:
    """Audit rows of soft deletes ``(CategoryID, category_name, affected, …)``. The texts."""
    return _audit(
        deleted, "CATEGORY", "UPDATE", "CategoryID", F.lit("IS_ACTIVE=1"), F.lit("IS_ACTIVE=0"),
        text(
            'Soft delete via PKG_ADMIN_OPS: "', F.col("category_name"), '" | ', nvl("affected", 0),
            " product(s) affected",
        ),
    )


def product_audit(rows: DataFrame) -> DataFrame:
    """Audit rows of added products ``(ProductID, Name, Unit_Price, …)``. The texts."""
    return _audit(
        rows, "PRODUCTS", "INSERT", "ProductID", F.lit(None),
        text("Name=", F.col("Name"), " Price=", number_text("Unit_Price")),
        F.lit("New product added via PKG_ADMIN_OPS.Add_Product"),
    )


def supplier_audit(rows: DataFrame) -> DataFrame:
    """Audit rows of added suppliers ``(SupplierID, Name, …)``. The texts."""
    return _audit(
        rows, "SUPPLIERS", "INSERT", "SupplierID", F.lit(None), text("Name=", F.col("Name")),
        F.lit("New supplier added via PKG_ADMIN_OPS.Add_Supplier"),
    )


def product_code(rows: DataFrame) -> Column:
    """The constraint that a new product breaks: those of its own row, then those of its first stock row."""
    price = F.when(F.col("Unit_Price").isNull(), "CHK_PRICE")
    stock = constraint_code(rows.select("Quantity", "Restock_Level"), "stock_management", nulls=False)
    return F.coalesce(price, constraint_code(rows.select("Name", "Unit_Price"), "products"), stock)


def add_products(rows: DataFrame, t: Tables) -> Added:
    """New products with their first stock row.

    ``rows``: (row_id, event_ts, Name, CategoryID, SupplierID, Unit_Price,
    Quantity, Restock_Level, actor); row_id gives the order of the keys.
    """
    cats = t["category"].select(
        F.col("CategoryID").alias("_cat"), F.col("Name").alias("category_name"), F.col("IS_ACTIVE").alias("_flag")
    )
    active = t["suppliers"].filter("Is_Active = 1").select(F.col("SupplierID").alias("_sup"))
    facts = rows.join(cats, F.col("CategoryID") == F.col("_cat"), "left").join(
        active, F.col("SupplierID") == F.col("_sup"), "left"
    )
    code = (
        F.when(F.col("_cat").isNull(), "-20020").when(F.col("_flag") == 0, "-20021")
        .when(F.col("_sup").isNull(), "-20022")
        .otherwise(product_code(facts))
    )
    # The error texts
    message = (
        F.when(F.col("code") == "-20020", text("ERROR: Category ID ", F.col("CategoryID"), " does not exist."))
        .when(
            F.col("code") == "-20021",
            text(
                'ERROR: Cannot add product to inactive category "', F.col("category_name"),
                '". Activate the category first.',
            ),
        )
        .when(F.col("code") == "-20022", text("ERROR: Supplier ID ", F.col("SupplierID"), " not found or inactive."))
        .otherwise("table constraint violated")
    )
    judged = facts.withColumn("code", code)
    rejected = judged.filter(F.col("code").isNotNull()).withColumn("message", message).select(*rows.columns, "code", "message")
    good = judged.filter(F.col("code").isNull()).select(*rows.columns)
    keyed = assign_keys(good, "_n", 0, ["row_id"]).withColumn(
        "ProductID", F.col("_n") + next_key(t["products"], "ProductID")
    ).withColumn("StockID", F.col("_n") + next_key(t["stock_management"], "StockID"))
    products = apply_defaults(keyed.withColumn("Created_At", F.col("event_ts")), "products")
    stock = apply_defaults(keyed.withColumn("Last_Updated", F.col("event_ts")), "stock_management")
    return Added(products, rejected, product_audit(keyed), stock)


def first_holders(
    rows: DataFrame, existing: DataFrame, unique: Sequence[str], order: str, rounds: list[str] | None = None
) -> DataFrame:
    """Rows that sequential inserts under UNIQUE columns would accept.

    A row is refused when an earlier accepted row, or a stored one, holds one of
    its values; NULLs never clash. With one unique column that is the first row
    per new value. With several, a refused row frees its other values, so the
    first rows are taken, what clashes with them is dropped, and the rest repeats.
    Rows that are still open after PLAIN such rounds may hang in chains, each on the
    one before: there a row that a single open row can refuse is accepted exactly
    if that one isn't, so it points at it, and doubling the pointers settles a
    chain of n rows in log2(n) steps. ``rounds`` gets a word for each checkpointed step.
    """
    steps = [] if rounds is None else rounds

    def cut(df: DataFrame, step: str) -> DataFrame:
        steps.append(step)
        return cut_lineage(df)

    open_rows = rows
    for c in unique:
        held = existing.select(F.col(c).alias("_held")).filter(F.col("_held").isNotNull()).distinct()
        open_rows = open_rows.join(held, F.col(c) == F.col("_held"), "left_anti")
    if len(unique) == 1:
        return _first_per_value(open_rows, unique[0], order)
    accepted, turn = None, 0
    open_rows = cut(open_rows, "open")
    while not open_rows.isEmpty():
        turn += 1
        if turn > PLAIN:
            heads = open_rows.join(_chain_heads(open_rows, unique, order, cut), order, "left_semi")
        else:
            heads = open_rows
            for c in unique:
                heads = heads.join(_first_per_value(open_rows, c, order).select(order), order, "left_semi")
        heads = cut(heads, "heads")
        accepted = heads if accepted is None else accepted.unionByName(heads)
        rest = open_rows.join(heads.select(order), order, "left_anti")
        for c in unique:
            held = heads.select(F.col(c).alias("_held")).filter(F.col("_held").isNotNull())
            rest = rest.join(held, F.col(c) == F.col("_held"), "left_anti")
        open_rows = cut(rest, "rest")
    return accepted if accepted is not None else open_rows


def _chain_heads(rows: DataFrame, unique: Sequence[str], order: str, cut) -> DataFrame:
    """The ``order`` of rows that must be accepted: those without an earlier clash, and every second row of a chain.

    Only the two lowest rows of a value are told apart, so a value that many rows
    hold is two aggregates, no window. A row that is neither waits for another round.
    """
    own = rows.select(F.col(order).alias("_row"), *unique)
    blockers = []
    for c in unique:
        named = own.filter(F.col(c).isNotNull()).select(F.col(c).alias("_held"), "_row")
        first = named.groupBy("_held").agg(F.min("_row").alias("_first"))
        later = named.join(first, "_held").filter(F.col("_row") > F.col("_first"))
        second = later.groupBy("_held").agg(F.min("_row").alias("_second"))
        # the lowest row of a value hangs on none, the second on the lowest, others on more than one
        blockers.append(later.join(second, "_held").select("_row", F.col("_first").alias("_on"), (F.col("_row") > F.col("_second")).alias("_many")))
    hung = reduce(DataFrame.unionByName, blockers).groupBy("_row").agg(
        F.min("_on").alias("_on"), (F.max("_many") | (F.min("_on") < F.max("_on"))).alias("_many")
    )
    joined = own.select("_row").join(hung, "_row", "left")
    free, waits = F.col("_on").isNull(), nvl(F.col("_many"), False)
    # _up: the row it hangs on (itself at the end of a chain); _odd: whether an odd number of steps lies between
    links = joined.select(
        "_row", F.when(free | waits, F.col("_row")).otherwise(F.col("_on")).alias("_up"), (~free & ~waits).alias("_odd"), waits.alias("_waits")
    )
    links = cut(links, "links")
    ends = links.filter("_row = _up").select(F.col("_row").alias("_end"), F.col("_waits").alias("_open"))
    while True:
        up = links.select(F.col("_row").alias("_at"), F.col("_up").alias("_next"), F.col("_odd").alias("_more"))
        jumped = links.join(up, F.col("_up") == F.col("_at"))
        moved = F.col("_next") != F.col("_up")
        links = cut(jumped.select("_row", F.col("_next").alias("_up"), (F.col("_odd") != F.col("_more")).alias("_odd"), moved.alias("_moved")), "jump")
        if links.filter("_moved").isEmpty():
            break
    return links.join(ends, F.col("_up") == F.col("_end")).filter("NOT _open AND NOT _odd").select(F.col("_row").alias(order))


def _first_per_value(rows: DataFrame, column: str, order: str) -> DataFrame:
    """The lowest row per value, found map-side first; rows without a value all stay."""
    whole = F.struct(order, *[c for c in rows.columns if c != order])
    firsts = (
        rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min_by(whole, order).alias("_row"))
        .select("_row.*").select(*rows.columns)
    )
    return firsts.unionByName(rows.filter(F.col(column).isNull()))


def add_suppliers(rows: DataFrame, suppliers: DataFrame) -> Added:
    """New suppliers; a name that exists, or came earlier in the batch, is refused (-20023).

    ``rows``: (row_id, event_ts, Name, Contact, Email, Address, actor). The
    stored e-mail is unique too; those clashes get UNIQUE_EMAIL.
    """
    complete = rows.filter(constraint_code(rows, "suppliers").isNull())
    taken = first_holders(complete, suppliers, ("Name", "Email"), "row_id")
    keyed = assign_keys(taken, "SupplierID", next_key(suppliers, "SupplierID"), ["row_id"])
    stored = suppliers.select(F.col("Name").alias("_held"), F.lit(None).cast("long").alias("_by")).distinct()
    names = stored.unionByName(taken.select(F.col("Name").alias("_held"), F.col("row_id").alias("_by")))
    refused = rows.join(taken.select("row_id"), "row_id", "left_anti").join(
        names, F.col("Name") == F.col("_held"), "left"
    )
    earlier = F.col("_held").isNotNull() & nvl(F.col("_by") < F.col("row_id"), True)
    code = (
        F.when(earlier, "-20023")
        .otherwise(F.coalesce(constraint_code(rows, "suppliers"), F.lit("UNIQUE_EMAIL")))
    )
    rejected = refused.withColumn("code", code).withColumn(
        "message",
        F.when(F.col("code") == "-20023", text('ERROR: Supplier "', F.col("Name"), '" already exists.')).otherwise(
            "table constraint violated"
        ),
    ).drop("_held", "_by")
    return Added(apply_defaults(keyed.withColumn("Created_At", F.col("event_ts")), "suppliers"), rejected, supplier_audit(keyed))


def add_dimension_rows(rows: DataFrame, existing: DataFrame, table: str) -> Added:
    """New categories or users, active from the start. No audit rows.

    Rows that break a declared constraint are refused with its code; of the others,
    clashes on unique columns are.
    """
    key, *unique = RULES[table].unique
    flag = next(f.name for f in SCHEMAS[table] if f.name.upper() == "IS_ACTIVE")
    given = {key, flag, "Created_At"}  # set here
    missing = [c for c in RULES[table].required if c not in rows.columns and c not in given]
    own = rows.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else rows
    judged = own.withColumn("code", constraint_code(own.drop(*given), table)).select(*rows.columns, "code")
    sound = judged.filter(F.col("code").isNull()).drop("code")
    taken = first_holders(sound, existing, unique, "row_id")
    keyed = assign_keys(taken, key, next_key(existing, key), ["row_id"]).withColumn(flag, F.lit(1))
    rejected = judged.join(taken.select("row_id"), "row_id", "left_anti").withColumn(
        "code", F.coalesce("code", F.lit("UNIQUE_" + "_OR_".join(c.upper() for c in unique)))
    ).select(*rows.columns, "code")
    return Added(apply_defaults(keyed.withColumn("Created_At", F.col("event_ts")), table), rejected)


def screen_updates(changes: DataFrame, table: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(changes the table's constraints allow, refused ones with ``code``); one bad value refuses the whole change."""
    judged = changes.withColumn("code", constraint_code(changes.select(*columns), table, nulls=False))
    return judged.filter(F.col("code").isNull()).drop("code"), judged.filter(F.col("code").isNotNull())


def apply_updates(
    df: DataFrame, changes: DataFrame, key: str, columns: Sequence[str], order: Sequence[str] = CHANGE_ORDER,
    table: str | None = None,
) -> DataFrame:
    """Set ``columns`` to their last value in ``changes``; a NULL leaves the column as it was.

    With the name of its ``table``, changes that break a declared constraint are
    left out (``screen_updates`` returns them). Changes are reduced to one row per
    key map-side; unknown keys change nothing.
    """
    if table:
        changes = screen_updates(changes, table, columns)[0]
    position = F.struct(*order)
    latest = changes.groupBy(F.col(key).alias("_key")).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"_{c}") for c in columns]
    )
    kinds = {f.name: f.dataType for f in df.schema}
    merged = {c: F.coalesce(F.col(f"_{c}").cast(kinds[c]), F.col(c)).alias(c) for c in columns}
    return df.join(latest, F.col(key) == F.col("_key"), "left").select(*[merged.get(c, F.col(c)) for c in df.columns])
