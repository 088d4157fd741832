"""A whole log of administrative and ledger commands in one time order.

What an administrator changes holds from its position in the log on: a command
sees the category status, the price and the products as of its own position.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, cached_property, reduce

from pyspark.sql import DataFrame, functions as F, types as T

from shelfwise.functions.dialect import nvl
from shelfwise.functions.scan import as_of, as_of_short, running_sum, stored
from shelfwise.model import INT, LONG, PRICE, TEXT, TIME
from shelfwise.operators.audit import audit_product_images
from shelfwise.operators.changes import (
    first_holders, long_ago, product_audit, product_code, soft_delete_audit, supplier_audit, with_log_ids,
)
from shelfwise.operators.ledger import Ledger, attach_facts, decide, judge
from shelfwise.operators.quality import constraint_code
from shelfwise.session import cut_lineage, noting, remove
from shelfwise.sources.tables import Tables, apply_defaults, assign_keys, next_key

# One row per command; a command leaves the columns it does not use NULL. New
# categories, suppliers and products carry the id they are to get.
LOG_SCHEMA = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in {
            "cmd_id": LONG, "event_ts": TIME, "cmd_type": TEXT, "user_id": LONG, "product_id": LONG,
            "category_id": LONG, "supplier_id": LONG, "name": TEXT, "contact": TEXT, "email": TEXT,
            "address": TEXT, "description": TEXT, "unit_price": PRICE, "quantity": LONG, "restock_level": LONG,
            "notes": TEXT, "actor": TEXT,
        }.items()
    ]
)
AT = ("event_ts", "cmd_id")
SHORT = 1 << 17  # category states that are sent to every task (some 4 MB); more are placed with the commands
# what a command gives of a new row, and the code of a name that is taken
OWN = {"category": ("CategoryID", "Name", "Description"), "suppliers": ("SupplierID", "Name", "Contact", "Email", "Address")}
NAME_TAKEN = {"category": "UNIQUE_NAME", "suppliers": "-20023"}


ADMIN = ("ADD_CATEGORY", "ADD_SUPPLIER", "ADD_PRODUCT", "CATEGORY_OFF", "CATEGORY_ON", "SET_PRICE")


class Replay:
    """The ledger, outcomes and audit rows are only computed when they are asked for."""

    def __init__(
        self, ledger: Callable[[], Ledger], dimensions: Callable[[], Tables],
        outcomes: Callable[[Ledger | None], list[DataFrame]], admin: Callable[[], list[DataFrame]],
    ):
        self._ledger, self._dimensions, self._outcomes, self._admin = ledger, dimensions, outcomes, admin

    @cached_property
    def ledger(self) -> Ledger:
        return self._ledger()

    @cached_property
    def dimensions(self) -> Tables:
        """The tables with categories, suppliers, products and prices as they stand after the log."""
        return self._dimensions()

    @cached_property
    def outcomes(self) -> DataFrame:
        """(cmd_id, event_ts, cmd_type, status, code), one row for every command.

        Before the ledger is asked for, its commands are decided here without their texts.
        """
        return reduce(DataFrame.unionByName, self._outcomes(self.__dict__.get("ledger")))

    @cached_property
    def admin_audit(self) -> DataFrame:
        """Audit rows, without LogID, of what administrators changed."""
        return reduce(DataFrame.unionByName, self._admin())

    @cached_property
    def tables(self) -> Tables:
        """All tables as they stand after the log."""
        old = self.dimensions
        audit = self.ledger.audit.drop("LogID").unionByName(self.admin_audit)
        return {
            **old,
            "stock_management": self.ledger.stock,
            "transactions": old["transactions"].unionByName(self.ledger.transactions),
            "transaction_items": old["transaction_items"].unionByName(self.ledger.items),
            "audit_log": old["audit_log"].unionByName(with_log_ids(audit, old["audit_log"])),
        }


def _outcome(df: DataFrame, code, status=None) -> DataFrame:
    verdict = F.when(code.isNotNull(), "rejected").otherwise("applied") if status is None else status
    return df.select("cmd_id", "event_ts", "cmd_type", verdict.alias("status"), code.cast("string").alias("code"))


def _initially(df: DataFrame, *columns) -> DataFrame:
    """State before the log begins."""
    return df.select(long_ago().alias("event_ts"), F.lit(-1).cast("long").alias("cmd_id"), *columns)


def replay(log: DataFrame, t: Tables, rules: str = "package", blocks: int | None = None) -> Replay:
    """Apply the log to the tables.

    Types: SALE, RETURN, RESTOCK, ADD_CATEGORY, ADD_SUPPLIER, ADD_PRODUCT,
    CATEGORY_OFF, CATEGORY_ON, SET_PRICE. Any other type is refused by the ledger.
    """
    def of(*types: str) -> DataFrame:
        return log.filter(F.col("cmd_type").isin(*types))

    asked = {r[0] for r in of(*ADMIN).select("cmd_type").distinct().collect()}  # at most len(ADMIN) rows

    def with_new(kind: str, stored: DataFrame, added: Callable[[], DataFrame]) -> DataFrame:
        """``stored`` and what commands of ``kind`` add; without such commands the plan is spared their branch."""
        return stored.unionByName(added()) if kind in asked else stored

    def holders(rows: DataFrame, table: str, unique: list[str]) -> DataFrame:
        """Rows with ``code``: what a command breaks, a constraint of its row or a value held before it."""
        judged = rows.withColumn("_at", F.struct(*AT)).withColumn("code", constraint_code(rows.select(*OWN[table]), table))
        judged = cut_lineage(judged)
        taken = first_holders(judged.filter(F.col("code").isNull()), t[table], unique, "_at").select(F.col("_at").alias("_in"))
        named = t[table].select(F.col("Name").alias("_held")).distinct() if "Name" in unique else None
        marked = judged.join(taken, F.col("_at") == F.col("_in"), "left")
        clash = F.lit("UNIQUE_ID")
        if named is not None:
            earlier = judged.filter(F.col("code").isNull()).groupBy(F.col("Name").alias("_own")).agg(F.min("_at").alias("_first"))
            marked = marked.join(named, F.col("Name") == F.col("_held"), "left").join(earlier, F.col("Name") == F.col("_own"), "left")
            same_name = F.col("_held").isNotNull() | (F.col("_first") < F.col("_at"))
            clash = F.when(same_name, NAME_TAKEN[table]).otherwise(clash)
        return cut_lineage(
            marked.withColumn("code", F.coalesce("code", F.when(F.col("_in").isNull(), clash)))
            .drop("_in", "_held", "_own", "_first")
        )

    # categories: new ones first, then status changes against those known at the time
    @cache
    def new_cats() -> DataFrame:
        return holders(
            of("ADD_CATEGORY").select(
                *AT, "cmd_type", "actor", "category_id", F.col("category_id").alias("CategoryID"), F.col("name").alias("Name"),
                F.col("description").alias("Description"),
            ), "category", ["Name", "CategoryID"],
        )

    def cats_in() -> DataFrame:
        return new_cats().filter(F.col("code").isNull())

    cat_states = with_new(
        "ADD_CATEGORY", _initially(t["category"], F.col("CategoryID").alias("category_id"), F.col("IS_ACTIVE").alias("flag")),
        lambda: cats_in().select(*AT, "category_id", F.lit(1).alias("flag")),
    )
    known_from = cat_states.select(F.col("category_id").alias("_cat"), F.struct(*AT).alias("_since"))

    @cache
    def turns() -> DataFrame:
        flagged = of("CATEGORY_OFF", "CATEGORY_ON").withColumn("flag", F.when(F.col("cmd_type") == "CATEGORY_ON", 1).otherwise(0))
        return flagged.join(known_from, F.col("category_id") == F.col("_cat"), "left").withColumn(
            "_valid", nvl(F.col("_since") < F.struct(*AT), False)
        )

    if asked & {"CATEGORY_OFF", "CATEGORY_ON"}:
        cat_states = cat_states.unionByName(turns().filter("_valid").select(*AT, "category_id", "flag"))

    @cache
    def turned() -> DataFrame:
        """Status changes with the flag before them."""
        own = turns().drop("flag", "_cat", "_since")
        return as_of(own, cat_states, "category_id", AT, ["flag"], strict=True, blocks=blocks)

    idle = (F.col("cmd_type") == "CATEGORY_OFF") & (F.col("flag") == 0)

    # suppliers
    @cache
    def new_sups() -> DataFrame:
        return holders(
            of("ADD_SUPPLIER").select(
                *AT, "cmd_type", "actor", "supplier_id", F.col("supplier_id").alias("SupplierID"), F.col("name").alias("Name"),
                F.col("contact").alias("Contact"), F.col("email").alias("Email"), F.col("address").alias("Address"),
            ), "suppliers", ["Name", "Email", "SupplierID"],
        )

    def sups_in() -> DataFrame:
        return new_sups().filter(F.col("code").isNull())

    # products
    @cache
    def new_prods() -> DataFrame:
        usable_sups = with_new(
            "ADD_SUPPLIER", _initially(t["suppliers"].filter("Is_Active = 1"), F.col("SupplierID").alias("_sup")),
            lambda: sups_in().select(*AT, F.col("supplier_id").alias("_sup")),
        ).select("_sup", F.struct(*AT).alias("_sup_since"))
        rows = as_of(of("ADD_PRODUCT"), cat_states, "category_id", AT, ["flag"], blocks=blocks).join(
            usable_sups, F.col("supplier_id") == F.col("_sup"), "left"
        )
        has_supplier = nvl(F.col("_sup_since") < F.struct(*AT), False)
        rows = rows.select(
            *AT, "cmd_type", "actor", "product_id", F.col("product_id").alias("ProductID"), F.col("name").alias("Name"),
            F.col("category_id").alias("CategoryID"), F.col("supplier_id").alias("SupplierID"),
            F.col("unit_price").alias("Unit_Price"), F.col("quantity").alias("Quantity"),
            F.col("restock_level").alias("Restock_Level"),
            F.when(F.col("flag").isNull(), "-20020").when(F.col("flag") == 0, "-20021").when(~has_supplier, "-20022").alias("_refused"),
        )
        code = F.coalesce("_refused", product_code(rows), F.when(F.col("ProductID").isNull(), "NOT_NULL"))
        rows = cut_lineage(rows.withColumn("code", code).withColumn("_at", F.struct(*AT)).drop("_refused"))
        first = first_holders(rows.filter(F.col("code").isNull()), t["products"], ["ProductID"], "_at")
        return cut_lineage(
            rows.join(first.select(F.col("_at").alias("_in")), F.col("_at") == F.col("_in"), "left")
            .withColumn("code", F.coalesce("code", F.when(F.col("_in").isNull(), "UNIQUE_ID"))).drop("_in")
        )

    def prods_in() -> DataFrame:
        return new_prods().filter(F.col("code").isNull())

    # prices
    since = _initially(t["products"], F.col("ProductID").alias("product_id"), F.col("Unit_Price").alias("unit_price"))
    since = with_new("ADD_PRODUCT", since, lambda: prods_in().select(*AT, "product_id", F.col("Unit_Price").alias("unit_price")))
    first_seen = since.select(F.col("product_id").alias("_prod"), F.struct(*AT).alias("_since"))
    good_price = F.col("_valid") & nvl(F.col("unit_price") > 0, False)

    @cache
    def repriced() -> DataFrame:
        rows = of("SET_PRICE").join(first_seen, F.col("product_id") == F.col("_prod"), "left")
        return rows.withColumn("_valid", nvl(F.col("_since") < F.struct(*AT), False))

    price_states = with_new("SET_PRICE", since, lambda: repriced().filter(good_price).select(*AT, "product_id", "unit_price"))

    all_cats = with_new("ADD_CATEGORY", t["category"], lambda: apply_defaults(
        cats_in().select("CategoryID", "Name", "Description", F.col("event_ts").alias("Created_At")), "category"
    ))
    all_products = with_new("ADD_PRODUCT", t["products"], lambda: apply_defaults(
        prods_in().select("ProductID", "Name", "CategoryID", "SupplierID", "Unit_Price", F.col("event_ts").alias("Created_At")),
        "products",
    ))

    @cache
    def category() -> DataFrame:
        final_flag = cat_states.groupBy(F.col("category_id").alias("_c")).agg(
            F.max_by("flag", F.struct(*AT)).alias("_flag")
        )
        return all_cats.join(final_flag, F.col("CategoryID") == F.col("_c")).select(
            "CategoryID", "Name", "Description", F.col("_flag").cast("int").alias("IS_ACTIVE"), "Created_At"
        )

    def dimensions() -> Tables:
        """Tables as they stand after the log."""
        suppliers = with_new("ADD_SUPPLIER", t["suppliers"], lambda: apply_defaults(
            sups_in().select("SupplierID", "Name", "Contact", "Email", "Address", F.col("event_ts").alias("Created_At")),
            "suppliers",
        ))
        final_price = price_states.groupBy(F.col("product_id").alias("_p")).agg(
            F.max_by("unit_price", F.struct(*AT)).alias("_price")
        )
        products = all_products.join(final_price, F.col("ProductID") == F.col("_p")).select(
            *[F.col("_price").cast(PRICE).alias(c) if c == "Unit_Price" else c for c in all_products.columns]
        )
        return {**t, "category": category(), "suppliers": suppliers, "products": products}

    def first_stock() -> DataFrame:
        rows = prods_in().select("ProductID", "Quantity", "Restock_Level", F.col("event_ts").alias("Last_Updated"), "cmd_id")
        keyed = assign_keys(rows, "StockID", next_key(t["stock_management"], "StockID"), ["Last_Updated", "cmd_id"])
        return apply_defaults(keyed, "stock_management")

    opening = with_new("ADD_PRODUCT", t["stock_management"], first_stock)

    known = {**t, "category": all_cats, "products": all_products, "stock_management": opening}

    def decided(texts: bool) -> DataFrame:
        """Ledger commands, each with price and category status as of its position; ``texts`` are what a verdict does not depend on."""
        cmds = log.filter(nvl(~F.col("cmd_type").isin(*ADMIN), True)).select(
            "cmd_id", "event_ts", "user_id", "product_id", "quantity", "cmd_type", *(("notes", "actor") if texts else ())
        )
        unused = ["category_id", "Unit_Price", *([] if texts else ["user_id", "product_name", "category_name"])]
        # a short history of the categories is looked up where the commands lie
        states = cat_states.withColumn("flag", F.col("flag").cast(INT))
        facts = as_of_short(
            attach_facts(cmds, known, category_id=True).drop("category_active"), states, "category_id", AT, "flag", SHORT
        )
        if facts is None:
            # only restocking asks for the category, so only those commands go through its history
            restock = nvl(F.col("cmd_type") == "RESTOCK", False)
            restocks = attach_facts(cmds.filter(restock), known, category_id=True).drop("category_active", *unused[1:])
            restocks = as_of(restocks, states, "category_id", AT, ["flag"], blocks=blocks).drop("category_id")
            others = attach_facts(cmds.filter(~restock), known).withColumnRenamed("category_active", "flag").drop(*unused)
            facts = others.unionByName(restocks)
        facts = facts.withColumnRenamed("flag", "category_active").drop(*unused)
        # stored before they are placed: the joins run once, and their shuffles are gone when the placement writes its own
        with noting() as aside:
            facts = stored(facts)
        # one placement by product and time: the price as of each command, then the running stock over the same blocks
        facts = as_of(facts, price_states, "product_id", AT, ["unit_price"], blocks=blocks, within=["quantity"])
        remove(log.sparkSession, aside)
        # a product that is not added yet has no price and counts as missing
        facts = facts.withColumn(
            "product_active", F.when(F.col("unit_price").isNotNull(), F.col("product_active"))
        ).withColumnRenamed("unit_price", "Unit_Price")
        return decide(judge(facts, rules), rules, placed=True, message=texts)

    def ledger() -> Ledger:
        return Ledger(decided(True), {**t, "stock_management": opening}, rules)

    def admin_audit() -> list[DataFrame]:
        ids = F.col("CategoryID")
        off = turned().filter(F.col("_valid") & (F.col("cmd_type") == "CATEGORY_OFF") & ~nvl(idle, False))
        events = off.select(*AT, "category_id", "actor", F.lit(0).cast("long").alias("_more")).unionByName(
            prods_in().select(*AT, F.col("CategoryID").alias("category_id"), F.lit(None).cast("string").alias("actor"), F.lit(1).cast("long").alias("_more"))
        )
        counted = running_sum(events, "category_id", AT, "_more", "_added", blocks).filter("_more = 0")
        stored = t["products"].filter("Is_Active = 1").groupBy(ids.alias("_c")).agg(F.count(F.lit(1)).alias("_stored"))
        names = all_cats.select(ids.alias("_n"), F.col("Name").alias("category_name"))
        deleted = counted.join(stored, F.col("category_id") == F.col("_c"), "left").join(
            names, F.col("category_id") == F.col("_n"), "left"
        ).select(*AT, "actor", F.col("category_id").alias("CategoryID"), "category_name",
                 (nvl("_stored", 0) + F.col("_added")).alias("affected"))
        good = repriced().filter(good_price).select(*AT, "product_id", "actor", F.col("unit_price").alias("_price"))
        priced = as_of(good, price_states, "product_id", AT, ["unit_price"], strict=True, blocks=blocks)
        about = all_products.select(F.col("ProductID").alias("_p"), "Name", "CategoryID", "Is_Active")
        images = priced.join(about, F.col("product_id") == F.col("_p")).select(
            *AT, "actor",
            *[F.struct(F.col("_p").alias("ProductID"), "Name", F.col(price).cast(PRICE).alias("Unit_Price"), "CategoryID", "Is_Active").alias(side)
              for side, price in (("o", "unit_price"), ("n", "_price"))],
        )
        changed = audit_product_images(images, "actor", "event_ts").withColumnsRenamed({"event_ts": "Change_Date"})
        changed = changed.withColumn("Changed_By", nvl("actor", "system")).drop("actor")
        return [soft_delete_audit(deleted), supplier_audit(sups_in()), product_audit(prods_in()), changed]

    def outcomes(made: Ledger | None) -> list[DataFrame]:
        unknown = F.when(~F.col("_valid"), "-20026")
        status = F.when(~F.col("_valid"), "rejected").when(idle, "no-op").otherwise("applied")
        found = [_outcome(made.decided if made else decided(False), F.col("code"))]
        for kind, rows in (("ADD_CATEGORY", new_cats), ("ADD_SUPPLIER", new_sups), ("ADD_PRODUCT", new_prods)):
            if kind in asked:
                found.append(_outcome(rows(), F.col("code")))
        if asked & {"CATEGORY_OFF", "CATEGORY_ON"}:
            found.append(_outcome(turned(), unknown, status))
        if "SET_PRICE" in asked:  # an update of an unknown product touches no row
            found.append(_outcome(
                repriced(), F.when(F.col("_valid") & ~good_price, "CHK_PRICE"),
                F.when(~F.col("_valid"), "no-op").when(good_price, "applied").otherwise("rejected"),
            ))
        return found

    return Replay(ledger, dimensions, outcomes, admin_audit)
