"""The stock ledger: SALE, RETURN and RESTOCK commands applied in time order."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.functions.dialect import number_text, nvl, text
from shelfwise.functions.fold import balance_before
from shelfwise.functions.scan import BLOCK, range_blocks, running_sum
from shelfwise.sources.tables import Tables, assign_keys, next_key

# Order of application. Quantity last: two commands equal in all of these are interchangeable.
ORDER = ("event_ts", "cmd_id", "quantity")

# Reject codes of the two rule sets.
PACKAGE = {
    "SALE": {"product": "-20030", "stock_row": "NO_STOCK_ROW", "short": "-20031"},
    "RETURN": {"product": "-20032"},
    "RESTOCK": {"product": "-20024", "category": "-20025", "stock_row": "NO_STOCK_ROW"},
}
PROCEDURE = {
    "SALE": {"product": "-20001", "stock_row": "-20002", "short": "-20003"},
    "RETURN": {"product": "-20001", "stock_row": "-20002"},
    "RESTOCK": {"product": "-20005", "category": "-20006", "stock_row": "NO_STOCK_ROW"},
}
BAD_TYPE, BAD_QUANTITY, UNKNOWN_USER, TOO_LARGE = "-20004", "CHK_QTY", "FK_USER", "AMOUNT_RANGE"
RULE_SETS = {"package": PACKAGE, "procedure": PROCEDURE}


class Ledger:
    """Result of a batch. ``decided`` holds every command once, in one frame.

    Keys are only assigned when headers, items or audit rows are asked for.
    """

    def __init__(self, decided: DataFrame, t: Tables, rules: str = "package"):
        self.decided = decided
        self.tables = t
        self.rules = rules

    @property
    def accepted(self) -> DataFrame:
        return self.decided.filter("accepted")

    @property
    def rejected(self) -> DataFrame:
        return self.decided.filter("NOT accepted").select(
            "cmd_id", "event_ts", "user_id", "product_id", "quantity", "cmd_type", "code", "message"
        )

    @cached_property
    def stock(self) -> DataFrame:
        return stock_after(self.decided, self.tables["stock_management"])

    @cached_property
    def _rows(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return ledger_rows(self.accepted, self.tables, self.rules)

    @property
    def transactions(self) -> DataFrame:
        return self._rows[0]

    @property
    def items(self) -> DataFrame:
        return self._rows[1]

    @property
    def audit(self) -> DataFrame:
        return self._rows[2]


def attach_facts(cmds: DataFrame, t: Tables, category_id: bool = False) -> DataFrame:
    """Join what the checks need: product, category, stock row and user of each command; on demand its category's id."""
    products = t["products"].select(
        F.col("ProductID").alias("_product"), F.col("Name").alias("product_name"), "Unit_Price",
        F.col("Is_Active").alias("product_active"), "CategoryID",
    )
    cats = t["category"].select(
        F.col("CategoryID").alias("_category"), F.col("Name").alias("category_name"),
        F.col("IS_ACTIVE").alias("category_active"),
    )
    stock = t["stock_management"].select(F.col("ProductID").alias("_stocked"), F.col("Quantity").alias("stock_start"))
    people = t["users"].select(F.col("UserID").alias("_user"))
    # one row per product with all it implies, so commands meet a single product-side join
    catalogue = products.join(cats, F.col("CategoryID") == F.col("_category"), "left").join(
        stock, F.col("_product") == F.col("_stocked"), "left"
    )
    # users first: the commands are still narrow when that join moves them
    known = cmds.join(people, F.col("user_id") == F.col("_user"), "left").withColumn("user_known", F.col("_user").isNotNull())
    facts = (
        known.join(catalogue, F.col("product_id") == F.col("_product"), "left")
        .withColumnsRenamed({"CategoryID": "category_id"} if category_id else {})
        .drop("_product", "_category", "_stocked", "_user", "CategoryID")
    )
    return facts.select(*[c for c in facts.columns if c != "user_known"], "user_known")


def _amount() -> Column:
    """What a command is worth; NULL where that does not fit the header's column."""
    restock = F.col("cmd_type") == "RESTOCK"
    price = F.when(restock, F.lit(0)).otherwise(F.col("Unit_Price")).cast("decimal(10,2)")
    return (price * F.col("quantity")).try_cast("decimal(12,2)")


def judge(facts: DataFrame, rules: str = "package") -> DataFrame:
    """Add ``code`` (checks before the stock check) and ``late_code`` (checks after it).

    The first failing check wins. Quantity and user are left to constraints in
    the source system, which act after the stock check; so does ``late_code``.
    """
    codes = RULE_SETS[rules]
    kind = F.col("cmd_type")
    usable = nvl(F.col("product_active") == 1, False)
    no_row = F.col("stock_start").isNull()
    no_category = F.col("category_active").isNull()
    known_type = nvl(kind.isin(*codes), False)

    early = F.lit(None).cast("string")
    for name, checks in codes.items():
        ready = usable & ~no_category if name == "RESTOCK" else usable
        verdict = F.when(~ready, checks["product"])
        if "category" in checks:
            verdict = verdict.when(F.col("category_active") == 0, checks["category"])
        if "stock_row" in checks:
            verdict = verdict.when(no_row, checks["stock_row"])
        early = F.when(kind == name, verdict).otherwise(early)
    if rules == "procedure":
        sale = codes["SALE"]
        untyped = F.when(~usable, sale["product"]).when(no_row, sale["stock_row"]).otherwise(BAD_TYPE)
    else:
        untyped = F.lit(BAD_TYPE)
    late = F.when(F.col("quantity").isNull() | (F.col("quantity") <= 0), BAD_QUANTITY).when(
        ~F.col("user_known"), UNKNOWN_USER
    ).when((kind != "RESTOCK") & _amount().isNull() & F.col("Unit_Price").isNotNull(), TOO_LARGE)
    return facts.withColumn("code", F.when(known_type, early).otherwise(untyped)).withColumn("late_code", late)


def screen_commands(cmds: DataFrame, t: Tables, rules: str = "package") -> DataFrame:
    """Static validation of commands against the tables, before any stock is moved."""
    return judge(attach_facts(cmds, t), rules)


def _message(codes: dict[str, dict[str, str]], rules: str) -> Column:
    """The error texts, by code."""
    pid, name, cat = F.col("product_id"), F.col("product_name"), F.col("category_name")
    code = F.col("code")
    products = {c["product"] for c in codes.values()}
    rows = {c["stock_row"] for c in codes.values() if c.get("stock_row", "").startswith("-")}
    amounts = ("Available: ", F.col("stock_before"), ", Requested: ", F.col("quantity"))
    if rules == "package":
        short = text('ERROR: Insufficient stock for "', name, '". ', *amounts)
        blocked = text('ERROR: Cannot restock "', name, '". Category "', cat, '" is inactive (IS_ACTIVE=0).')
    else:
        short = text("ERROR: Insufficient stock. ", *amounts)
        blocked = text(
            'ERROR: Cannot restock product "', name, '". Category "', cat,
            '" is inactive (IS_ACTIVE=0). Restock is only allowed for active categories.',
        )
    message = F.when(code.isin(*products), text("ERROR: Product ID ", pid, " not found or inactive."))
    if rows:
        message = message.when(code.isin(*rows), text("ERROR: No stock record found for Product ID ", pid))
    return (
        message.when(code == codes["SALE"]["short"], short)
        .when(code == codes["RESTOCK"]["category"], blocked)
        .when(code == BAD_TYPE, "ERROR: Invalid transaction type. Use SALE or RETURN.")
        .when(code == "NO_STOCK_ROW", text("no stock row for product ", pid))
        .when(code == BAD_QUANTITY, "quantity must be above 0")
        .when(code == UNKNOWN_USER, text("unknown user ", F.col("user_id")))
        .when(code == TOO_LARGE, "amount too large")
    )


def decide(
    judged: DataFrame, rules: str = "package", blocks: int | None = None, placed: bool = False, message: bool = True
) -> DataFrame:
    """Run the judged commands through the running stock.

    Every command comes out once, with ``accepted``, ``code``, ``message``,
    ``stock_before`` and ``stock_after``. One range shuffle, none if the commands
    are ``placed`` already; commands refused before the stock check travel along
    without effect. Without ``message`` the names it is made of need not be there.
    """
    codes = RULE_SETS[rules]
    signed = F.when(F.col("cmd_type") == "SALE", -F.col("quantity")).otherwise(F.col("quantity"))
    live = F.col("code").isNull() & F.col("late_code").isNull() & F.col("stock_start").isNotNull()
    moves = judged.withColumn("effect", F.when(live, signed).otherwise(0)).drop(
        "product_active", "category_active", "user_known"  # settled; not worth shuffling
    )
    in_blocks = moves if placed else range_blocks(moves, ["product_id"], ORDER, blocks)
    folded = balance_before(in_blocks, "product_id", "effect", "stock_start").withColumnRenamed(
        "balance_before", "stock_before"
    )
    short = (F.col("cmd_type") == "SALE") & (F.col("stock_before") < F.col("quantity"))
    code = F.coalesce("code", F.when(short, codes["SALE"]["short"]), "late_code")
    moved = F.when(F.col("code").isNull(), F.col("effect")).otherwise(0)
    return (
        folded.withColumn("code", code)
        .withColumn("accepted", F.col("code").isNull())
        .withColumns({"message": _message(codes, rules)} if message else {})
        .withColumn("effect", moved)
        .withColumn("stock_after", F.col("stock_before") + F.col("effect"))
        # a return for a product without a stock row is taken, but moves nothing
        .withColumn("warning", F.when(F.col("accepted") & F.col("stock_start").isNull(), "NO_STOCK_ROW"))
        .drop("late_code", BLOCK)
    )


def ledger_rows(accepted: DataFrame, t: Tables, rules: str = "package") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, items, audit rows) of accepted commands, keyed after the stored ones.

    One numbering serves the three keys: each command has one header, one item
    and one audit row.
    """
    used = accepted.select(  # what the three outputs show; texts of refusals stay behind
        "cmd_id", "event_ts", "user_id", "product_id", "quantity", "cmd_type", "notes", "actor", "product_name",
        "Unit_Price", "stock_before", "stock_after",
    )
    numbered = assign_keys(used, "_n", 0, ["event_ts", "cmd_id", "product_id", "quantity"])
    restock = F.col("cmd_type") == "RESTOCK"
    price = F.when(restock, F.lit(0)).otherwise(F.col("Unit_Price")).cast("decimal(10,2)")
    rows = (
        numbered.withColumn("TransactionID", F.col("_n") + next_key(t["transactions"], "TransactionID"))
        .withColumn("ItemID", F.col("_n") + next_key(t["transaction_items"], "ItemID"))
        .withColumn("LogID", F.col("_n") + next_key(t["audit_log"], "LogID"))
        .withColumn("price", price)
        .withColumn("amount", _amount())
        .withColumn("note", _note(rules))
    )
    headers = rows.select(
        "TransactionID", F.col("user_id").alias("UserID"), F.col("cmd_type").alias("Trans_Type"),
        F.col("event_ts").alias("Trans_Date"), F.col("amount").alias("Total_Amount"), F.col("note").alias("Notes"),
    )
    items = rows.select(
        "ItemID", "TransactionID", F.col("product_id").alias("ProductID"), F.col("quantity").alias("Quantity"),
        F.col("price").alias("Unit_Price"), F.col("amount").alias("Subtotal"),
    )
    return headers, items, command_audit(rows, rules)


def _note(rules: str) -> Column:
    """The default notes."""
    name, qty, kind = F.col("product_name"), F.col("quantity"), F.col("cmd_type")
    if rules == "procedure":
        return F.when(kind == "RESTOCK", text("Restock: ", name, " +", qty, " units")).otherwise(F.col("notes"))
    return (
        F.when(kind == "RESTOCK", text("PKG Restock: ", name, " +", qty))
        .when(kind == "SALE", nvl("notes", text("Sale: ", name)))
        .otherwise(nvl("notes", text("Return: ", name)))
    )


def command_audit(rows: DataFrame, rules: str = "package") -> DataFrame:
    """Audit rows as the procedures write them. Their texts."""
    name, qty, kind = F.col("product_name"), F.col("quantity"), F.col("cmd_type")
    restock = kind == "RESTOCK"
    if rules == "procedure":
        value = text("Type=", kind, " Product=", name, " Qty=", qty)
        about = F.when(restock, text("Restock by procedure for product: ", name)).otherwise(
            "Transaction processed by procedure"
        )
    else:
        value = text(kind, " Qty=", qty, " Total=", number_text("amount"))
        about = (
            F.when(restock, text("Restock via PKG_ADMIN_OPS for: ", name))
            .when(kind == "SALE", text("Sale via PKG_USER_OPS: ", name))
            .otherwise(text("Return via PKG_USER_OPS: ", name))
        )
    return rows.select(
        "LogID",
        F.when(restock, "STOCK_MANAGEMENT").otherwise("TRANSACTIONS").alias("Table_Name"),
        F.when(restock, "UPDATE").otherwise("INSERT").alias("Operation"),
        F.when(restock, F.col("product_id")).otherwise(F.col("TransactionID")).alias("Record_ID"),
        nvl("actor", "system").alias("Changed_By"),
        F.col("event_ts").alias("Change_Date"),
        F.when(restock, text("Qty=", F.col("stock_before"))).alias("Old_Value"),
        F.when(restock, text("Qty=", F.col("stock_after"))).otherwise(value).alias("New_Value"),
        about.alias("Description"),
    )


def stock_after(decided: DataFrame, stock: DataFrame) -> DataFrame:
    """The stock table after the accepted commands: summed per product first, then joined."""
    moved = decided.filter("accepted AND effect <> 0").groupBy(F.col("product_id").alias("_moved")).agg(
        F.sum("effect").alias("_net"), F.max("event_ts").alias("_at")
    )
    return stock.join(moved, F.col("ProductID") == F.col("_moved"), "left").select(
        "StockID", "ProductID", (F.col("Quantity") + nvl("_net", 0)).alias("Quantity"), "Restock_Level",
        F.coalesce("_at", "Last_Updated").alias("Last_Updated"),
    )


def apply_stock_commands(
    cmds: DataFrame, t: Tables, rules: str = "package", blocks: int | None = None
) -> Ledger:
    """Apply a batch of commands to the stock, in (event_ts, cmd_id) order per product."""
    return Ledger(decide(screen_commands(cmds, t, rules), rules, blocks), t, rules)


# ---- stock from item rows --------------------------------------------------

def signed_items(items: DataFrame, transactions: DataFrame) -> DataFrame:
    """Items with the movement their header's type implies: out for SALE, in otherwise."""
    headers = transactions.select("TransactionID", "Trans_Type", "Trans_Date")
    kind = F.col("Trans_Type")
    moved = F.when(kind == "SALE", -F.col("Quantity")).when(kind.isin("RETURN", "RESTOCK"), F.col("Quantity"))
    return items.join(headers, "TransactionID").withColumn("movement", nvl(moved, 0))


def net_movement(items: DataFrame, transactions: DataFrame, stock: DataFrame) -> DataFrame:
    """Per product: stock before, net movement of all items, stock after."""
    net = signed_items(items, transactions).groupBy("ProductID").agg(F.sum("movement").alias("net"))
    return stock.select("ProductID", "Quantity").join(net, "ProductID", "left").select(
        "ProductID", F.col("Quantity").alias("stock_before"), nvl("net", 0).alias("net"),
        (F.col("Quantity") + nvl("net", 0)).alias("stock_after"),
    )


def stock_from_items(
    items: DataFrame, transactions: DataFrame, stock: DataFrame, blocks: int | None = None
) -> DataFrame:
    """Items in time order with the running stock of their product and a code where it is negative.

    Items of a product without a stock row are reported with the same code, as
    the row is looked up before anything else.
    """
    levels = stock.select("ProductID", F.col("Quantity").alias("_start"))
    moves = signed_items(items, transactions).select(
        "ItemID", "TransactionID", "ProductID", "Quantity", "Trans_Type", "Trans_Date", "movement"
    )
    ordered = running_sum(
        moves, "ProductID", ["Trans_Date", "TransactionID", "ItemID", "Quantity"], "movement", "_moved", blocks
    )
    running = F.col("_start") + F.col("_moved")
    return ordered.join(levels, "ProductID", "left").select(
        "ItemID", "TransactionID", "ProductID", "Trans_Type", "Quantity", running.alias("running_stock"),
        F.when(F.col("_start").isNull() | (running < 0), "-20041").alias("code"),
    )
