"""Data-quality jobs: what the declared constraints would have refused."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from shelfwise.model import FOREIGN_KEYS, KEYS, RULES, Rules
from shelfwise.session import cut_lineage
from shelfwise.sources.tables import Tables

#: Words of values without a parent that are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_WORDS = 1 << 20
#: Rows that one task groups by a key at most, some 150 MB; a value held by more of them is merged before it moves.
PER_TASK = 1 << 20
SLOTS = 4096  # by which a key's rows are counted
CROWDED = 8  # times the mean: the slot holds a value of many rows
FOUND = "table_name string, rule string, value string, row_count bigint"


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _row_rules(df: DataFrame, rules: Rules) -> list[tuple[str, Column, Column]]:
    """(rule name, failing condition, offending value) for each declared rule."""
    out = []
    for c in rules.required:
        if c in df.columns:
            out.append((f"NOT NULL {c}", F.col(c).isNull(), F.lit(None).cast("string")))
    for c, values in rules.allowed.items():
        if c in df.columns:
            out.append((f"VALUE {c}", ~F.col(c).isin(*values), F.col(c).cast("string")))
    for c, bound in rules.above.items():
        if c in df.columns:
            out.append((f"ABOVE {bound} {c}", F.col(c) <= bound, F.col(c).cast("string")))
    for c, bound in rules.at_least.items():
        if c in df.columns:
            out.append((f"AT LEAST {bound} {c}", F.col(c) < bound, F.col(c).cast("string")))
    for c, size in rules.max_length.items():
        if c in df.columns:
            out.append((f"LENGTH {size} {c}", F.length(c) > size, F.col(c)))
    return out


# The names by which a refused write reports its constraint.
CODES = {"Unit_Price": "CHK_PRICE", "Quantity": "CHK_QTY", "Restock_Level": "CHK_QTY", "Role": "CHK_ROLE"}


def constraint_code(df: DataFrame, table: str, nulls: bool = True) -> Column:
    """The first declared row rule that a row of ``df`` breaks, as a short code; NULL if it breaks none.

    Only columns that ``df`` has are judged. Without ``nulls`` a NULL breaks no
    rule (updates leave such columns as they are).
    """
    code = F.lit(None).cast("string")
    for name, bad, _ in reversed(_row_rules(df, RULES[table])):
        kind, column = name.split()[0], name.split()[-1]
        if kind == "NOT":
            if nulls:
                code = F.when(bad, "NOT_NULL").otherwise(code)
        else:
            code = F.when(bad, "LENGTH" if kind == "LENGTH" else CODES.get(column, "CHK_FLAG")).otherwise(code)
    return code


def check_rows(df: DataFrame, table: str, rules: Rules | None = None) -> DataFrame:
    """(table_name, record_id, rule, value) for every broken row rule, in one pass over the rows."""
    checks = _row_rules(df, rules or RULES[table])
    found = F.array(
        *[F.when(bad, F.struct(F.lit(name).alias("rule"), value.alias("value"))) for name, bad, value in checks]
    )
    broken = reduce(lambda a, b: a | b, [F.coalesce(bad, F.lit(False)) for _, bad, _ in checks])
    return (
        df.filter(broken)
        .select(F.col(KEYS[table]).alias("record_id"), F.explode(F.array_compact(found)).alias("v"))
        .select(F.lit(table).alias("table_name"), "record_id", "v.rule", "v.value")
    )


def _known(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))


def _slot(columns: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SLOTS)).cast("int")


def _spread(keys: Sequence[tuple[DataFrame, Sequence[str]]]) -> dict[int, tuple[int, list[int]]]:
    """For each of ``keys`` with more than ``PER_TASK`` rows: tasks to group it in, and crowded slots."""
    slots = _union([_known(df, c).select(F.lit(k).alias("key"), _slot(c).alias("slot")) for k, (df, c) in enumerate(keys)])
    full = slots.groupBy("key", "slot").agg(F.count(F.lit(1)).alias("n"))
    sums = full.groupBy("key").agg(F.sum("n").alias("n"), F.collect_list(F.struct("slot", "n")).alias("full"))
    crowded = F.filter("full", lambda x: x["n"] * SLOTS > F.col("n") * CROWDED)  # SLOTS / CROWDED at most
    rows = sums.filter(F.col("n") > PER_TASK).select("key", "n", crowded["slot"].alias("crowded")).collect()  # one row a key
    return {r["key"]: (-(-r["n"] // PER_TASK), r["crowded"]) for r in rows}


def _repeated(df: DataFrame, table: str, columns: Sequence[str], spread: tuple[int, list[int]] | None) -> DataFrame:
    rows, parts = _known(df, columns), []
    if spread:  # as many tasks as the rows ask for; what is crowded is merged before it moves
        tasks, crowded = spread
        slot = _slot(columns)
        even = rows.filter(~slot.isin(crowded)) if crowded else rows
        parts = [even.select(*columns).repartition(tasks, *columns)]
        rows = rows.filter(slot.isin(crowded)) if crowded else None
    counted = [p.groupBy(*columns).agg(F.count(F.lit(1)).alias("row_count")) for p in [*parts, *([] if rows is None else [rows])]]
    value = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    return _union(counted).filter("row_count > 1").select(
        F.lit(table).alias("table_name"),
        F.lit("UNIQUE " + ",".join(columns)).alias("rule"),
        value.alias("value"),
        "row_count",
    )


def check_unique(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """(table_name, rule, value, row_count) for key values held by several rows; NULLs never clash.

    The rows are counted first, as the number of tasks follows from it.
    """
    return _repeated(df, table, columns, _spread([(df, columns)]).get(0))


def check_all_unique(t: Tables) -> DataFrame:
    keys = [(name, [c]) for name in t for c in RULES[name].unique]
    spread = _spread([(t[name], columns) for name, columns in keys])
    return _union([_repeated(t[name], name, columns, spread.get(k)) for k, (name, columns) in enumerate(keys)])


def check_fk(child: DataFrame, table: str, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """(table_name, rule, value, row_count) for values without a parent row.

    Values are counted before the join, so a value repeated in a large share of
    the rows crosses the shuffle once.
    """
    values = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value")).agg(
        F.count(F.lit(1)).alias("row_count")
    )
    parents = parent.select(F.col(parent_column).alias("_parent"))
    return values.join(parents, F.col("_value") == F.col("_parent"), "left_anti").select(
        F.lit(table).alias("table_name"),
        F.lit(f"FOREIGN KEY {column}").alias("rule"),
        F.col("_value").cast("string").alias("value"),
        "row_count",
    )


def _is_integer(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.IntegralType)


def _word(column: str) -> Column:
    """The number of the 64 neighbouring values a key lies among."""
    return F.shiftright(F.col(column).cast("long"), 6)


def _bit(column: str) -> Column:
    """The key's place among them, as a word with one bit set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col(column).cast("long").bitwiseAND(63).cast("int"))


def key_words(t: Tables, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """``(key, word, bits, n)`` for the integer columns ``keys`` (table, column), numbered in that order.

    A bitmap in words of 64 bits: which of 64 neighbouring values occur, and in how
    many rows. Tasks merge their rows before they move, so dense keys cost a
    64th of their rows, scattered ones no more than their distinct values.
    """
    parts = [
        t[table].filter(F.col(c).isNotNull()).select(F.lit(k).alias("key"), _word(c).alias("word"), _bit(c).alias("bit"))
        for k, (table, c) in enumerate(keys)
    ]
    return _union(parts).groupBy("key", "word").agg(F.bit_or("bit").alias("bits"), F.count(F.lit(1)).alias("n"))


class _KeyCheck:
    """Bitmaps of key columns, and what they say about values without a parent.

    The rows of a child are only looked at again where some value of it has no
    parent, and only those with such a value are shuffled.
    """

    def __init__(self, t: Tables, unique: Sequence[tuple[str, str]] = ()):
        self.tables = t
        self.fks = [fk for fk in FOREIGN_KEYS if _is_integer(t[fk[0]], fk[1]) and _is_integer(t[fk[2]], fk[3])]
        self.keys = list(dict.fromkeys([*unique, *[fk[:2] for fk in self.fks], *[fk[2:] for fk in self.fks]]))
        self.words = cut_lineage(key_words(t, self.keys))

    @cached_property
    def missing(self) -> DataFrame:
        """``(fk, word, bits)``: values of a child that its parent doesn't have."""
        at = {key: k for k, key in enumerate(self.keys)}
        asked = F.array(*[F.struct(F.lit(k).alias("fk"), F.lit(at[fk[:2]]).alias("child"), F.lit(at[fk[2:]]).alias("parent")) for k, fk in enumerate(self.fks)])
        wanted = F.filter(asked, lambda x: x["child"] == F.col("key"))
        children = self.words.withColumn("a", F.explode(wanted)).select("a.fk", F.col("a.parent").alias("key"), "word", "bits")
        held = self.words.select("key", "word", F.col("bits").alias("held"))
        bits = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("held", F.lit(0).cast("long"))))
        return cut_lineage(children.join(held, ["key", "word"], "left").select("fk", "word", bits.alias("bits")).filter("bits <> 0"))

    def orphans(self) -> list[DataFrame]:
        """``(table_name, rule, value, row_count)``, one frame for each foreign key that is broken."""
        sizes = {r["fk"]: r["count"] for r in self.missing.groupBy("fk").count().collect()}  # one row for each foreign key at most
        out = []
        for k, (child, column, _, _) in enumerate(self.fks):
            if k not in sizes:
                continue
            value = F.col(column).alias("_value")
            lost = self.missing.filter(F.col("fk") == k).select(F.col("word").alias("_word"), "bits")
            values = self.tables[child].filter(F.col(column).isNotNull()).select(value)
            small = sizes[k] <= BROADCAST_WORDS
            if not small:  # values are counted before they meet the words
                values = values.groupBy("_value").agg(F.count(F.lit(1)).alias("row_count"))
            met = values.join(F.broadcast(lost) if small else lost, _word("_value") == F.col("_word"))
            met = met.filter(F.col("bits").bitwiseAND(_bit("_value")) != 0)
            if small:
                met = met.groupBy("_value").agg(F.count(F.lit(1)).alias("row_count"))
            out.append(met.select(
                F.lit(child).alias("table_name"), F.lit(f"FOREIGN KEY {column}").alias("rule"),
                F.col("_value").cast("string").alias("value"), "row_count",
            ))
        return out


def check_all_fks(t: Tables) -> DataFrame:
    """All declared foreign keys: integer ones by bitmaps of both sides, so only values without a parent are shuffled."""
    checked = _KeyCheck(t)
    others = [check_fk(t[c], c, col, t[p], pcol) for c, col, p, pcol in FOREIGN_KEYS if (c, col, p, pcol) not in checked.fks]
    found = [*checked.orphans(), *others]
    return _union(found) if found else next(iter(t.values())).sparkSession.createDataFrame([], FOUND)


def quality_report(t: Tables) -> DataFrame:
    """Violations per table and rule; rules without a violation do not appear.

    Unique rules count the rows in excess of one per value. One pass over each
    table counts all its row rules. Integer keys are read once more, column by
    column, into bitmaps: rows less set bits are in excess, and a child's bits that
    the parent lacks are orphans. Keys of other types are grouped as they are.
    """
    rows = []
    for table, df in t.items():
        checks = _row_rules(df, RULES[table])
        counts = df.agg(*[F.count_if(bad).alias(f"c{k}") for k, (_, bad, _) in enumerate(checks)])
        listed = F.array(*[F.struct(F.lit(of).alias("rule"), F.col(f"c{k}").alias("n")) for k, (of, _, _) in enumerate(checks)])
        rows.append(
            counts.select(F.explode(listed).alias("v"))
            .select(F.lit(table).alias("table_name"), "v.rule", F.col("v.n").alias("violations")).filter("violations > 0")
        )
    unique = [(table, c) for table in t for c in RULES[table].unique]
    by_bits = [key for key in unique if _is_integer(t[key[0]], key[1])]
    checked = _KeyCheck(t, by_bits)
    named = F.array(*[F.struct(F.lit(table).alias("table_name"), F.lit(f"UNIQUE {c}").alias("rule")) for table, c in by_bits])
    excess = (
        checked.words.filter(F.col("key") < len(by_bits))
        .groupBy("key").agg((F.sum("n") - F.sum(F.bit_count("bits"))).alias("violations"))
        .select(named[F.col("key")].alias("of"), "violations").select("of.table_name", "of.rule", "violations")
    )
    others = [
        t[table].filter(F.col(c).isNotNull()).select(F.lit(table).alias("table_name"), F.lit(f"UNIQUE {c}").alias("rule"), F.col(c).cast("string").alias("value"))
        for table, c in unique if (table, c) not in by_bits
    ]
    others = _union(others).groupBy("table_name", "rule", "value").agg((F.count(F.lit(1)) - 1).alias("more")).filter("more > 0")
    orphans = [*checked.orphans(), *[check_fk(t[c], c, col, t[p], pcol) for c, col, p, pcol in FOREIGN_KEYS if (c, col, p, pcol) not in checked.fks]]
    counted = [others.withColumnRenamed("more", "violations").drop("value"), *[o.select("table_name", "rule", F.col("row_count").alias("violations")) for o in orphans]]
    summed = _union(counted).groupBy("table_name", "rule").agg(F.sum("violations").alias("violations"))
    return _union([*rows, excess.filter("violations > 0"), summed])


def row_counts(t: Tables) -> DataFrame:
    return _union(
        [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
         for name, df in t.items()]
    )
