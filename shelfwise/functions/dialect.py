"""Column helpers that keep the source database's text, number and null rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfwise.model import TOTAL

AVERAGE = "decimal(18,2)"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def nvl(value: Column | str, default) -> Column:
    return F.coalesce(_col(value), default if isinstance(default, Column) else F.lit(default))


def text(*parts: Column | str) -> Column:
    """Concatenation in which NULL counts as empty. Plain strings are literals."""
    return F.concat_ws("", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def number_text(value: Column | str) -> Column:
    """A decimal without trailing zeros and without the zero before the point."""
    plain = F.regexp_replace(_col(value).cast("decimal(38,2)").cast("string"), r"\.?0+$", "")
    return F.regexp_replace(plain, r"^(-?)0\.", "$1.")


def month_text(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM")


def short_time(ts: Column | str) -> Column:
    """05-JAN 13:04:05"""
    return F.upper(F.date_format(_col(ts), "dd-MMM HH:mm:ss"))


def dated_time(ts: Column | str) -> Column:
    """05-JAN-26 13:04:05"""
    return F.upper(F.date_format(_col(ts), "dd-MMM-yy HH:mm:ss"))


def iso_time(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd HH:mm:ss")


def pad(value: Column | str, width: int) -> Column:
    """Right-pad with blanks; longer text is cut, numbers are accepted."""
    return F.rpad(_col(value).cast("string"), width, " ")


def total(value: Column | str) -> Column:
    return F.sum(_col(value)).cast(TOTAL)


def ratio(amount: Column, count: Column) -> Column:
    """amount / count rounded half up to cents, on decimals throughout."""
    return F.round(amount.cast(TOTAL) / count, 2).cast(AVERAGE)


def average(value: Column | str) -> Column:
    return ratio(F.sum(_col(value)), F.count(_col(value)))


def low_stock() -> Column:
    return F.col("Quantity") < F.col("Restock_Level")


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(_col(value), F.lit(""))
