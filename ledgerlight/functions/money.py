"""Prices and amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_price(c: Column) -> Column:
    """M1: ``1.234,56``, ``1,234.56`` and ``239,00 €`` as a double; NULL for anything else.

    The last separator with one or two digits behind it is the decimal one; a single
    separator with three digits behind it separates thousands.
    """
    raw = F.regexp_replace(c, r"[^0-9.,]", "")
    comma = raw.rlike(r",[0-9]{1,2}$")
    plain = F.when(comma, F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(raw, F.lit(","), F.lit("")))
    plain = F.when(~comma & plain.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+$"), F.replace(plain, F.lit("."), F.lit(""))).otherwise(plain)
    return plain.try_cast("double")


def money(c: Column) -> Column:
    """M2: an exact amount; a comma is the decimal sign, thousands separators are refused."""
    text = F.trim(c)
    text = F.when(text.contains(".") & text.contains(","), None).otherwise(F.replace(text, F.lit(","), F.lit(".")))
    return F.when(text.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), text).try_cast("decimal(38,6)")


def decimal_text(c: Column) -> Column:
    """M3: plain digits with two decimals at least."""
    text = F.regexp_replace(c.cast("decimal(38,6)").cast("string"), "0+$", "")
    decimals = F.length(F.substring_index(text, ".", -1))
    return F.when(decimals >= 2, text).otherwise(F.concat(text, F.repeat(F.lit("0"), 2 - decimals)))


def half_up(c: Column, step: str = "0.01") -> Column:
    """M4: a decimal rounded half up to a multiple of the step."""
    unit = F.lit(step).cast("decimal(18,4)")
    return (F.round((c.cast("decimal(18,4)") / unit).cast("decimal(18,6)"), 0) * unit).cast("decimal(18,4)")


def percent(part: Column, whole: Column) -> Column:
    """M5: part as a percentage of whole; NULL where whole is zero."""
    return F.try_divide(part, whole) * 100


def effective_eur(price: Column, promotional: Column, fx: Column) -> Column:
    """M6."""
    return F.coalesce(promotional, price) * fx


def infer_vat(price: Column, pretax: Column) -> Column:
    """M7: 21, 10 or 4 where the ratio is within 0.3 % of that rate's factor."""
    ratio = F.try_divide(price, pretax)
    out = F.lit(None).cast("int")
    for rate in (4, 10, 21):
        out = F.when(F.abs(ratio / (1 + rate / 100) - 1) <= 0.003, F.lit(rate)).otherwise(out)
    return out


def backoff_seconds(attempts: Column) -> Column:
    """A minute, doubled with each attempt, an hour at most."""
    return F.least(F.lit(60.0) * F.pow(F.lit(2.0), attempts), F.lit(3600.0)).cast("int")
