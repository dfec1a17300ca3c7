"""Product codes: GTIN check digits and lens calibres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_digit_ok(code: Column) -> Column:
    """F-GTIN: whether a digit string ends in its mod-10 check digit (weights 3 and 1 from the right)."""
    digits = F.transform(F.split(F.reverse(code), ""), lambda d: d.try_cast("int"))
    total = F.aggregate(F.transform(digits, lambda d, i: d * F.when(i % 2 == 1, 3).otherwise(1)), F.lit(0), lambda a, x: a + x)
    return F.coalesce(code.rlike("^[0-9]+$") & (total % 10 == 0), F.lit(False))


def normalize_gtin(c: Column, lengths: tuple[int, ...] = (12, 13)) -> Column:
    """F-GTIN: a valid code of one of the lengths as 13 digits, else NULL."""
    code = F.trim(c)
    return F.when(F.length(code).isin(*lengths) & check_digit_ok(code), F.lpad(code, 13, "0"))


def normalize_caliber(c: Column) -> Column:
    """``54□21``, ``54-21``, ``54/21`` and ``54 21`` as ``54-21``."""
    pattern = r"(?<![0-9])([0-9]{2})\s*[□×xX/\-\s]\s*([0-9]{2})(?![0-9])"
    lens, bridge = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
    return F.when(lens != "", F.concat_ws("-", lens, bridge))


def plausible_caliber(caliber: Column) -> Column:
    """a lens of 38 to 66 and a bridge of 10 to 26, else NULL."""
    lens, bridge = F.split(caliber, "-")[0].try_cast("int"), F.split(caliber, "-")[1].try_cast("int")
    return F.when(lens.between(38, 66) & bridge.between(10, 26), caliber)


def lens_or_caliber(c: Column) -> Column:
    """a calibre, or a lens alone (``63``)."""
    return F.coalesce(normalize_caliber(c), F.when(F.trim(c).rlike("^[0-9]{2}$"), F.trim(c)))


def caliber_of_code(c: Column) -> Column:
    """the calibre at the end of a maker's code such as ``0PR_27ZS16K08Z5421``, if it is plausible."""
    digits = F.regexp_extract(F.upper(F.trim(c)), "^0?[A-Z]{1,4}_[A-Z0-9]+?([0-9]{4})$", 1)
    return F.when(digits != "", plausible_caliber(F.concat_ws("-", F.substring(digits, 1, 2), F.substring(digits, 3, 2))))


def compare_calibers(a: Column, b: Column) -> Column:
    """equal, different, or unknown if either is missing; a lens alone is compared with the other's lens."""
    lens = lambda c: F.split_part(c, F.lit("-"), F.lit(1))
    bridge = lambda c: F.split_part(c, F.lit("-"), F.lit(2))
    differ = (lens(a) != lens(b)) | ((bridge(a) != "") & (bridge(b) != "") & (bridge(a) != bridge(b)))
    return F.when(a.isNull() | b.isNull(), "unknown").when(differ, "different").otherwise("equal")


def with_check_digit(body: Column) -> Column:
    """A code of twelve digits with its check digit behind it."""
    total = F.aggregate(F.transform(F.split(body, ""), lambda d, i: d.try_cast("int") * F.when(i % 2 == 1, 3).otherwise(1)), F.lit(0), lambda a, x: a + x)
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))
