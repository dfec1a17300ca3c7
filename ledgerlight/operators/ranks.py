"""Ranks over a whole table or large keys, without one task for all rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stretches that the rows of a key are cut into, and the error of the quantiles that cut them.
STRETCHES, ERROR = 64, 0.002


def exact_percentile(df: DataFrame, column: str, p: float) -> float | None:
    """The linearly interpolated percentile of the values that aren't NULL (None without any).

    Approximate percentiles bound the two values that count; only the distinct values
    between the bounds, some thousandths of the rows, are put in order.
    """
    v = F.col(column).cast("double")
    low, high = (F.percentile_approx(v, F.lit(q), F.lit(10_000)) for q in (max(0.0, p - ERROR), min(1.0, p + ERROR)))
    n, a, b = df.agg(F.count(v), low, high).first()
    if not n:
        return None
    k = (n - 1) * p
    counts = df.where(v.between(a, b)).groupBy(v.alias("v")).agg(F.count("*").alias("n"))
    below = df.where(v < a).count()
    ranked = counts.withColumn("upto", F.sum("n").over(Window.orderBy("v")) + below)  # few values
    found = ranked.agg(*[F.min(F.when(F.col("upto") > r, F.col("v"))) for r in (math.floor(k), math.ceil(k))]).first()
    if below > math.floor(k) or None in found:  # the bounds missed it
        return df.agg(F.percentile(v, F.lit(p))).first()[0]
    return found[0] if math.floor(k) == math.ceil(k) else (math.ceil(k) - k) * found[0] + (k - math.floor(k)) * found[1]


def numbered(df: DataFrame, keys: Sequence[str], first: str, *order: str, weight: Column | None = None) -> DataFrame:
    """``df`` with ``place`` (from 1) within its key by ``first`` and ``order``, and ``running``, the sum of ``weight`` up to the row.

    ``first`` is a number or a time. The rows of a key are cut at quantiles of it into
    stretches, numbered each, and moved on by the sizes of the stretches before; rows
    that share one value of ``first`` stay together.
    """
    at = F.unix_micros(F.col(first).cast("timestamp")) if df.schema[first].dataType.typeName().startswith("timestamp") else F.col(first)
    weight = F.lit(1) if weight is None else weight
    rows = df.withColumn("__at", at.cast("double")).withColumn("__weight", weight)
    cuts = sorted(set(rows.approxQuantile("__at", [i / STRETCHES for i in range(1, STRETCHES)], ERROR)))
    stretch = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.coalesce("__at", F.lit(-math.inf)))) if cuts else F.lit(0)
    rows = rows.withColumn("__stretch", stretch)
    within = Window.partitionBy(*keys, "__stretch").orderBy(first, *order)
    sizes = rows.groupBy(*keys, "__stretch").agg(F.count("*").alias("__n"), F.sum("__weight").alias("__w"))
    before = Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)  # of STRETCHES rows a key
    sizes = sizes.select(*keys, "__stretch", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"), F.coalesce(F.sum("__w").over(before), F.lit(0)).alias("__w"))
    numbered = rows.withColumn("__place", F.row_number().over(within)).withColumn("__sum", F.sum("__weight").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    same = [numbered[k].eqNullSafe(sizes[k]) for k in (*keys, "__stretch")]
    joined = numbered.join(sizes, [*same][0] if len(same) == 1 else _all(same))
    return joined.select(*[numbered[c] for c in df.columns], (F.col("__place") + sizes["__n"]).alias("place"), (F.col("__sum") + sizes["__w"]).alias("running"))


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
