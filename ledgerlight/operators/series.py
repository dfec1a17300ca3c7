"""Time series: as-of joins, changes, anchored windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import numbered


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the last right row of its key at or before it.

    Both sides are one stream ordered by time, so each side is read once and no range
    join is made; right rows stand before left rows of the same time.
    """
    r = right.select(*keys, at, F.struct(*values).alias("__seen"), F.lit(0).alias("__side"))
    rest = [c for c in left.columns if c not in (*keys, at)]
    tagged = left.select(*keys, at, F.struct(*rest).alias("__own") if rest else F.lit(None).alias("__own"), F.lit(1).alias("__side"))
    both = tagged.unionByName(r, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__last", F.last("__seen", ignorenulls=True).over(order)).where("__side = 1")
    return out.select(*keys, at, *[F.col(f"__own.{c}").alias(c) for c in rest], *[F.col(f"__last.{v}").alias(v) for v in values])


def changes(df: DataFrame, keys: Sequence[str], value: str, *order: str) -> DataFrame:
    """``previous`` and ``change_pct`` beside each row that has a predecessor with a value other than zero."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("previous", F.lag(value).over(w))
    return out.where("previous <> 0").withColumn("change_pct", (F.col(value) - F.col("previous")) / F.col("previous") * 100)


def with_anchor(df: DataFrame, keys: Sequence[str], at: str, since: Column) -> DataFrame:
    """Rows since a time, and the last one before it."""
    before = F.max(F.when(F.col(at) < since, F.col(at))).over(Window.partitionBy(*keys))
    return df.withColumn("__anchor", before).where((F.col(at) >= since) | (F.col(at) == F.col("__anchor"))).drop("__anchor")


def change_points(df: DataFrame, keys: Sequence[str], content: Sequence[str], *order: str) -> DataFrame:
    """Runs of equal content as one row with ``first_at``, ``last_ok_at`` and ``checks``.

    Rows are sorted once; then only the ends of runs stay, and each first row looks at
    the last one behind it. Runs are nearly as many as rows, so no table of them is held.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    now, at = F.struct(*content), order[0]
    marked = df.select(
        *dict.fromkeys([*keys, *content, *order]), F.row_number().over(w).alias("__place"), F.min(at).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__least"),
        (~now.eqNullSafe(F.lag(now).over(w))).alias("__first"), (~now.eqNullSafe(F.lead(now).over(w))).alias("__last"),
    )
    edges = marked.where("__first OR __last")
    last_at = F.when(F.col("__last"), F.col(at)).otherwise(F.lead(at).over(w))
    checks = F.when(F.col("__last"), 1).otherwise(F.lead("__place").over(w) - F.col("__place") + 1).cast("long")
    runs = edges.withColumns({"last_ok_at": last_at, "checks": checks}).where("__first")
    # rows without a time come first: a run that begins there has the key's first time, if any
    first_at = F.coalesce(F.col(at), F.when(F.col("last_ok_at").isNotNull(), F.col("__least")))
    return runs.select(*keys, *content, first_at.alias("first_at"), "last_ok_at", "checks")


def spread(df: DataFrame, keys: Sequence[str], batch: int, spacing: int, *order: str) -> DataFrame:
    """Seconds to wait so that a batch starts every ``spacing`` seconds."""
    return numbered(df, keys, *order).withColumn("delay", (F.floor((F.col("place") - 1) / batch) * spacing).cast("long")).select(*df.columns, "delay")


def leading_streak(df: DataFrame, keys: Sequence[str], failed: Column, *newest: Column) -> DataFrame:
    """Failures in a row from the newest one on."""
    w = Window.partitionBy(*keys).orderBy(*newest).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__broken", F.sum((~failed).cast("int")).over(w)).groupBy(*keys).agg(F.count_if(F.col("__broken") == 0).alias("streak"))
