"""One row of many per key: latest, first, duplicates, upserts, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def latest_per_key(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """A10: the last row of each key; the order must end in a unique column."""
    return _first(df, keys, [F.col(c).desc_nulls_last() for c in order])


def newest(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """A10 as an aggregate: tasks keep one row of a key before rows are dealt by it. The order must end in a unique column that isn't NULL."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*")


def distinct_on(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The first row of each key."""
    return _first(df, keys, [F.col(c).asc_nulls_last() for c in order])


def flag_duplicates(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """``is_repeat`` on all but the first row of a key, ``is_shared`` on all rows of a repeated key."""
    rows = Window.partitionBy(*keys)
    return df.withColumn("is_repeat", F.row_number().over(rows.orderBy(*order)) > 1).withColumn("is_shared", F.count("*").over(rows) > 1)


def top_per_group(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key with their place ``rn``."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= n)


def unique_or_null(value: str) -> Column:
    """The only distinct value of a group, else NULL."""
    return F.when(F.count_distinct(value) == 1, F.min(value))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], newest: Sequence[str] = ()) -> DataFrame:
    """K6: rows of ``new`` replace those of ``old``; a blank never overwrites, ``newest`` columns keep their maximum."""
    joined = old.alias("o").join(new.alias("n"), list(keys), "full_outer")

    def merged(c: str) -> Column:
        now, was = F.col(f"n.{c}"), F.col(f"o.{c}")
        if c in newest:
            return F.greatest(now, was).alias(c)
        if old.schema[c].dataType.typeName() == "string":
            return F.coalesce(F.nullif(F.trim(now), F.lit("")), was).alias(c)
        return F.coalesce(now, was).alias(c)

    return joined.select(*[F.col(k) for k in keys], *[merged(c) for c in old.columns if c not in keys])


def inner_concat(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Frames side by side for the keys that all of them have."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.join(frame, key)
    return out


def fingerprint(*columns: str) -> Column:
    """A digest of the columns in the order given, NULL and empty apart."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """K7: the rows of ``new`` whose key is in neither ``old`` nor an earlier row of the batch."""
    return new.dropDuplicates([key]).join(old, key, "left_anti")


def retained(df: DataFrame, keys: Sequence[str], at: str, row_id: str, cutoff: Column, referenced: DataFrame) -> DataFrame:
    """Rows since the cutoff, the newest of each key, and whatever ``referenced`` names."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col(row_id).desc()))
    marked = df.withColumn("__place", place)
    named = referenced.select(row_id).distinct().withColumn("__named", F.lit(True))
    return marked.join(named, row_id, "left").where((F.col(at) >= cutoff) | (F.col("__place") == 1) | F.col("__named")).drop("__place", "__named")
