"""Labelled rows for the classifiers: which may be learnt from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % divisor


def sample(labels: DataFrame, label_col: str, divisor: int, held_out: int, most: int) -> DataFrame:
    """``doc_id, label`` of at most ``most`` rows that are not held out, chosen by a hash of the id.

    A label other than 0 or 1 and a null id drop out; an id labelled twice has its
    larger label. The choice doesn't depend on how the table is split.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1) & (remainder("doc_id", divisor) != held_out))
    return rows.groupBy("doc_id").agg(F.max(label_col).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
