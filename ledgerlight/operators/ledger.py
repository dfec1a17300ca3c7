"""Stock ledgers: running balance and the periods without stock."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_stock(moves: DataFrame) -> DataFrame:
    """``seq`` and ``stock`` after each move, per product.

    ``moves``: product, moved_at, move_id, kind (entry, exit, other), qty. Other moves leave the stock as it is.
    """
    order = Window.partitionBy("product").orderBy("moved_at", "move_id")
    signed = F.when(F.col("kind") == "entry", F.col("qty")).when(F.col("kind") == "exit", -F.col("qty")).otherwise(0.0)
    return moves.withColumn("seq", F.row_number().over(order)).withColumn("stock", F.sum(signed).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def stockout_periods(ledger: DataFrame) -> DataFrame:
    """``product, started_at, ended_at``; an open period has no end.

    A period opens at the first row that leaves no stock and closes at the next
    entry, which opens another one if stock is still missing.
    """
    order = Window.partitionBy("product").orderBy("moved_at", "move_id")
    spell = F.sum((F.col("kind") == "entry").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = ledger.withColumn("spell", spell)
    spells = marked.groupBy("product", "spell").agg(
        F.min(F.when(F.col("kind") == "entry", F.col("moved_at"))).alias("entered_at"), F.min(F.when(F.col("stock") <= 0, F.col("moved_at"))).alias("started_at")
    )
    next_entry = F.lead("entered_at").over(Window.partitionBy("product").orderBy("spell"))
    return spells.withColumn("ended_at", next_entry).where("started_at is not null").select("product", "started_at", "ended_at")


def extremes(ledger: DataFrame) -> DataFrame:
    """Lowest stock with its first date, rows at one unit or less, last stock."""
    return ledger.groupBy("product").agg(
        F.min("stock").alias("least_stock"),
        F.min_by("moved_at", F.struct("stock", "seq")).alias("least_at"),
        F.count_if(F.col("stock") <= 1).alias("critical_rows"),
        F.max_by("stock", "seq").alias("last_stock"),
    )
