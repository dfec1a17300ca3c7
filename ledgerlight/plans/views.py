"""The retail tables as views of the test tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import Tables

#: The time that queries take for now: the day after the last row.
NOW = "2001-11-05 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def products(t: Tables) -> DataFrame:
    return t.part.select(
        F.lpad(F.col("p_partkey").cast("string"), 13, "0").alias("ean"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"),
        F.col("p_type").alias("category"), F.col("p_size").cast("double").alias("stock"), F.col("p_retailprice").alias("own_price"),
    )


PRODUCTS = "products AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 13, '0') AS ean, p_brand AS brand, p_name AS name, p_type AS category, CAST(p_size AS DOUBLE) AS stock, p_retailprice AS own_price FROM part)"


def offers(t: Tables) -> DataFrame:
    """One offer a line: R lines are unavailable, F lines are exact matches, a tax above 0.06 leaves the VAT unknown."""
    vat = F.when(F.col("l_tax") <= 0.06, F.lit(True))
    return t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lpad(F.col("l_partkey").cast("string"), 13, "0").alias("ean"),
        F.col("l_suppkey").alias("competitor_id"), (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100.0).alias("price"),
        F.col("l_shipdate").alias("captured_at"), (F.col("l_returnflag") != "R").alias("available"), (F.col("l_linestatus") == "F").alias("exact"),
        vat.alias("vat"), F.col("l_discount").alias("discount"),
    )


OFFERS = """offers AS (SELECT l_orderkey * 10 + l_linenumber AS id, lpad(CAST(l_partkey AS VARCHAR), 13, '0') AS ean, l_suppkey AS competitor_id,
  floor(l_extendedprice / l_quantity * 100 + 0.5) / 100.0 AS price, l_shipdate AS captured_at, l_returnflag <> 'R' AS available, l_linestatus = 'F' AS exact,
  CASE WHEN l_tax <= 0.06 THEN true END AS vat, l_discount AS discount FROM lineitem)"""


def moves(t: Tables) -> DataFrame:
    """Lines as stock moves: R is an entry, A an exit, N any other move."""
    kind = F.when(F.col("l_returnflag") == "R", "entry").when(F.col("l_returnflag") == "A", "exit").otherwise("other")
    return t.lineitem.select(
        F.col("l_partkey").alias("product"), F.col("l_shipdate").alias("moved_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("move_id"),
        kind.alias("kind"), F.col("l_quantity").alias("qty"), F.col("l_suppkey").alias("location"),
    )


MOVES = """moves AS (SELECT l_partkey AS product, l_shipdate AS moved_at, l_orderkey * 10 + l_linenumber AS move_id,
  CASE l_returnflag WHEN 'R' THEN 'entry' WHEN 'A' THEN 'exit' ELSE 'other' END AS kind, l_quantity AS qty, l_suppkey AS location FROM lineitem)"""
