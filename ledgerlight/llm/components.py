"""Connected components of an edge table, by alternating star contraction.

Each round replaces a node's larger neighbours by links to its smallest
neighbour, then does the same for the smaller ones. Both are a grouped minimum
and a join on tables that were written first, so a hub with very many edges is
pre-aggregated in the groups and split by Spark in the joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace

#: Edges that one task takes.
TASK_EDGES = 500_000


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1] or 0)


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """``node, component`` (the smallest node reachable) for all nodes of ``edges``.

    ``edges`` has long columns ``u`` and ``v``. Nulls and self-links are dropped;
    repeated and two-way edges count once. An empty table gives an empty table.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = work.put(pairs.distinct(), "edges")
    seen = _signature(now)
    # no later table has more than twice as many rows
    tasks = max(8, seen[0] // TASK_EDGES)
    put = lambda df, name: work.put(df.coalesce(tasks), name)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = put(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")
        large = both.where("v > u").join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        grown = put(large.distinct(), "large")
        lowest_of_smaller = put(grown.groupBy("u").agg(F.min("v").alias("m")), "smaller")
        small = grown.join(lowest_of_smaller, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = lowest_of_smaller.select("u", F.col("m").alias("v"))
        after = put(small.unionByName(links).distinct(), "edges")
        for old in (now, lowest, grown, lowest_of_smaller):
            work.drop(old)
        now, last = after, seen
        seen = _signature(now)
        if seen == last:
            break
    tails = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    heads = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return tails.unionByName(heads).groupBy("node").agg(F.min("component").alias("component"))
