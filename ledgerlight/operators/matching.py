"""Edges of a bipartite graph, counted without listing them."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _all_known(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= F.col(k).isNotNull()
    return out


def _told(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= F.coalesce(F.col(k) != "", F.lit(False))
    return out


def conditioned_degrees(left: DataFrame, right: DataFrame, always: Sequence[str], either: Sequence[str], carry: Column) -> DataFrame:
    """``left`` with ``edges``, the number of its edges to ``right``, and ``other``, the ``carry`` of the one at its end if there is one alone.

    An edge joins rows that agree on all columns of ``always`` (NULL agrees with nothing)
    and on one of ``either`` at least, where NULL and empty text agree with nothing.
    Rows of ``right`` are counted by each set of ``either`` columns, and inclusion and
    exclusion over the sets gives the edges; no pair is made, so a key that many rows
    share costs as much as any other. ``other`` is NULL where there are no edges or more than one.
    """
    out, edges, others = left, F.lit(0).cast("long"), []
    for size in range(1, len(either) + 1):
        for chosen in itertools.combinations(either, size):
            n = f"__{'_'.join(chosen)}"
            # one carry of each set does: it's read only where the set has one row
            counted = right.where(_told(chosen)).groupBy(*always, *chosen).agg(F.count("*").alias(n), F.max(carry).alias(f"{n}_other"))
            out = out.join(counted, [*always, *chosen], "left")
            edges += (-1) ** (size + 1) * F.coalesce(F.col(n), F.lit(0))
            if size == 1:
                others.append(F.when(F.col(n) == 1, F.col(f"{n}_other")))
    out = out.withColumn("edges", edges).withColumn("other", F.when(F.col("edges") == 1, F.coalesce(*others)))
    return out.select(*left.columns, "edges", "other")


def sole_partners(rows: DataFrame, always: Sequence[str], either: Sequence[str], on_left: str, row_id: str, *keep: str) -> DataFrame:
    """``on_left``, ``row_id``, the ``keep`` columns and ``partner``: the row on the other side where one edge joins the two and neither has another.

    ``rows`` holds both sides, told apart by ``on_left``; edges are those of
    ``conditioned_degrees``. Rows of one group (all of ``always`` and one of ``either``)
    are each other's ends, so a row has one partner only if each of its groups with rows
    of both sides holds these two alone. A row moves once for each of ``either`` and
    once to meet its partner.
    """
    left, right = F.col(on_left), ~F.col(on_left)
    known = _all_known(always)
    seen = rows.select(on_left, row_id, *keep, *always, *either, F.lit(True).alias("__sound"), F.lit(None).cast(rows.schema[row_id].dataType).alias("__end"))
    for k in either:
        told = known & _told([k])
        # a row that isn't told is dealt by its id and counts nowhere, so that no task gets all of these
        seen = seen.withColumn("__told", told).withColumn(k, F.when(told, F.col(k)).otherwise(F.col(row_id).cast("string"))).repartition(k, *always)
        group = Window.partitionBy(k, *always)
        ends = {"__l": left, "__r": right}
        seen = seen.withColumns({f"{n}n": F.count_if(F.col("__told") & side).over(group) for n, side in ends.items()} | {f"{n}id": F.max(F.when(F.col("__told") & side, F.col(row_id))).over(group) for n, side in ends.items()})
        linked = F.col("__told") & (F.col("__ln") > 0) & (F.col("__rn") > 0)
        end = F.when(linked, F.when(left, F.col("__rid")).otherwise(F.col("__lid")))
        sound = F.col("__sound") & (~linked | ((F.col("__ln") == 1) & (F.col("__rn") == 1) & F.coalesce(F.coalesce("__end", end) == end, F.lit(False))))
        seen = seen.withColumns({"__sound": sound, "__end": F.coalesce("__end", end)}).drop(k, "__told", "__ln", "__rn", "__lid", "__rid")
    claim = F.when(F.col("__sound"), F.col("__end"))
    claims = seen.select(on_left, row_id, *keep, claim.alias("__end"), F.when(left | claim.isNull(), F.col(row_id)).otherwise(claim).alias("__a"), F.when(left, claim).when(claim.isNotNull(), F.col(row_id)).alias("__b"))
    pair = Window.partitionBy("__a", "__b")
    mutual = F.col("__end").isNotNull() & (F.count_if(left).over(pair) == 1) & (F.count_if(right).over(pair) == 1)
    return claims.withColumn("partner", F.when(mutual, F.col("__end"))).select(on_left, row_id, *keep, "partner")
