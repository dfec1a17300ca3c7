"""A Merkle manifest of a dataset by lag and lead windows.

Every row is a leaf: the SHA-256 of its columns, each spelled with its length. The
leaves of a group, in order, are hashed ``fanout`` at a time, level by level, to the
group's subroot; the subroots, in the order of their groups, likewise to the root.

Nodes are numbered from 0 in their group, so a block of ``fanout ** k`` consecutive
places is a subtree. Its levels are windows over one partitioning by group and
block: at each level the first row of a node holds its digest, lag and lead at that
level's fixed offset see the digests beside it, the slot in the run masks the lags,
the length of the run masks the leads, and first-child rows hash the parents. What a
row's ancestors had beside them is carried from their first rows. The blocks' top
nodes are the next tier's rows, and so on until each group has one node. No task
holds more than some blocks of a group, whatever the group's size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Workspace

#: Nodes of a group that one window partition holds at most.
BLOCK = 1024


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def spelled(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon and value (integers decimal)."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return digest(*[spelled(v) for v in values])


def placed(work: Workspace, rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` (with ``grp``, never null) with ``pos``, from 0 in its group by ``order``, and ``n``, the group's size; written.

    Rows are cut into ranges of (grp, order); a row's place is its place in the range
    and what the group has in earlier ranges, a number for each range. Rows that tie
    are told apart by where they were read, so that no value is a range of its own.
    """
    ranged = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange("grp", *order, "__tie").sortWithinPartitions("grp", *order, "__tie")
    ranged = work.put(ranged.drop("__tie").withColumn("__id", F.monotonically_increasing_id()), f"{name}-ranged")
    ranged = ranged.withColumn("__part", F.shiftright("__id", 33))
    sizes = ranged.groupBy("grp", "__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = Window.partitionBy("grp").orderBy("__part")  # a row for each range that the group reaches
    sizes = sizes.select("grp", "__part", (F.sum("__n").over(before) - F.col("__n") - F.col("__first")).alias("__shift"), F.sum("__n").over(Window.partitionBy("grp")).alias("n"))
    joined = ranged.join(sizes, ["grp", "__part"]).withColumn("pos", F.col("__id") + F.col("__shift"))
    return joined.select(*[c for c in rows.columns], "pos", "n")


def _levels(fanout: int) -> int:
    """Levels of a block: the most for which it has at most BLOCK places, and one at least."""
    k = 1
    while fanout ** (k + 1) <= BLOCK:
        k += 1
    return k


def _tier(nodes: DataFrame, fanout: int) -> DataFrame:
    """Of ``grp, pos, n, node``: ``block``, ``top`` (at a block's first row) and ``path``: what stood left and right of the row's ancestors, from below."""
    levels = _levels(fanout)
    size = fanout**levels
    seen = nodes.withColumn("block", F.floor(F.col("pos") / size).cast("long")).withColumn("__d0", F.col("node"))
    row = Window.partitionBy("grp", "block").orderBy("pos")
    for k in range(levels):
        span = fanout**k
        own = F.col(f"__d{k}")
        beside = {f"__lag{j}": F.lag(own, j * span).over(row) for j in range(1, fanout)} | {f"__lead{j}": F.lead(own, j * span).over(row) for j in range(1, fanout)}
        seen = seen.withColumns(beside)
        place = F.floor(F.col("pos") / span)
        slot = (place % fanout).cast("int")
        count = F.ceil(F.col("n") / span)  # nodes of the group at this level
        run = F.least(F.lit(fanout), count - (place - slot)).cast("int")
        first = F.col("pos") % span == 0
        live = first & (count > 1)
        lags = F.concat(*[F.when(slot >= j, F.col(f"__lag{j}")).otherwise("") for j in range(fanout - 1, 0, -1)])
        leads = F.concat(*[F.when(slot + j < run, F.col(f"__lead{j}")).otherwise("") for j in range(1, fanout)])
        parent = F.when(F.col("pos") % (span * fanout) == 0, F.when(count > 1, digest(own, leads)).otherwise(own))
        seen = seen.withColumns({f"__s{k}": F.when(live, F.struct(lags.alias("left"), leads.alias("right"))), f"__d{k + 1}": parent}).drop(*beside)
    upto = row.rowsBetween(Window.unboundedPreceding, 0)
    carried = F.array(*[F.last(f"__s{k}", ignorenulls=True).over(upto) for k in range(levels)])
    seen = seen.withColumns({"path": F.filter(carried, lambda s: s.isNotNull()), "top": F.col(f"__d{levels}")})
    return seen.drop(*[f"__d{k}" for k in range(levels + 1)], *[f"__s{k}" for k in range(levels)])


def _climb(work: Workspace, nodes: DataFrame, fanout: int, name: str) -> DataFrame:
    """``nodes`` (``grp, pos, n, node`` and more) with ``subroot`` and the whole ``path`` to it.

    Tiers are written; paths are handed down again from the last tier, by blocks.
    """
    size = fanout ** _levels(fanout)
    tiers = [work.put(_tier(nodes, fanout), f"{name}-tier")]
    while tiers[-1].agg(F.max("n")).first()[0] or 0:
        if tiers[-1].where(F.col("n") > size).limit(1).isEmpty():
            break
        tops = tiers[-1].where(F.col("pos") % size == 0)
        up = tops.select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("top").alias("node"))
        tiers.append(work.put(_tier(up, fanout), f"{name}-tier"))
    tops = tiers[-1].where("pos = 0").select("grp", F.col("top").alias("subroot"))
    done = tiers[-1].join(tops, "grp")
    for lower in reversed(tiers[:-1]):
        upper = done.select("grp", F.col("pos").alias("block"), F.col("path").alias("__rest"), "subroot")
        done = lower.join(upper, ["grp", "block"]).withColumn("path", F.concat("path", "__rest")).drop("__rest")
    return done.drop("block", "top", "n", "pos")


def manifest(docs: DataFrame, columns: Sequence[str], group: str, order: str, now: Mapping[str, Column] | None = None, fanout: int = 2) -> DataFrame:
    """A row for each row of ``docs``: ``order`` column, ``leaf, subroot, root, path, proof_sha256, folded_root, verified``.

    ``columns`` make the leaf; leaves of one value of ``group`` ascend by ``order`` (nulls
    first; rows that share it by leaf), groups by UTF-8 bytes, null first. ``path`` lists
    what stood left and right of the row's node at each level up to the root, empty
    where a run was shorter. ``now`` gives columns of the copy to verify as they stand
    there; its leaf, folded along the path, gives ``folded_root``, which ``verified``
    compares with the root.

    Repeated rows have leaves of their own. Columns of other names are ignored; an empty
    table gives an empty result.
    """
    if fanout < 2:
        raise ValueError("a node needs two children at least")
    spark, now = docs.sparkSession, dict(now or {})
    work = Workspace(spark, "merkle")
    col = {c: docs[f"`{c}`"] for c in {*columns, group, order}}
    was = leaf([col[c] for c in columns])
    # a leaf is made anew only where a column differs
    same = F.lit(True)
    for c, value in now.items():
        same &= value.cast("string").eqNullSafe(col[c].cast("string"))
    present = F.when(same, F.lit(None)).otherwise(leaf([now.get(c, col[c]) for c in columns])) if now else F.lit(None).cast("string")
    key = F.coalesce(F.concat(F.lit("="), col[group].cast("string")), F.lit(""))
    leaves = work.put(docs.select(key.alias("grp"), col[order].alias("at"), was.alias("node"), present.alias("present")), "leaves")
    leaves = _climb(work, placed(work, leaves, ("at", "node"), "leaves"), fanout, "leaves")
    roots = work.put(leaves.groupBy("grp").agg(F.first("subroot").alias("subroot")), "subroots")
    tops = placed(work, roots.select(F.lit("").alias("grp"), F.col("grp").alias("member"), F.col("subroot").alias("node")), ("member",), "groups")
    tops = _climb(work, tops, fanout, "groups").select(F.col("member").alias("grp"), F.col("subroot").alias("root"), F.col("path").alias("__above"))
    joined = leaves.join(tops, "grp").withColumn("path", F.concat("path", "__above"))
    beside = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("path", F.coalesce("present", "node"), lambda d, s: digest(s["left"], d, s["right"]))
    out = joined.select(F.col("at").alias(order), F.col("node").alias("leaf"), "subroot", "root", "path", digest(beside).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
