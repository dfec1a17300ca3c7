"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function orders all shingles; a document's sketch is its ``k`` smallest
hashes. Two sets with Jaccard similarity s share each of the k smallest hashes of
their union with probability s, so at 0.85 fewer than ``OVERLAP`` of 32 common
ones has a probability below 1e-7. That gives:

* *inverted lists*: any linked pair shares ``OVERLAP`` retained values, hence one
  of the rarest ``k - OVERLAP + 1`` of either sketch. Only those are listed, so
  passages that many documents share make no lists unless they are most of a text.
* *union-sketch estimate*: of the k smallest hashes of both sketches, at least
  ``OVERLAP`` must be common, or the pair is dropped.
* *exact check*: Jaccard of the full sets, for every pair that is left.

A list isn't expanded into pairs. Its most central member (largest mean list
length, i.e. the likely original) is compared with the others, and all that link
with it are settled among themselves. What is left is found in two ways, which
together miss no link:

* *Rare shingles.* Counted over all sets still in question, a linked pair shares
  one of the rarest ``n - ceil(s * n) + 1`` shingles of either full set. Those that
  at most ``RARE`` sets have give pairs at once.
* *Common shingles only.* A pair without a rare shingle in common has no more in
  common than the shorter count of its common shingles, which bounds its
  similarity. Edited copies of one original have rare shingles from each edit, so
  in a large group of them few members pass. These meet the members of their
  pivot's group, one side always a member that the pivot doesn't link with, unless
  the sizes or the triangle inequality of the Jaccard distance rule a link out. They
  meet on one of their rarest shingles (which a linked pair shares, as above), or the
  whole group with itself, whichever gives fewer rows.

Copies (equal sets) are one class from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .storage import Workspace, bound_batches, lean
from .wordhash import NON_SPACE, mix, slices, words

#: Sets that share a rare shingle at most.
RARE = 16
#: Rows that a task of a small table takes; the tables' row counts are known when they are dealt.
TASK_ROWS = 50_000


class Shingling(NamedTuple):
    """Words of a shingle, hashes of a sketch, and the similarity of a link as num/den."""

    width: int = 5
    k: int = 32
    num: int = 80
    den: int = 100

    @property
    def overlap(self) -> int:
        """Common hashes of the union sketch that a linked pair has for practical certainty."""
        expect = self.num / self.den * self.k
        spread = (self.k * self.num / self.den * (1 - self.num / self.den)) ** 0.5
        return max(1, int(expect - 6.5 * spread))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle, none without words."""
    a, b = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
    for part in slices(texts):
        w = words(part, NON_SPACE)
        codes, n = w.codes, len(w.codes)
        if n >= width:
            rolled = codes[: n - width + 1].copy()
            for j in range(1, width):
                rolled = mix(rolled * a + codes[j : n - width + 1 + j] * b + np.uint64(j))
        else:
            rolled = codes[:0]
        for i in range(part.n):
            first, last = int(w.bounds[i]), int(w.bounds[i + 1])
            if last - first >= width:
                yield np.unique(rolled[first : last - width + 1])
            elif last > first:
                h = codes[first : first + 1].copy()
                for j in range(1, last - first):
                    h = mix(h * a + codes[first + j : first + j + 1] * b + np.uint64(j))
                yield mix(h + np.uint64(last - first))
            else:
                yield codes[:0]


def _profile(shape: Shingling, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches = [], [], []
            for s in shingle_sets(batch.column(text_col), shape.width):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sketches.append(s[: shape.k].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "sketch"],
            )

    return run


def _sets(shape: Shingling):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [s.tobytes() for s in shingle_sets(batch.column("text"), shape.width)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(made, pa.binary())], names=["rep", "members"])

    return run


def _hashes(value: bytes) -> np.ndarray:
    return np.frombuffer(value, np.uint64)


def _estimated(shape: Shingling):
    """Keep pairs whose union sketch has enough common hashes; sketches that are whole sets are counted out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = _hashes(x), _hashes(y)
                if len(x) < shape.k and len(y) < shape.k:
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(common * shape.den >= shape.num * (len(x) + len(y) - common))
                else:
                    low = np.union1d(x, y)[: shape.k]
                    common = np.isin(low, x, assume_unique=True) & np.isin(low, y, assume_unique=True)
                    keep.append(int(common.sum()) >= shape.overlap)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        common, union = [], []
        for x, y in zip(batch.column("ma"), batch.column("mb"), strict=True):
            x, y = _hashes(x.as_buffer()), _hashes(y.as_buffer())
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            n = int((y[at] == x).sum()) if len(y) else 0
            common.append(n)
            union.append(len(x) + len(y) - n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "common", "total"]
        )


def _listed(profiles: DataFrame, shape: Shingling, work: Workspace) -> DataFrame:
    """``v, rep, n, weight``: for each class the rarest retained values that another class has too."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [_hashes(x) for x in batch.column("sketch").to_pylist()]
            sizes = [len(x) for x in held]
            flat = np.concatenate(held).view(np.int64) if held else np.zeros(0, np.int64)
            take = pa.array(np.repeat(np.arange(len(held)), sizes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat), batch.column("rep").take(take), batch.column("n").take(take), pa.array(np.repeat(np.array(sizes, np.int32), sizes))], names=["v", "rep", "n", "m"]
            )

    rows = profiles.select("rep", F.col("n_shingles").alias("n"), "sketch").mapInArrow(lean(values), "v long, rep long, n long, m int")
    lengths = work.put(rows.groupBy("v").agg(F.count("*").alias("f")).where("f > 1"), "lengths")
    full = F.ceil(F.col("m") * shape.num / shape.den)
    # a sketch that may stand beside a longer set's sketch answers for the common hashes of that one
    need = F.when(F.col("m") * shape.den < shape.num * shape.k, full).otherwise(F.lit(shape.overlap))
    per = Window.partitionBy("rep")
    ranked = (
        rows.join(lengths, "v")
        .withColumn("shared", F.count("*").over(per))
        .withColumn("weight", F.sum("f").over(per) / F.col("m"))
        .withColumn("place", F.row_number().over(per.orderBy("f", "v")))
    )
    room = F.col("m") - need + 1 - (F.col("m") - F.col("shared"))
    kept = ranked.where(F.col("place") <= room).select("v", "rep", "n", "weight")
    return work.put(kept, "lists")


def _pairs_checked(pairs: DataFrame, profiles: DataFrame, sets: DataFrame, shape: Shingling, work: Workspace, tasks: int) -> DataFrame:
    """``a, b, common, total`` of the distinct pairs that the union sketch lets through."""
    pairs = work.put(pairs.coalesce(tasks), "pairs")
    sketch = profiles.select("rep", "sketch")
    both = pairs.join(sketch.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a").join(sketch.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
    likely = work.put(both.coalesce(2 * tasks).mapInArrow(lean(_estimated(shape)), "a long, b long"), "likely")
    held = likely.join(sets.select(F.col("rep").alias("a"), F.col("members").alias("ma")), "a").join(sets.select(F.col("rep").alias("b"), F.col("members").alias("mb")), "b")
    return work.put(held.coalesce(2 * tasks).mapInArrow(lean(_jaccard), "a long, b long, common long, total long"), "checked")


def _similar_size(shape: Shingling, n: str, m: str) -> Column:
    return F.least(n, m) * shape.den >= F.greatest(n, m) * shape.num


def _shared_shingles(sets: DataFrame, members: DataFrame) -> DataFrame:
    """``h, f, rep, n`` of the shingles that more than one set of ``members`` (``rep, n``) has."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [_hashes(x).view(np.int64) for x in batch.column("members").to_pylist()]
            take = pa.array(np.repeat(np.arange(len(held)), [len(x) for x in held]))
            flat = np.concatenate(held) if held else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), batch.column("rep").take(take), batch.column("n").take(take)], names=["h", "rep", "n"])

    rows = sets.join(members, "rep").select("rep", "n", "members").mapInArrow(lean(hashes), "h long, rep long, n long")
    return rows.join(rows.groupBy("h").agg(F.count("*").alias("f")).where("f > 1"), "h")


def near_duplicates(docs: DataFrame, shape: Shingling = Shingling(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Words are runs of anything but ASCII white space, A-Z taken as a-z. A text with
    fewer words than a shingle is one shingle; an empty or null text has none and
    links with nothing. Linked: common * den >= num * union of the full sets.
    ``component_id`` is the smallest id reachable by links; rows that repeat an id
    share a component. A row with a null id has a null component and is kept. An
    empty table gives an empty table; other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    work = Workspace(spark, "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = work.put(texts.mapInArrow(lean(_profile(shape, "doc_id", "text")), "doc_id long, n_shingles long, digest binary, sketch binary"), "profiles")

    # classes of equal sets; the smallest id stands for each
    some = made.where("digest is not null and doc_id is not null")
    classes = work.put(some.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    chosen = some.join(classes.withColumnRenamed("rep", "doc_id"), ["digest", "doc_id"]).dropDuplicates(["digest"])
    profiles = work.put(chosen.select(F.col("doc_id").alias("rep"), "n_shingles", "sketch"), "reps")
    several = some.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("doc_id")
    repeats = some.join(several, "doc_id", "left_semi").join(classes, "digest").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))

    links = _links(profiles, texts, shape, work).unionByName(repeats)
    grouped = work.put(components(links, work), "components")
    named = work.put(classes.join(grouped, classes.rep == grouped.node, "left").select("digest", F.coalesce("component", "rep").alias("component_id")), "named")
    out = made.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, shape: Shingling = Shingling()) -> DataFrame:
    """``docs`` with one document of each component (the smallest id), all columns kept.

    Of rows that repeat an id one stays; rows with a null id all stay.
    """
    work = Workspace(docs.sparkSession, "minhash-kept")
    found = near_duplicates(docs, shape)
    found = work.put(found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n")), "found")
    # written first, so that Spark knows their sizes and moves the texts only for lists too long to broadcast
    gone = work.put(found.where("not kept or n > 1").select("doc_id"), "gone")
    repeated = work.put(found.where("kept and n > 1").select("doc_id"), "repeated")
    single = docs.join(gone, "doc_id", "left_anti")
    chosen = docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return single.unionByName(chosen).select(*docs.columns)


def _links(profiles: DataFrame, texts: DataFrame, shape: Shingling, work: Workspace) -> DataFrame:
    """``u, v``: links that connect all that is connected; not all pairs of a group."""
    lists = _listed(profiles, shape, work)
    tasks = max(8, lists.count() // TASK_ROWS)
    wanted = work.put(lists.select("rep").distinct().coalesce(tasks), "wanted")
    bodies = texts.join(wanted, texts.doc_id == wanted.rep, "left_semi").select(F.col("doc_id").alias("rep"), "text")
    sets = work.put(bodies.mapInArrow(lean(_sets(shape)), "rep long, members binary"), "sets")

    best = F.max(F.struct("weight", (-F.col("rep")).alias("minus"), "n")).alias("p")
    parts = lists.groupBy("v").agg(best, F.count("*").alias("f")).where("f > 1")
    pivots = parts.select("v", (-F.col("p.minus")).alias("pivot"), F.col("p.weight").alias("pivot_weight"), F.col("p.n").alias("pivot_n"))
    pivots = work.put(pivots.coalesce(tasks), "pivots")
    near = lists.join(pivots, "v").where((F.col("rep") != F.col("pivot")) & _similar_size(shape, "n", "pivot_n"))
    pairs = near.select(F.greatest("rep", "pivot").alias("a"), F.least("rep", "pivot").alias("b")).distinct()
    checked = _pairs_checked(pairs, profiles, sets, shape, work, tasks)
    link = F.col("common") * shape.den >= F.col("total") * shape.num
    first = checked.where(link).select(F.col("a").alias("u"), F.col("b").alias("v"))

    # a member is settled in a list if it and the pivot link with one and the same set, be it the pivot
    both = checked.select("a", "b", "common", "total").unionByName(checked.select(F.col("b").alias("a"), F.col("a").alias("b"), "common", "total"))
    both = both.select(F.col("a").alias("rep"), F.col("b").alias("pivot"), (1 - F.col("common") / F.col("total")).alias("gap"), link.alias("linked"))
    gaps = work.put(both.groupBy("rep", "pivot").agg(F.min("gap").alias("gap"), F.bool_or("linked").alias("linked")).coalesce(tasks), "gaps")
    weights = lists.groupBy("rep").agg(F.max("weight").alias("weight"))
    hubs = gaps.where("linked").select("rep", "pivot").join(weights.withColumnRenamed("rep", "pivot"), "pivot").select("rep", "weight", (-F.col("pivot")).alias("minus"))
    own = weights.select("rep", "weight", (-F.col("rep")).alias("minus")).unionByName(hubs).groupBy("rep").agg(F.max(F.struct("weight", "minus")).alias("h"))
    labels = work.put(own.select("rep", (-F.col("h.minus")).alias("label")).coalesce(tasks), "labels")

    # what stands in lists of one pivot is one group from here on
    rest = lists.join(pivots.select("v", "pivot"), "v").where("rep <> pivot").select("pivot", "rep", "n").distinct().join(labels, "rep")
    rest = rest.join(labels.withColumnsRenamed({"rep": "pivot", "label": "pivot_label"}), "pivot").join(gaps.select("rep", "pivot", "gap"), ["rep", "pivot"], "left")
    rest = work.put(rest.select("pivot", "rep", "n", "label", (F.col("label") != F.col("pivot_label")).alias("open"), "gap").coalesce(tasks), "rest")
    mixed = rest.groupBy("pivot").agg(F.bool_or("open").alias("open"), F.count("*").alias("f")).where("open and f > 1").select("pivot")
    state = work.put(rest.join(mixed, "pivot").coalesce(tasks), "state")

    members = work.put(state.select("rep", "n", "label").distinct().coalesce(tasks), "members")
    per = Window.partitionBy("rep")
    shared = _shared_shingles(sets, members.select("rep", "n")).withColumn("shared", F.count("*").over(per))
    shared = shared.withColumn("common", F.count_if(F.col("f") > RARE).over(per)).withColumn("place", F.row_number().over(per.orderBy("f", "h")))
    need = F.ceil(F.col("n") * shape.num / shape.den)
    first_ones = F.col("place") <= F.col("shared") - need + 1
    rare = (F.col("f") <= RARE) & first_ones
    able = F.col("common") >= need  # shingles that are common enough to link by them alone
    marked = shared.where(rare | (first_ones & able) | (F.col("place") == 1)).select("h", rare.alias("rare"), (first_ones & ~rare & able).alias("often"), "rep", "common", able.alias("able"))
    marked = work.put(marked.coalesce(4 * tasks), "marked")
    rows = marked.where("rare").select("h", "rep").join(members, "rep")
    other = rows.select("h", *[F.col(c).alias(f"{c}2") for c in ("rep", "n", "label")])
    alike = rows.join(other, "h").where((F.col("rep") > F.col("rep2")) & (F.col("label") != F.col("label2")) & _similar_size(shape, "n", "n2"))
    pairs = alike.select(F.col("rep").alias("a"), F.col("rep2").alias("b"))

    # sets with common shingles enough meet within their pivot's group, and there only on one of their rarest
    # shingles where that gives fewer rows than the whole group with itself
    able = work.put(state.join(marked.where("able").select("rep", "common").distinct(), "rep").coalesce(tasks), "able")
    keyed = work.put(able.join(marked.where("often").select("rep", "h"), "rep").coalesce(4 * tasks), "keyed")
    square = lambda name: F.sum(F.col("f") * F.col("f")).alias(name)
    whole = able.groupBy("pivot").agg(F.count("*").alias("f")).groupBy("pivot").agg(square("whole"))
    split = keyed.groupBy("pivot", "h").agg(F.count("*").alias("f")).groupBy("pivot").agg(square("split"))
    ways = work.put(whole.join(split, "pivot", "left").select("pivot", (F.coalesce("split", F.lit(0)) < F.col("whole")).alias("by_key")), "ways")

    def meet(rows: DataFrame, by_key: bool, *on: str) -> DataFrame:
        rows = rows.join(ways.where(F.col("by_key") == by_key).select("pivot"), "pivot", "left_semi")
        other = rows.select(*on, *[F.col(c).alias(f"{c}2") for c in ("rep", "n", "label", "gap", "common")])
        apart = F.abs(F.col("gap") - F.col("gap2")) > 1 - shape.num / shape.den + 1e-9
        enough = F.least("common", "common2") * (shape.num + shape.den) >= (F.col("n") + F.col("n2")) * shape.num
        met = rows.where("open").join(other, list(on)).where(
            (F.col("rep") != F.col("rep2")) & (F.col("label") != F.col("label2")) & _similar_size(shape, "n", "n2") & enough & ~F.coalesce(apart, F.lit(False))
        )
        return met.select(F.greatest("rep", "rep2").alias("a"), F.least("rep", "rep2").alias("b"))

    pairs = pairs.unionByName(meet(able, False, "pivot")).unionByName(meet(keyed, True, "pivot", "h")).distinct()
    last = _pairs_checked(pairs, profiles, sets, shape, work, tasks)
    return first.unionByName(last.where(link).select(F.col("a").alias("u"), F.col("b").alias("v")))
