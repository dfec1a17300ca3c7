"""Embedding near-dedup by product quantisation.

Vectors are unit length. A k-means codebook deals them to coarse lists; what is
left of a vector beside its list's centre is coded subspace by subspace, and the
distance to its code is kept. Codebooks are fitted on a bounded sample
(``SAMPLE_ROWS``, or ``PER_LIST`` for each list); every vector is in the index.

A link needs a Euclidean distance of at most ``d = sqrt(2 - 2 cos)``. A query
probes a list if its distance to the hyperplane between that list's centre and its
own nearest one is at most d: no other list can hold a linked vector. In a list,
table lookups give the query's distance to each code; a vector whose code is
farther than d plus the code's own error can't be linked either. So the probes are
sufficient, both tests lose nothing, and what passes is compared by its exact
cosine in double precision.

Equal vectors are one entry with a count. Linked vectors of two lists both probe the
other's list, so for each pair of lists only the members that do so travel, once, in
packs; members of one list are compared among themselves. A pair of lists with very
many members is cut into cells of about ``BLOCK_BYTES`` a side. A cell gives back link
counts and a spanning set of links, made ``QUERIES`` vectors at a time, never the pairs
of a group. Where the vectors have no clusters, the exact bound probes most lists, and
the work grows with the square of their number; each cell is then a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import Workspace, bound_batches, lean

#: Vectors that the codebooks are fitted on: so many, or so many for each list where that is more; rounds of k-means.
SAMPLE_ROWS, PER_LIST, ROUNDS = 8192, 64, 12
#: Vectors that are held against all centres at once.
TOGETHER = 2048
#: Codewords of a subspace, and dimensions that share one.
CODEWORDS, SUBSPACE = 256, 8
#: Bytes of one side of a cell as doubles; a list for each such number of vectors, at most so many lists.
BLOCK_BYTES, MOST_LISTS = 8 << 20, 4096
#: Vectors of a list at least, however long they are.
LEAST_BLOCK = 256
#: Queries that are looked up at once.
QUERIES = 128
#: Slack of the distance bounds for rounding; the cosine itself is exact.
SLACK = 1e-6


class Books(NamedTuple):
    """Coarse centres (lists x dims), residual codewords (subspaces x words x dims of it), and the link cosine."""

    centres: np.ndarray
    words: np.ndarray
    cosine: float

    @property
    def reach(self) -> float:
        return float(np.sqrt(max(0.0, 2 - 2 * self.cosine))) + SLACK


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres of the rows; fewer distinct rows are all centres."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[rng.choice(len(distinct), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, centres)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
    return centres


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin(_squares(x[i : i + TOGETHER], centres), 1) for i in range(0, max(len(x), 1), TOGETHER)])


def fit(sample: np.ndarray, lists: int, cosine: float) -> Books:
    rng = np.random.default_rng(11)
    centres = kmeans(sample, lists, rng)
    rest = sample - centres[_nearest(sample, centres)]
    dims = sample.shape[1]
    step = SUBSPACE if dims % SUBSPACE == 0 else next(s for s in range(min(SUBSPACE, dims), 0, -1) if dims % s == 0)
    words = np.zeros((dims // step, CODEWORDS, step))
    for i in range(dims // step):
        got = kmeans(rest[:, i * step : (i + 1) * step], CODEWORDS, rng)
        words[i] = np.concatenate([got, np.repeat(got[:1], CODEWORDS - len(got), 0)])
    return Books(centres, words, cosine)


def encode(books: Books, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest list, codes of the residual, and the distance from each vector to what its code stands for."""
    near = np.argmin(_squares(x, books.centres), 1)
    rest = x - books.centres[near]
    n, (subspaces, _, step) = len(x), books.words.shape
    codes, error = np.zeros((n, subspaces), np.uint8), np.zeros(n)
    for i in range(subspaces):
        d = _squares(rest[:, i * step : (i + 1) * step], books.words[i])
        codes[:, i] = np.argmin(d, 1)
        error += d[np.arange(n), codes[:, i]]
    return near, codes, np.sqrt(error)


def probes(books: Books, x: np.ndarray) -> np.ndarray:
    """Which lists can hold a vector within reach of each query: a boolean matrix."""
    d = _squares(x, books.centres)
    near = np.argmin(d, 1)
    # distances from the lists that these queries are nearest to, not between all lists
    own, at = np.unique(near, return_inverse=True)
    gaps = np.sqrt(_squares(books.centres[own], books.centres))[at]
    beyond = (d - d[np.arange(len(x)), near][:, None]) / (2 * np.maximum(gaps, 1e-12))
    beyond[np.arange(len(x)), near] = 0
    return beyond <= books.reach


def links(books: Books, queries: np.ndarray, centre: np.ndarray, vectors: np.ndarray, codes: np.ndarray, error: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked (query, vector) positions, of ``QUERIES`` queries at a time: table lookups first, then exact cosines."""
    subspaces, _, step = books.words.shape
    most = ((books.reach + error) ** 2 + 1e-4).astype(np.float32)
    for first in range(0, len(queries), QUERIES):
        x = queries[first : first + QUERIES]
        rest = x - centre
        # asymmetric distances, a table of a query's distances to all codewords for each subspace
        far = np.zeros((len(vectors), len(x)), np.float32)
        for i in range(subspaces):
            far += _squares(books.words[i], rest[:, i * step : (i + 1) * step]).astype(np.float32)[codes[:, i]]
        v, q = np.nonzero(far <= most[:, None])
        keep = np.zeros(len(q), bool)
        for at in range(0, len(q), 1 << 15):
            a, b = q[at : at + (1 << 15)], v[at : at + (1 << 15)]
            keep[at : at + (1 << 15)] = np.einsum("ij,ij->i", x[a], vectors[b]) >= books.cosine
        yield q[keep] + first, v[keep]


def _spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links enough to keep what the links (u, v) connect: each id to the smallest one that it reaches."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(ids)))
    return ids[other], ids[label[other]]


class Side(NamedTuple):
    """Members of one side of a cell."""

    node: np.ndarray
    copies: np.ndarray
    units: np.ndarray
    codes: np.ndarray
    error: np.ndarray


def compare(books: Books, ours: Side, theirs: Side, centre: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Copies linked with each of our and their members, and links (two arrays of nodes) that span what is connected.

    ``same``: both sides are the same members; each link is then met from either end.
    """
    counts = np.zeros(len(ours.node)), np.zeros(len(theirs.node))
    spans = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for q, v in links(books, ours.units, centre, theirs.units, theirs.codes, theirs.error):
        other = ours.node[q] != theirs.node[v]
        q, v = q[other], v[other]
        np.add(counts[0], np.bincount(q, theirs.copies[v], len(ours.node)), out=counts[0])
        if not same:
            np.add(counts[1], np.bincount(v, ours.copies[q], len(theirs.node)), out=counts[1])
        if len(q):
            spans = _spanning(np.concatenate([spans[0], ours.node[q]]), np.concatenate([spans[1], theirs.node[v]]))
    return *counts, *spans


def _packed(x: list | None) -> bytes | None:
    """A usable vector's numbers, in four bytes each if that loses nothing; None for any other."""
    if not x or any(y is None for y in x):
        return None
    v = np.array(x, "<f8")
    if not np.isfinite(v).all() or not v.any():
        return None
    with np.errstate(over="ignore", under="ignore"):
        small = v.astype("<f4")
    return small.tobytes() if np.array_equal(small.astype("<f8"), v) else v.tobytes()


def _rows(packed: bytes, n: int) -> list[bytes]:
    """A pack's vectors one by one."""
    size = len(packed) // n
    return [packed[i * size : (i + 1) * size] for i in range(n)]


def _units(packed: list[bytes], dims: int) -> np.ndarray:
    """Unit vectors in double precision."""
    v = np.array([np.frombuffer(p, "<f4" if len(p) == 4 * dims else "<f8") for p in packed], float).reshape(-1, dims)
    if not len(v):
        return v
    v = v / np.abs(v).max(1, keepdims=True)  # so that no square is lost to the range of a double
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def near_duplicates(table: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``table``: ``vec_id, n_links, component_id, kept``.

    ``n_links`` counts the other rows with a cosine of at least ``cosine``; a vector
    that is null, empty or zero, or holds a null or a number that isn't finite, has
    none, and vectors of different lengths have none with each other.
    ``component_id`` is the smallest id reachable by links; rows that repeat an id
    share a component. A row with a null id counts as a link of others, has a null
    component and is kept. An empty table gives an empty table; other columns are
    ignored. ``block_bytes`` bounds what a task compares at once and so sets the number
    of lists; the result doesn't depend on it.
    """
    spark = table.sparkSession
    bound_batches(spark)
    work = Workspace(spark, "vectors")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("x").to_pylist()
            packed = [_packed(x) for x in values]
            dims = [len(x) if p else None for x, p in zip(values, packed, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(packed, pa.binary()), pa.array(dims, pa.int32())], names=["vec_id", "raw", "dims"])

    made = work.put(rows.mapInArrow(lean(pack), "vec_id long, raw binary, dims int"), "packed")
    # equal vectors are one entry, known by a digest of their numbers
    some = made.where("raw is not null").withColumn("key", F.unhex(F.md5("raw")))
    entries = some.groupBy("key", "dims").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("raw").alias("raw"))
    # numbered as they are written: no two entries share a number
    entries = work.put(entries.withColumn("node", F.monotonically_increasing_id()), "entries")
    totals = {int(r["dims"]): int(r["n"]) for r in entries.groupBy("dims").agg(F.count("*").alias("n")).collect()}  # a row for each length of vector
    found = None
    for dims, n in sorted(totals.items()):
        one = _linked(entries.where(F.col("dims") == dims), dims, n, cosine, work, block_bytes)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "node long, copies_linked long, other long")
    found = work.put(found, "found")
    counts = found.where("other is null").groupBy("node").agg(F.sum("copies_linked").alias("linked"))
    ids = entries.select("key", "dims", "node", "least", "copies")
    pairs = found.where("other is not null").select("node", "other")
    # links between entries as links between ids; an entry whose rows all lack an id goes by a negative stand-in
    stand = ids.select("node", F.coalesce("least", F.lit(-(1 << 62)) - F.col("node")).alias("id"))
    edges = pairs.join(stand, "node").withColumnRenamed("id", "u").drop("node").join(stand.withColumnRenamed("node", "other"), "other").select("u", F.col("id").alias("v"))
    several = some.groupBy("vec_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("vec_id")
    repeats = some.join(several, "vec_id", "left_semi").join(ids, ["key", "dims"]).select(F.col("vec_id").alias("u"), F.col("least").alias("v"))
    grouped = work.put(components(edges.unionByName(repeats), work), "components")
    joined = ids.join(counts, "node", "left").join(grouped.withColumnRenamed("node", "least"), "least", "left")
    about = work.put(joined.select("key", "dims", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "least").alias("component")), "about")
    out = made.withColumn("key", F.unhex(F.md5("raw"))).drop("raw").join(about, ["key", "dims"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


_PACK = "lo int, hi int, second boolean, n int, node binary, copies binary, raw binary, code binary, error binary"


def _linked(entries: DataFrame, dims: int, n: int, cosine: float, work: Workspace, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``node, copies_linked`` sums, and ``node, other`` links that span the components."""
    spark = entries.sparkSession
    block = max(LEAST_BLOCK, block_bytes // (8 * dims))
    lists = min(MOST_LISTS, max(1, -(-n // block)))
    rows = max(SAMPLE_ROWS, PER_LIST * lists)
    # digests are spread evenly: those below a bound are a few more than are taken, and the only ones put in order
    bound = int(min(1.0, (1.2 * rows + 1000) / max(n, 1)) * (1 << 32))
    low = entries.where(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long") < bound)
    sample = low.orderBy("key").limit(rows).select("raw").toArrow().column("raw").to_pylist()
    shared = spark.sparkContext.broadcast(fit(_units(sample, dims), lists, cosine))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each batch, the members that one pair of lists has on one side, as one row."""
        books = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column("raw").to_pylist()
            x = _units(raw, dims)
            near, codes, error = encode(books, x)
            row, other = np.nonzero(probes(books, x))
            lo, hi = np.minimum(near[row], other), np.maximum(near[row], other)
            second = (near[row] == hi) & (lo < hi)
            order = np.lexsort((row, second, hi, lo))
            row, lo, hi, second = row[order], lo[order], hi[order], second[order]
            at = np.flatnonzero(np.concatenate([[True], (np.diff(lo) != 0) | (np.diff(hi) != 0) | (second[1:] != second[:-1])]))
            wide = any(len(r) != 4 * dims for r in raw)
            numbers = np.array([np.frombuffer(r, "<f4" if len(r) == 4 * dims else "<f8") for r in raw], "<f8" if wide else "<f4")
            held = (batch.column("node").to_numpy(), batch.column("copies").to_numpy(), numbers, codes, error)
            groups = [row[a:b] for a, b in zip(at.tolist(), [*at[1:].tolist(), len(row)], strict=True)]
            blobs = [pa.array([values[g].tobytes() for g in groups], pa.binary()) for values in held]
            front = [pa.array(lo[at], pa.int32()), pa.array(hi[at], pa.int32()), pa.array(second[at]), pa.array([len(g) for g in groups], pa.int32())]
            yield pa.RecordBatch.from_arrays([*front, *blobs], names=["lo", "hi", "second", "n", "node", "copies", "raw", "code", "error"])

    packs = work.put(entries.select("node", "copies", "raw").mapInArrow(lean(packed), _PACK).withColumn("pack", F.monotonically_increasing_id()), f"packs{dims}")
    blocks = lambda side: F.greatest(F.ceil(F.sum(F.when(side, F.col("n"))) / block), F.lit(1)).cast("int")
    sizes = packs.groupBy("lo", "hi").agg(blocks(~F.col("second")).alias("firsts"), blocks(F.col("second")).alias("seconds"))
    sizes = work.put(sizes.where("lo = hi or seconds is not null and firsts is not null"), f"sizes{dims}")  # both sides have members
    own = F.pmod(F.xxhash64("pack"), F.when(F.col("second"), F.col("seconds")).otherwise(F.col("firsts"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda a, b, second: F.struct(a.alias("a"), b.alias("b"), second.alias("second"))
    cells = (
        F.when(F.col("lo") == F.col("hi"), F.transform(upto(F.col("firsts")), lambda j: cell(F.least(j, "own"), F.greatest(j, "own"), j < F.col("own"))))
        .when(F.col("second"), F.transform(upto(F.col("firsts")), lambda j: cell(j, F.col("own"), F.lit(True))))
        .otherwise(F.transform(upto(F.col("seconds")), lambda j: cell(F.col("own"), j, F.lit(False))))
    )
    dealt = packs.join(sizes, ["lo", "hi"]).withColumn("own", own).withColumn("cell", F.explode(cells))
    held = dealt.groupBy("lo", "hi", "cell.a", "cell.b").agg(F.collect_list(F.struct("cell.second", "node", "copies", "raw", "code", "error")).alias("held"))

    def side(held: pa.StructArray, second: bool) -> Side:
        own = held.filter(pc.equal(held.field("second"), second))
        joined = {c: b"".join(own.field(c).to_pylist()) for c in ("copies", "node", "code", "error")}
        raw = [r for r, k in zip(own.field("raw").to_pylist(), own.field("node").to_pylist(), strict=True) for r in _rows(r, len(k) // 8)]
        node = np.frombuffer(joined["node"], np.int64)
        codes = np.frombuffer(joined["code"], np.uint8).reshape(len(node), shared.value.words.shape[0])
        return Side(node, np.frombuffer(joined["copies"], np.int64), _units(raw, dims), codes, np.frombuffer(joined["error"], np.float64))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                lo, hi, a, b = (batch.column(c)[k].as_py() for c in ("lo", "hi", "a", "b"))
                members, same = batch.column("held")[k].values, lo == hi and a == b
                ours = side(members, False)
                theirs = ours if same else side(members, True)
                if not len(ours.node) or not len(theirs.node):
                    continue
                n_ours, n_theirs, u, v = compare(books, ours, theirs, books.centres[hi], same)
                ends = [(s.node[c > 0], c[c > 0].astype(np.int64)) for s, c in ((ours, n_ours), (theirs, n_theirs))]
                nodes, counted = np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends])
                blank = pa.nulls(len(nodes), pa.int64()), pa.nulls(len(u), pa.int64())
                rows = [pa.array(np.concatenate([nodes, u])), pa.concat_arrays([pa.array(counted), blank[1]]), pa.concat_arrays([blank[0], pa.array(v)])]
                yield pa.RecordBatch.from_arrays(rows, names=["node", "copies_linked", "other"])

    return held.mapInArrow(lean(searched), "node long, copies_linked long, other long")
