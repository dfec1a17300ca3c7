"""Content-addressed store of token ids.

A document's ids are cut where a rolling hash of the last ``WINDOW`` ids hits a
mask, so equal passages give equal chunks wherever they stand. A chunk's address
is the SHA-256 of its bytes; each chunk is stored once. A document's recipe lists
its chunks in order, and its Merkle root is the hash of their addresses. The
manifest holds one root for each range of recipes and one above all.

Files under ``path``:

* ``chunks/``: ``address, n, data`` (little-endian unsigned ids, Zstandard-compressed
  where that is shorter), dealt by address
* ``recipes/``: ``part, place, doc_id, start, n_tokens, root, addresses, sizes``,
  ascending by doc_id through parts and places (nulls first; rows that repeat an id
  by root); ``start`` counts the ids before it in its part
* ``manifest/``: ``part, docs, ids, base, root``; ``base`` counts the ids of the
  parts before; part -1 is the whole store
"""

from __future__ import annotations

import hashlib
import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .storage import Workspace, bound_batches, lean
from .wordcache import WordCache, gather
from .wordhash import byte_class, mix

#: Ids under the rolling hash; a cut is likely once in ``MASK + 1`` ids, never sooner than LEAST or later than MOST.
WINDOW, MASK, LEAST, MOST = 16, 1023, 256, 8192
ADDRESS_BYTES = 16
_ID_VALUES = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))
_STEP = np.uint64(0x2545F4914F6CDD1D)


_LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A))
#: ASCII punctuation but the apostrophe, which can go on a contraction.
_PUNCTUATION = byte_class((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of ASCII and Latin-1 letters."""
    letter = _LETTER[data]
    latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    letter[1:] |= latin
    letter[:-1] |= latin
    return letter


#: Letter chunks that the tokenizer gets as one text.
_JOINED = 256


class ByteBpe:
    """A byte-level BPE tokenizer file, chunk by chunk.

    The pre-tokenizer's pattern takes white space only at the front of a token or
    as a run of its own, so no token reaches across a place where white space
    follows something else, nor from a letter to punctuation other than an
    apostrophe, nor past a single tab or line end. Cuts are made at such ASCII bytes alone, and the latter not in a
    block that holds one of the file's added tokens.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("a tokenizer file with byte-level pre-tokenization and no normalizer is needed")
        #: Letter chunks can stand in one text without touching each other.
        self.joined = not any(_letters(np.frombuffer(t, np.uint8)).all() for t in self.added)
        vocab = self.library.get_vocab()
        #: Bytes of each token; the file spells a byte as one character.
        self.widths = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.widths[i] = len(token)
        self.cache = WordCache(self._cut, self._encode_chunks)

    def _each(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = self.library.encode_batch_fast([raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], add_special_tokens=False)
        counts = np.array([len(e) for e in found], np.int64)
        return np.fromiter(itertools.chain.from_iterable(e.ids for e in found), np.int32, int(counts.sum())), counts

    def _encode_chunks(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks of letters behind a space, or behind a line end put there, go to the library many in a text; others alone."""
        spaced = data[starts] == 0x20
        bare = np.concatenate([[0], np.cumsum(~_letters(data))])
        first = starts + spaced
        whole = (bare[ends] == bare[first]) & (ends > first) & self.joined
        at = np.flatnonzero(whole)
        sizes = (ends - first)[at] + 1
        reach = np.cumsum(sizes)
        lead = reach - sizes
        text = gather(data, first[at] - 1, sizes)  # the byte before the letters makes room for the one put there
        text[lead] = np.where(spaced[at], 0x20, 0x0A)
        cuts = np.append(lead[::_JOINED], reach[-1:])
        raw = text.tobytes()
        found = self.library.encode_batch_fast([raw[a:b].decode() for a, b in itertools.pairwise(cuts.tolist())], add_special_tokens=False)
        flat = np.fromiter(itertools.chain.from_iterable(e.ids for e in found), np.int32)
        tokens = np.cumsum(self.widths[flat])
        last = np.searchsorted(tokens, reach)
        if len(at) and not (last[-1] < len(tokens) and np.array_equal(tokens[last], reach)):  # a token went on into the next chunk
            return self._each(data.tobytes(), starts, ends)
        counts = np.zeros(len(starts), np.int64)
        counts[at] = np.diff(last + 1, prepend=0) - ~spaced[at]
        rest = np.flatnonzero(~whole)
        own, counts[rest] = self._each(data.tobytes(), starts[rest], ends[rest])
        ids = np.zeros(int(counts.sum()), np.int32)
        letters = np.repeat(whole, counts)
        line = np.zeros(len(flat), bool)
        line[(np.append(0, last[:-1] + 1) if len(at) else last)[~spaced[at]]] = True
        ids[letters], ids[~letters] = flat[~line], own
        return ids, counts

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        starts = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
        # what stands before: ASCII that is no white space or control, or the end of a longer character that isn't white space
        before = (data > 0x20) & (data != 0x7F)
        high = data >= 0x80
        if high.any():
            one, two = np.roll(data, 1), np.roll(data, 2)
            white = (one == 0xC2) & ((data == 0x85) | (data == 0xA0))
            white |= (two == 0xE1) & (one == 0x9A) & (data == 0x80)
            white |= (two == 0xE2) & (((one == 0x80) & ((data <= 0x8F) | ((data >= 0xA8) & (data <= 0xAF)))) | ((one == 0x81) & (data == 0x9F)))
            white |= (two == 0xE3) & (one == 0x80) & (data == 0x80)
            before &= ~(white & high)
        starts[1:] &= before[:-1]
        # one tab or line end between words is a token of its own
        alone = starts[:-1] & (data[:-1] != 0x20)
        alone[:-1] &= ~starts[1:-1]
        starts[1:] |= alone & (((data > 0x20) & (data < 0x7F)) | (data == 0xC3))[1:]
        raw = data.tobytes()
        if not any(t in raw for t in self.added):
            starts[1:] |= _PUNCTUATION[data[1:]] & _letters(data)[:-1]
        starts[offsets[:-1][np.diff(offsets) > 0]] = True
        return starts


_tokenizers: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    if path not in _tokenizers:
        _tokenizers[path] = ByteBpe(path)
    return _tokenizers[path]


def cut_points(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Ends of the chunks of documents that begin at ``first`` (and end at the next; the last is the end of ``ids``)."""
    n = len(ids)
    values = _ID_VALUES[ids & 0xFFFF]
    rolled = np.zeros(n, np.uint64)
    factor = np.ones(1, np.uint64)
    for j in range(min(WINDOW, n)):
        rolled[j:] += values[: n - j] * factor
        factor = np.multiply(factor, _STEP)
    hits = np.flatnonzero((mix(rolled) & np.uint64(MASK)) == 0) + 1
    ends: list[int] = []
    for a, b in itertools.pairwise(first.tolist()):
        at = a
        inside = hits[np.searchsorted(hits, a + WINDOW) : np.searchsorted(hits, b)].tolist()
        for h in inside:
            while h - at > MOST:
                at += MOST
                ends.append(at)
            if h - at >= LEAST:
                at = h
                ends.append(at)
        while b - at > MOST:
            at += MOST
            ends.append(at)
        if b > at:
            ends.append(b)
    return np.array(ends, np.int64)


_deflate, _inflate = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()


def pack(ids: np.ndarray) -> bytes:
    """A chunk's bytes: a format byte, then its ids, compressed if that helps."""
    narrow = int(ids.max(initial=0)) < 1 << 16
    raw = ids.astype("<u2" if narrow else "<u4").tobytes()
    small = _deflate.compress(raw)
    return bytes([(0 if narrow else 2) + (len(small) < len(raw))]) + min(raw, small, key=len)


def unpack(data: bytes) -> np.ndarray:
    raw = _inflate.decompress(data[1:]) if data[0] & 1 else data[1:]
    return np.frombuffer(raw, "<u4" if data[0] & 2 else "<u2").astype("<u4")


def address(ids: np.ndarray) -> bytes:
    """The name of a chunk: a digest of its ids as little-endian 32-bit numbers."""
    return hashlib.sha256(ids.astype("<u4").tobytes()).digest()[:ADDRESS_BYTES]


def root_of(addresses: list[bytes]) -> bytes:
    """A document's node of the Merkle tree: the digest of its chunks' addresses."""
    return hashlib.sha256(b"".join(addresses)).digest()[:ADDRESS_BYTES]


def _encoded(path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for block in t.cache.blocks(pc.fill_null(batch.column("text"), "")):
                docs = batch.column("doc_id").slice(block.first, block.n)
                extra = 0 if end_id is None else 1
                bounds = block.bounds + np.arange(block.n + 1) * extra
                ids = block.ids
                if extra:
                    ids = np.insert(ids, block.bounds[1:], end_id)
                ends = cut_points(ids, bounds)
                starts = np.concatenate([bounds[:1], ends[:-1]]) if len(ends) else ends
                names = [address(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                data = [pack(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                at = np.searchsorted(starts, bounds) if len(starts) else np.zeros(block.n + 1, np.int64)
                offsets = pa.array(at, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(names, pa.binary()), pa.array(ends - starts, pa.int32()), pa.array(data, pa.binary()))]
                roots = [root_of(names[i:j]) for i, j in itertools.pairwise(at.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(np.diff(bounds), pa.int64()), pa.array(roots, pa.binary()), *lists], names=["doc_id", "n_tokens", "root", "addresses", "sizes", "datas"]
                )

    return run


_ENCODED = "doc_id long, n_tokens long, root binary, addresses array<binary>, sizes array<int>, datas array<binary>"
_RECIPE = "part int, place long, doc_id long, start long, n_tokens long, root binary, addresses array<binary>, sizes array<int>"
#: Documents under one node of the Merkle tree's second level.
NODE_DOCS = 1024


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the documents of a partition and count the ids before each."""
    part, place, start = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.column("n_tokens").to_numpy()
        ends = start + np.cumsum(n)
        front = [pa.array(np.full(len(n), part, np.int32)), pa.array(place + np.arange(len(n))), batch.column("doc_id"), pa.array(ends - n)]
        rest = ["n_tokens", "root", "addresses", "sizes"]
        yield pa.RecordBatch.from_arrays([*front, *[batch.column(c) for c in rest]], names=["part", "place", "doc_id", "start", *rest])
        place, start = place + len(n), int(ends[-1]) if len(n) else start


def _digest(rows: Column, field: str) -> Column:
    """The digest of binaries in order, in hex form as Spark's ``sha2`` gives it."""
    return F.unhex(F.substring(F.sha2(F.unhex(F.array_join(F.transform(F.array_sort(rows), lambda x: F.hex(x[field])), "")), 256), 1, 2 * ADDRESS_BYTES))


def _parts(recipes: DataFrame) -> DataFrame:
    """``part, docs, ids, root`` of the recipes as they are stored."""
    nodes = recipes.groupBy("part", F.floor(F.col("place") / NODE_DOCS).alias("node")).agg(
        F.count("*").alias("docs"), F.sum("n_tokens").alias("ids"), _digest(F.collect_list(F.struct("place", "root")), "root").alias("root")
    )
    return nodes.groupBy("part").agg(F.sum("docs").alias("docs"), F.sum("ids").alias("ids"), _digest(F.collect_list(F.struct("node", "root")), "root").alias("root"))


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts (null: empty) and write the store to ``path``.

    Every row is a document, rows that repeat an id or a text too; a null id comes
    first. ``end_id`` closes each document (None: nothing does, so an empty text
    has no ids and no chunks). An empty table makes a store without rows. Other
    columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    work = Workspace(spark, "tokenstore")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    staged = work.put(source.mapInArrow(lean(_encoded(tokenizer_path, end_id)), _ENCODED), "encoded")
    chunks = staged.select(F.explode(F.arrays_zip("addresses", "sizes", "datas")).alias("c")).select(F.col("c.addresses").alias("address"), F.col("c.sizes").alias("n"), F.col("c.datas").alias("data"))
    chunks.groupBy("address").agg(F.first("n").alias("n"), F.first("data").alias("data")).write.parquet(f"{path}/chunks")
    ordered = staged.drop("datas").repartitionByRange(F.asc_nulls_first("doc_id"), "root").sortWithinPartitions(F.asc_nulls_first("doc_id"), "root")
    ordered.mapInArrow(lean(_placed), _RECIPE).write.parquet(f"{path}/recipes")
    work.drop(staged)
    _manifest(_parts(spark.read.parquet(f"{path}/recipes")), work).coalesce(1).write.parquet(f"{path}/manifest")


def _manifest(parts: DataFrame, work: Workspace) -> DataFrame:
    """The parts with the ids before each, and the whole store as part -1; one row for each task that wrote recipes."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    listed = work.put(parts.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))), "parts")
    whole = listed.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("ids"), F.lit(0)).alias("ids"), _digest(F.collect_list(F.struct("part", "root")), "root").alias("root"))
    whole = whole.select(F.lit(-1).alias("part"), "docs", "ids", F.lit(0).cast("long").alias("base"), "root")
    return listed.select("part", "docs", "ids", "base", "root").unionByName(whole)


_POLYNOMIAL = np.uint64(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo the CRC's, bits reflected."""
    product = np.zeros(np.broadcast(a, b).shape, np.uint64)
    b = np.broadcast_to(b, product.shape).copy()
    one = np.uint64(1)
    for i in range(31, -1, -1):
        product ^= b * ((a >> np.uint64(i)) & one)
        b = (b >> one) ^ (_POLYNOMIAL * (b & one))
    return product


def shifted_crc(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What chunks with these CRCs add (by XOR) to the CRC of a stream in which so many bytes follow them."""
    out, step, n = crc.astype(np.uint64), np.array([1 << 23], np.uint64), zeros.astype(np.uint64)
    while n.any():
        odd = (n & np.uint64(1)).astype(bool)
        out[odd] = _times(out[odd], step)
        step, n = _times(step, step), n >> np.uint64(1)
    return out


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each stored chunk's CRC, and whether its bytes still have its address."""
    for batch in batches:
        names = batch.column("address").to_pylist()
        rows = [unpack(d) for d in batch.column("data").to_pylist()]
        good = [address(r) == a and len(r) == n for r, a, n in zip(rows, names, batch.column("n").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("address"), pa.array([zlib.crc32(r.tobytes()) for r in rows], pa.int64()), pa.array(good, pa.bool_())], names=["address", "crc", "good"])


def _listed_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of each recipe, with the bytes that follow it; one without address for a recipe of none."""
    for batch in batches:
        out: dict[str, list] = {"take": [], "address": [], "n": [], "after": []}
        good = []
        for i, (names, sizes, root) in enumerate(zip(batch.column("addresses").to_pylist(), batch.column("sizes").to_pylist(), batch.column("root").to_pylist(), strict=True)):
            good.append(root_of(names) == root)
            after = 4 * sum(sizes)
            for a, n in zip(names or [None], sizes or [0], strict=True):
                after -= 4 * n
                for key, value in zip(out, (i, a, n, after), strict=True):
                    out[key].append(value)
        take = pa.array(out["take"], pa.int64())
        held = [batch.column(c).take(take) for c in ("part", "place", "doc_id", "start", "n_tokens")]
        made = [pa.array(out["address"], pa.binary()), pa.array(out["n"], pa.int64()), pa.array(out["after"], pa.int64()), pa.array(good, pa.bool_()).take(take)]
        yield pa.RecordBatch.from_arrays([*held, *made], names=["part", "place", "doc_id", "start", "n_tokens", "address", "n", "after", "listed"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = shifted_crc(pc.fill_null(batch.column("crc"), 0).to_numpy(), batch.column("after").to_numpy())
        keep = ["part", "place", "doc_id", "start", "n_tokens", "n", "ok"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(crc.astype(np.int64))], names=[*keep, "crc"])


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the store: ``doc_id, start, n_tokens, ids_crc32, verified``.

    Every chunk is read and digested; a document's CRC is the XOR of what its chunks
    add, so no ids move. ``verified``: all its chunks are there and have their
    address, its root is that of its recipe, the sizes add up, and its part of the
    recipes agrees with the Merkle manifest.
    """
    bound_batches(spark)
    chunks = spark.read.parquet(f"{path}/chunks").mapInArrow(lean(_stored), "address binary, crc long, good boolean")
    lists = "part int, place long, doc_id long, start long, n_tokens long, address binary, n long, after long, listed boolean"
    used = spark.read.parquet(f"{path}/recipes").mapInArrow(lean(_listed_chunks), lists).join(chunks, "address", "left")
    used = used.withColumn("ok", F.col("listed") & (F.coalesce("good", F.lit(False)) | F.col("address").isNull()))
    added = used.select("part", "place", "doc_id", "start", "n_tokens", "n", "ok", "crc", "after").mapInArrow(
        lean(_added), "part int, place long, doc_id long, start long, n_tokens long, n long, ok boolean, crc long"
    )
    docs = added.groupBy("part", "place", "doc_id", "start", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("n"), F.bool_and("ok").alias("ok"))
    sound = F.broadcast(_sound(spark, path))  # a row for each partition of the recipes
    ok = F.col("ok") & F.col("sound") & (F.col("n") == F.col("n_tokens"))
    return docs.join(sound, "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32", ok.alias("verified"))


def _sound(spark: SparkSession, path: str) -> DataFrame:
    """``part, base, sound``: the recipes of the part give its root and counts, and all parts those of the whole store.

    A damaged or lost recipe spoils its part; a lost part, or a manifest that doesn't
    agree with itself, spoils all.
    """
    now = _parts(spark.read.parquet(f"{path}/recipes")).select("part", *[F.col(c).alias(f"{c}_now") for c in ("docs", "ids", "root")])
    both = Workspace(spark, "verify").put(spark.read.parquet(f"{path}/manifest").join(now, "part", "full"), "parts")
    part = F.col("part") >= 0
    told = both.agg(
        F.bool_or(part & (F.col("docs").isNull() | F.col("docs_now").isNull())).alias("missing"), F.sum(F.when(part, F.col("ids"))).alias("ids"),
        F.collect_list(F.when(part, F.struct("part", "root"))).alias("roots"), F.max(F.when(F.col("part") == -1, F.struct("ids", "root"))).alias("whole"),
    )
    agree = ~F.col("missing") & (F.col("whole.ids") == F.coalesce("ids", F.lit(0))) & (F.col("whole.root") == _digest(F.col("roots"), "root"))
    whole = bool(told.select(agree).first()[0])
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    own = (F.col("docs") == F.col("docs_now")) & (F.col("ids") == F.col("ids_now")) & (F.col("root") == F.col("root_now")) & (F.col("base") == F.coalesce("before", F.lit(0)))
    return both.where(part).withColumn("before", before).select("part", "base", F.coalesce(own & F.lit(whole), F.lit(False)).alias("sound"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the store: ``doc_id, start, ids``, put together from its chunks."""
    bound_batches(spark)
    chunks = spark.read.parquet(f"{path}/chunks").select("address", "data")
    recipes = spark.read.parquet(f"{path}/recipes").select("part", "place", "doc_id", "start", F.posexplode_outer("addresses").alias("pos", "address"))
    rows = recipes.join(chunks, "address", "left").groupBy("part", "place", "doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "data"))).alias("parts"))
    base = F.broadcast(spark.read.parquet(f"{path}/manifest").select("part", "base"))
    rows = rows.join(base, "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), F.col("parts.data").alias("datas"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([unpack(d) for d in x if d is not None] or [np.zeros(0, "<u4")]) for x in batch.column("datas").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return rows.mapInArrow(lean(run), "doc_id long, start long, ids array<long>")


def verify(spark: SparkSession, path: str) -> bool:
    """Whether the recipes have the roots, counts and order that the manifest states."""
    return _sound(spark, path).where("not sound").isEmpty()
