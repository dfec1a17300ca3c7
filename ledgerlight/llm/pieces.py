"""SentencePiece encoding and decoding that keeps byte offsets.

Normalisation walks the text by the longest prefix found in the model's compiled
character map and notes, for every byte it writes, the source bytes it came from.
A piece then maps back to a span of the original text. The merges themselves are
the sentencepiece library's: where no piece of the model holds a word mark after
another character, a text is the concatenation of its words' encodings, so each
distinct word is encoded once and kept.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .storage import bound_batches, lean
from .wordcache import Block, WordCache

MARK = "▁"
#: Bytes of text whose spans are made together; a dozen arrays of eight bytes for each.
BLOCK_BYTES = 1 << 19


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 1:
            yield key >> 3, data[i : i + 8]
            i += 8
        elif kind == 5:
            yield key >> 3, data[i : i + 4]
            i += 4
        else:
            n = varint()
            yield key >> 3, data[i : i + n]
            i += n


class NormalizerSpec(NamedTuple):
    """What the model file says about normalisation (fields 2 to 5 of its normalizer message)."""

    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def read_spec(model: bytes) -> NormalizerSpec:
    """The normalizer message (field 3) of a serialized model."""
    names = {2: "charsmap", 3: "add_dummy_prefix", 4: "remove_extra_whitespaces", 5: "escape_whitespaces"}
    for number, value in _fields(model):
        if number == 3 and isinstance(value, bytes):
            got = {names[n]: v if n == 2 else bool(v) for n, v in _fields(value) if n in names}
            return NormalizerSpec(**got)
    return NormalizerSpec()


class CharsMap:
    """A compiled character map: a double-array trie over source bytes, and the replacements it points to."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.replacements = blob[4 + size :]

    @staticmethod
    def _jump(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest_prefix(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that starts at ``at``."""
        if not self.units:
            return None
        found = None
        node = self._jump(self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._jump(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.replacements[start : self.replacements.index(b"\0", start)]
        return found


class Normalized(NamedTuple):
    """Normalised bytes, and for each of them (and the end) the source byte where its character starts."""

    text: bytes
    origin: list[int]


class Normalizer:
    def __init__(self, spec: NormalizerSpec) -> None:
        self.spec, self.map = spec, CharsMap(spec.charsmap)
        self.space = MARK.encode() if spec.escape_whitespaces else b" "

    def _characters(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        """Source start, source length and replacement of one prefix after another."""
        i = 0
        while i < len(data):
            if hit := self.map.longest_prefix(data, i):
                yield i, hit[0], hit[1]
                i += hit[0]
            else:
                lead = data[i]
                n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                yield i, n, data[i : i + n]
                i += n

    def __call__(self, text: str) -> Normalized:
        data = text.encode("utf-8", "surrogatepass")
        out, origin = bytearray(), []
        squeeze = self.spec.remove_extra_whitespaces
        steps = list(self._characters(data))
        first = next((i for i, s in enumerate(steps) if s[2] != b" "), len(steps)) if squeeze else 0
        if first == len(steps):
            return Normalized(b"", [0])
        if self.spec.add_dummy_prefix:
            out += self.space
            origin += [steps[first][0]] * len(self.space)
        after_space, end = squeeze, len(data)
        for start, _, new in steps[first:]:
            if after_space:
                new = new.lstrip(b" ")
            raw = new.replace(b" ", self.space)
            out += raw
            origin += [start] * len(raw)
            after_space = squeeze and (new.endswith(b" ") if new else after_space)
        while squeeze and out.endswith(self.space):
            end = origin[len(out) - len(self.space)]
            del out[-len(self.space) :]
        return Normalized(bytes(out), [*origin[: len(out)], end])


class Encoded(NamedTuple):
    """Ids, and the byte span of the original text for each; a mark that no byte stands behind has an empty span."""

    ids: list[int]
    starts: list[int]
    ends: list[int]


class Codec:
    """One model: encode as the library does, with spans; decode by the library."""

    def __init__(self, path: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            self.normalizer = Normalizer(read_spec(f.read()))
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        self.mark_id = self.library.piece_to_id(MARK)
        #: Normalised bytes of each piece; a byte piece is one byte.
        self.widths = [1 if self.library.is_byte(i) else len(p.encode()) for i, p in enumerate(pieces)]
        spec = self.normalizer.spec
        plain = not spec.charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
        crossing = any(MARK in p.lstrip(MARK) for i, p in enumerate(pieces) if not (self.library.is_control(i) or self.library.is_unknown(i)))
        #: Normalisation only marks spaces: without a character map no prefix is ever replaced.
        self.plain, self.sizes = plain, np.array(self.widths, np.int64)
        #: Words can be encoded one by one: normalisation only marks spaces, and no piece goes on after a word's end.
        self.by_word = plain and not crossing and self.mark_id != self.library.unk_id()
        self.spelled = [str(i) for i in range(n)]
        self.cache = WordCache(self._cut, self._encode_chunks, block_bytes=BLOCK_BYTES)

    @staticmethod
    def _cut(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A chunk is a run of spaces and the word behind it."""
        space = data == 0x20
        starts = space.copy()
        starts[1:] &= ~space[:-1]
        starts[offsets[:-1][np.diff(offsets) > 0]] = True
        return starts

    def _encode_chunks(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each chunk less its first space, which the library puts back as a mark; a lone space is that mark."""
        raw = data.tobytes()
        words = [raw[a:b].decode() for a, b in zip((starts + 1).tolist(), ends.tolist(), strict=True)]
        rows = [ids if w else [self.mark_id] for w, ids in zip(words, self.library.encode(words, num_threads=1), strict=True)]
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter(itertools.chain.from_iterable(rows), np.int32, int(counts.sum())), counts

    def blocks(self, texts: pa.Array) -> Iterator[Block]:
        """The library's ids of all texts (null: empty), some texts at a time."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            rows = self.library.encode(texts.to_pylist(), num_threads=1)
            bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            yield Block(0, len(rows), np.fromiter(itertools.chain.from_iterable(rows), np.int32, int(bounds[-1])), bounds)
            return
        marked = pc.binary_join_element_wise("", pc.replace_substring(texts, MARK, " "), " ")
        yield from self.cache.blocks(pc.if_else(pc.equal(texts, ""), "", marked))

    def encode(self, texts: Iterable[str]) -> list[list[int]]:
        """The library's ids of each text."""
        out: list[list[int]] = []
        for block in self.blocks(pa.array(list(texts), pa.string())):
            ids = block.ids.tolist()
            out += [ids[block.bounds[i] : block.bounds[i + 1]] for i in range(block.n)]
        return out

    def spans(self, text: str, ids: list[int]) -> Encoded:
        """Project the pieces of a text's encoding to its bytes."""
        norm = self.normalizer(text)
        starts, ends, at, unknown = [], [], 0, self.library.unk_id()
        for k, i in enumerate(ids):
            width = self.widths[i]
            if i == unknown:  # an unknown piece reaches to where the rest begins
                width = len(norm.text) - at - sum(self.widths[j] for j in ids[k + 1 :])
            starts.append(norm.origin[at])
            at += width
            ends.append(norm.origin[at])
        return Encoded(list(ids), starts, ends)

    def block_spans(self, texts: list[str], block: Block) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`spans` of a block's texts, one after another; pieces that leave a gap raise.

        A model without a character map has its alignment made for the whole block;
        otherwise, or where a piece is unknown, each text is walked by the longest prefix.
        """
        bounds = block.bounds
        if self.plain and not (block.ids == self.library.unk_id()).any():
            data = [t.encode("utf-8", "surrogatepass") for t in texts]
            sizes = np.fromiter(map(len, data), np.int64, len(data))
            starts, ends = self._aligned(np.frombuffer(b"".join(data), np.uint8), sizes, block)
            has = np.flatnonzero(sizes)
            whole = not starts[bounds[has]].any() and np.array_equal(ends[bounds[has + 1] - 1], sizes[has])
        else:
            rows = [self.spans(t, block.ids[a:b].tolist()) for t, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            starts, ends = (np.fromiter(itertools.chain.from_iterable(r[k] for r in rows), np.int64, len(block.ids)) for k in (1, 2))
            whole = True  # a character map may drop what stands before and behind the pieces
        follows = np.ones(len(starts), bool)
        follows[bounds[:-1][np.diff(bounds) > 0]] = False
        follows = np.flatnonzero(follows)
        if not whole or not np.array_equal(starts[follows], ends[follows - 1]) or (starts > ends).any():
            raise ValueError("the spans of the pieces don't cover the text")
        return starts, ends

    def _aligned(self, data: np.ndarray, sizes: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Spans by the origins that :class:`Normalized` has: of the first mark, each byte (a space becomes a mark) and the end."""
        mark, offsets = len(self.normalizer.space), np.concatenate([[0], np.cumsum(sizes)])
        has = np.flatnonzero(sizes)
        character = np.maximum.accumulate(np.where((data & 0xC0) == 0x80, 0, np.arange(len(data)))) - np.repeat(offsets[:-1], sizes)
        # a text's end stands before the next one's first mark
        where = np.concatenate([offsets[has + 1], offsets[has]])
        origin = np.insert(character, where, np.concatenate([sizes[has], np.zeros(len(has), np.int64)]))
        wide = np.insert(np.where(data == 0x20, mark, 1), where, np.repeat([1, mark], len(has)))
        before = np.concatenate([[0], np.cumsum(wide)])
        place = np.zeros(len(sizes), np.int64)
        length = np.zeros(len(sizes), np.int64)
        rank = 2 * np.arange(len(has))
        place[has] = before[offsets[has] + rank]
        length[has] = before[offsets[has + 1] + rank + 1] - place[has]
        widths = self.sizes[block.ids]
        sums = np.concatenate([[0], np.cumsum(widths)])
        first, counts = sums[block.bounds[:-1]], np.diff(block.bounds)
        if not np.array_equal(sums[block.bounds[1:]] - first, length):
            raise ValueError("the pieces are not as long as the normalised text")
        at = sums[:-1] + np.repeat(place - first, counts)
        origin = np.repeat(origin, wide)
        return origin[at], origin[at + widths]

    def encode_with_spans(self, texts: Iterable[str]) -> list[Encoded]:
        texts = list(texts)
        return [self.spans(t, ids) for t, ids in zip(texts, self.encode(texts), strict=True)]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a model; its cache serves all tasks of the worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


#: Columns that :func:`encode` can add, and their types.
OUTPUTS: dict[str, T.DataType] = {
    "ids": T.ArrayType(T.IntegerType()),
    "starts": T.ArrayType(T.LongType()),
    "ends": T.ArrayType(T.LongType()),
    "decoded": T.StringType(),
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
    "spans_sha256": T.StringType(),
}


def _columns(c: Codec, outputs: tuple[str, ...], texts: list[str], block: Block) -> list[pa.Array]:
    """The outputs of one block's texts, as Arrow arrays."""
    ids, bounds = block.ids, block.bounds
    made: dict[str, list] = {o: [] for o in outputs if o in ("decoded", "ids_sha256", "decoded_sha256")}
    starts, ends = c.block_spans(texts, block) if {"starts", "ends", "spans_sha256"} & set(outputs) else (None, None)
    if made:
        spelled, decode = c.spelled, "decoded" in made or "decoded_sha256" in made
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = ids[a:b].tolist()
            decoded = c.decode(own) if decode else ""
            for o in made:
                if o == "ids_sha256":
                    made[o].append(hashlib.sha256(",".join([spelled[i] for i in own]).encode()).hexdigest())
                elif o == "decoded_sha256":
                    made[o].append(hashlib.sha256(decoded.encode()).hexdigest())
                else:
                    made[o].append(decoded)
    out = []
    for o in outputs:
        if o == "ids":
            out.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())))
        elif o == "n_tokens":
            out.append(pa.array(np.diff(bounds), pa.int64()))
        elif o in ("starts", "ends"):
            out.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(starts if o == "starts" else ends, pa.int64())))
        elif o == "spans_sha256":
            pairs = np.stack([starts, ends], 1).astype("<i8")
            out.append(pa.array([hashlib.sha256(pairs[a:b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string()))
        else:
            out.append(pa.array(made[o], pa.string()))
    return out


def encode(docs: DataFrame, model_path: str, outputs: tuple[str, ...] = ("ids", "starts", "ends"), text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the columns named in ``outputs`` (see :data:`OUTPUTS`), their names after ``prefix``.

    A null or empty text has no ids and decodes to the empty string. ``spans_sha256``
    is of the pairs (start, end) as little-endian 64-bit integers. All columns and
    rows of ``docs`` stay as they are, repeated rows too; an output whose name
    (with ``prefix``) ``docs`` already has replaces that column. No shuffle.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    names = [prefix + o for o in outputs]
    keep = [c for c in docs.columns if c not in names]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, OUTPUTS[o]) for n, o in zip(names, outputs, strict=True)])
    source = docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text_col}`"].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            texts = batch.column("__text")
            for block in c.blocks(texts):
                part = batch.slice(block.first, block.n)
                own = [t or "" for t in part.column("__text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(keep))] + _columns(c, outputs, own, block), names=[*keep, *names])

    return source.mapInArrow(lean(run), schema)


def decode(docs: DataFrame, model_path: str, ids_col: str = "ids", output: str = "decoded") -> DataFrame:
    """``docs`` with ``output``: the text that the library decodes from ``ids_col`` (null: empty)."""
    keep = [c for c in docs.columns if c != output]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(output, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            made = pa.array([c.decode(x or []) for x in batch.column(ids_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [made], names=[*keep, output])

    return docs.mapInArrow(lean(run), schema)
