"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

One pass marks word bytes by a 256-entry table. A word's 64-bit code chains its
bytes, eight at a time, through a mixing step that isn't linear, so no two words of
up to eight bytes and one length share a code, and longer ones only by chance. Words
beyond ``LONG`` bytes are digested one by one. No Python object is made for others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are joined up to so many bytes before they are hashed together.
SLICE_BYTES = 1 << 18
#: Words with more bytes are digested one by one.
LONG = 64


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of the bytes that lie in one of the closed ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Everything but ASCII white space; letters, digits and all non-ASCII bytes.
NON_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
ALPHANUMERIC = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


#: Bytes with A-Z as a-z; masks of the first 0 to 8 bytes of a little-endian number.
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[0x41:0x5B] += 0x20
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64 bits over all positions, one to one."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def codes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit codes of stretches of bytes."""
    n = len(data)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    eight = np.ndarray((n + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    out = mix(size.astype(np.uint64) * _LENGTH)
    live, at, left = slice(None), starts, size
    while len(left):
        out[live] = mix(out[live] ^ (eight[at] & _FIRST[np.minimum(left, 8)]))
        more = np.flatnonzero((left > 8) & (size[live] <= LONG))
        live = more if isinstance(live, slice) else live[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


class Slice(NamedTuple):
    """Texts ``first`` to ``first + n`` of a batch as one run of bytes."""

    first: int
    n: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Words of a slice: byte bounds, 64-bit codes, and each text's first word."""

    starts: np.ndarray
    ends: np.ndarray
    codes: np.ndarray
    bounds: np.ndarray


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts (null: empty) in runs of about ``limit`` bytes; a longer text is a run of its own."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Slice(i, j - i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def words(part: Slice, is_word: np.ndarray, lower: bool = True) -> Words:
    """Maximal runs of word bytes inside each text; ``lower`` takes A-Z as a-z."""
    data, offsets = part.data, part.offsets
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = is_word[data]
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:n]
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n + 1, bool)
    after[:n] = inside[1:]
    after[offsets[1:] - 1] = False
    ends = np.flatnonzero((inside & ~after)[:n]) + 1
    codes = codes_of(_LOWERED[data] if lower else data, starts, ends)
    return Words(starts, ends, codes, np.searchsorted(starts, offsets))
