"""Encode many texts through a tokenizer that works word by word.

A text is cut where no token can reach across. The cuts of a whole batch are
found and hashed as arrays, each distinct chunk goes to the tokenizer library
once, and the ids of all texts are gathered from what is kept. The gathered chunk
bytes are compared with the batch, so a hash collision can't change a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .wordhash import Slice, codes_of, slices

#: Bytes of text that are cut and gathered together, unless a cache says otherwise.
BLOCK_BYTES = 4 << 20
#: Distinct chunks kept in a worker; beyond it the store starts anew.
KEPT_CHUNKS = 500_000


class Block(NamedTuple):
    """Ids of texts ``first`` to ``first + n`` in one run; text i has ``ids[bounds[i]:bounds[i + 1]]``."""

    first: int
    n: int
    ids: np.ndarray
    bounds: np.ndarray


def gather(store: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches ``store[o:o + n]`` one after another."""
    total = int(sizes.sum())
    shift = offsets - (np.cumsum(sizes) - sizes)
    return store[np.arange(total) + np.repeat(shift, sizes)]


class _Store:
    """A growing array of stretches."""

    def __init__(self, dtype: type) -> None:
        self.data, self.used = np.zeros(1 << 16, dtype), 0

    def add(self, values: np.ndarray) -> int:
        at, end = self.used, self.used + len(values)
        if end > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(len(self.data), end), self.data.dtype)])
        self.data[at:end] = values
        self.used = end
        return at


class WordCache:
    """``cut(data, offsets)`` marks chunk starts; ``encode(data, starts, ends)`` gives the library's ids of each chunk alone, and how many."""

    def __init__(self, cut: Callable[[np.ndarray, np.ndarray], np.ndarray], encode: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], dtype: type = np.int32, block_bytes: int = BLOCK_BYTES) -> None:
        self.cut, self.encode, self.dtype, self.block_bytes = cut, encode, dtype, block_bytes
        self.reset()

    def reset(self) -> None:
        #: Codes of the kept chunks, sorted, and the entry of each.
        self.codes, self.entries = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.bytes = _Store(self.dtype), _Store(np.uint8)
        self.id_at, self.id_n, self.byte_at, self.byte_n = (_Store(np.int64) for _ in range(4))

    def _find(self, codes: np.ndarray) -> np.ndarray:
        """The entry of each code, or -1."""
        if not len(self.codes):
            return np.full(len(codes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.entries[at], -1)

    def _learn(self, codes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Keep chunks with these sorted codes."""
        ids, n_ids = self.encode(data, starts, ends)
        n_bytes = ends - starts
        at, byte_at, first = self.ids.add(ids), self.bytes.add(gather(data, starts, n_bytes)), self.id_n.used
        self.id_at.add(at + np.cumsum(n_ids) - n_ids)
        self.id_n.add(n_ids)
        self.byte_at.add(byte_at + np.cumsum(n_bytes) - n_bytes)
        self.byte_n.add(n_bytes)
        where = np.searchsorted(self.codes, codes)
        self.codes = np.insert(self.codes, where, codes)
        self.entries = np.insert(self.entries, where, np.arange(first, first + len(codes)))

    def _block(self, part: Slice, ids: np.ndarray, n_ids: np.ndarray, starts: np.ndarray) -> Block:
        sums = np.concatenate([[0], np.cumsum(n_ids)])
        return Block(part.first, part.n, ids, sums[np.searchsorted(starts, part.offsets)])

    def blocks(self, texts: pa.Array) -> Iterator[Block]:
        """The ids of all texts, some at a time; a null or empty text has none."""
        for part in slices(texts, self.block_bytes):
            data = part.data
            if not len(data):
                yield Block(part.first, part.n, np.zeros(0, self.dtype), np.zeros(part.n + 1, np.int64))
                continue
            starts = np.flatnonzero(self.cut(data, part.offsets))
            ends = np.append(starts[1:], len(data))
            codes, first_at, inverse = np.unique(codes_of(data, starts, ends), return_index=True, return_inverse=True)
            if len(self.codes) > KEPT_CHUNKS:
                self.reset()
            entry = self._find(codes)
            missing = np.flatnonzero(entry < 0)
            if len(missing):
                entry[missing] = np.arange(len(missing)) + self.id_n.used
                at = first_at[missing]
                self._learn(codes[missing], data, starts[at], ends[at])
            entry = entry[inverse]
            sizes = self.byte_n.data[entry]
            if not np.array_equal(sizes, ends - starts) or not np.array_equal(gather(self.bytes.data, self.byte_at.data[entry], sizes), data):
                # two chunks have one code: without the store
                yield self._block(part, *self.encode(data, starts, ends), starts)
                continue
            n_ids = self.id_n.data[entry]
            yield self._block(part, gather(self.ids.data, self.id_at.data[entry], n_ids), n_ids, starts)
