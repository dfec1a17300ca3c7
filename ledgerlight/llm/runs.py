"""Periodic runs of words by internal pattern matching.

A run is a maximal stretch of words with smallest period ``q`` that holds it four
times over. For each dyadic length ``b`` the text has blocks at a fixed stride; a run
with ``b / 2 < q <= b`` (any ``q <= 4`` for the shortest blocks) contains a whole block and room for
another occurrence of it beside, and the nearest one stands exactly ``q`` away, as a
block that holds a whole period occurs in its run at multiples of ``q`` alone.

Occurrences come from a suffix array made by naming blocks of doubled length, which
gives every block its interval of the array. A wavelet tree over the array answers
range successor queries: the nearest occurrences after and before the block, in the
windows of length ``b`` beside it. Their distances, the steps of the progressions
that occurrences form there, are the candidate periods. Matches with one period are
joined into stretches, compared word by word beyond their ends, and kept where they
are long enough.

Suffixes whose first four words occur once in their text take no part, so plain prose
costs one sort. Words are told apart by the 64-bit codes of ``wordhash``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .storage import bound_batches, lean
from .wordcache import gather
from .wordhash import NON_SPACE, Words, mix, slices, words

#: The least length of a run, and the periods that it holds at least.
LEAST, TIMES = 6, 4
#: Words of the shortest blocks and their stride: every run of LEAST words and a period of up to BASE holds one.
BASE, STRIDE = 4, 3
#: Texts are joined up to so many bytes; stretches are compared in so many words at once, so many stretches together.
JOINED_BYTES, AHEAD, TOGETHER = 1 << 20, 64, 4096


class Wavelet:
    """A wavelet tree over distinct numbers, as one bit column for each binary digit."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.levels: list[tuple[int, np.ndarray]] = []
        for bit in range(bits - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            self.levels.append((bit, np.concatenate([[0], np.cumsum(~ones)])))
            values = np.concatenate([values[~ones], values[ones]])

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Of each interval of places, how many numbers are less than ``x``."""
        count = np.zeros(len(x), np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[low], zeros[high]
            one = (x >> bit & 1).astype(bool)
            count += np.where(one, b - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return count

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Of each interval, the number with ``k`` less ones."""
        out = np.zeros(len(k), np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[low], zeros[high]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            out += np.where(one, 1 << bit, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return out


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: for each place, where its group starts and how large it is."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(keys)))
    return np.repeat(first, sizes), np.repeat(sizes, sizes)


def _blocks(codes: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The suffix array of repeated suffixes, and for each length the blocks that occur twice: ``b``, places, and their intervals."""
    n = len(codes)
    starts = np.flatnonzero(np.arange(n) + BASE <= ends)
    key = mix(doc[starts].astype(np.uint64) + np.uint64(1))
    for j in range(BASE):
        key = mix(key ^ codes[starts + j])
    order = np.argsort(key)
    first, sizes = _grouped(key[order])
    often = sizes > 1
    places, group = starts[order][often], first[often]
    order = np.lexsort((places, group))
    suffixes, group = places[order], group[order]
    m = len(suffixes)
    if not m:
        return suffixes, []
    # a suffix's name is the first place of its group; one that isn't in the array has a name of its own
    name = m + np.arange(n)
    first, sizes = _grouped(group)
    name[suffixes] = first
    live, b, found = np.arange(m), BASE, []
    while len(live):
        at = suffixes[live]
        first, sizes = name[at], sizes[sizes > 1]
        aligned = at % (STRIDE if b == BASE else b) == 0
        found.append((b, at[aligned], first[aligned], first[aligned] + sizes[aligned]))
        inside = at + 2 * b <= ends[at]
        after = np.where(inside, name[np.minimum(at + b, n - 1)], m + at)
        key = first * (m + n + 1) + after
        order = np.lexsort((at, key))
        suffixes[live] = at = at[order]
        first, sizes = _grouped(key[order])
        name[at] = live[first]
        live, b = live[sizes > 1], 2 * b
    return suffixes, found


def _matches(codes: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``at, period, length``: stretches equal to those a period later, from the nearest occurrences of blocks."""
    suffixes, found = _blocks(codes, doc, ends)
    none = np.zeros(0, np.int64)
    out = [(none, none, none)]
    if found:
        tree = Wavelet(suffixes, len(codes).bit_length())
        b = np.concatenate([np.full(len(f[1]), f[0]) for f in found])
        at, low, high = (np.concatenate([f[i] for f in found]) for i in (1, 2, 3))
        before = tree.below(low, high, at)
        for step in (1, -1):
            k = before + step
            some = np.flatnonzero((k >= 0) & (k < high - low))
            other = tree.smallest(low[some], high[some], k[some])
            period = np.abs(other - at[some])
            near = period <= b[some]
            out.append((np.minimum(other, at[some])[near], period[near], b[some][near]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _joined(at: np.ndarray, period: np.ndarray, length: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one period that touch become one: ``start, end, period``."""
    kinds, kind = np.unique(period, return_inverse=True)
    low = kind * (n + 1) + at
    order = np.argsort(low, kind="stable")
    low = low[order]
    reach = np.maximum.accumulate(low + length[order])
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first, len(low))[1:] - 1
    base = low[first] // (n + 1)
    return low[first] - base * (n + 1), reach[last] - base * (n + 1), kinds[base]


def _extend(codes: np.ndarray, at: np.ndarray, period: np.ndarray, bound: np.ndarray, step: int) -> np.ndarray:
    """From each place on, forwards or back, how many words equal those a period later (within ``bound`` words)."""
    out = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    ahead = np.arange(AHEAD)
    while len(live):
        reach = out[live][:, None] + ahead
        ok = reach < bound[live][:, None]
        x = np.where(ok, at[live][:, None] + step * reach, 0)
        ok &= codes[x] == codes[np.where(ok, x + period[live][:, None], 0)]
        stop = np.where(ok.all(1), AHEAD, np.argmin(ok, 1))
        out[live] += stop
        live = live[stop == AHEAD]
    return out


class Runs(NamedTuple):
    """By start and period; places are counted through all texts."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def find(codes: np.ndarray, bounds: np.ndarray) -> Runs:
    """All runs of texts that stand one after another; ``bounds`` has where each begins, and the end."""
    n = len(codes)
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    ends, begins = bounds[1:][doc], bounds[:-1][doc]
    start, end, period = _joined(*_matches(codes, doc, ends), n)
    for i in range(0, len(start), TOGETHER):
        s, e, q = start[i : i + TOGETHER], end[i : i + TOGETHER], period[i : i + TOGETHER]
        right = _extend(codes, e, q, ends[s] - q - e, 1)
        left = _extend(codes, s - 1, q, s - begins[s], -1)
        s -= left
        e += right
    length = end - start + period
    long = length >= np.maximum(LEAST, TIMES * period)
    rows = np.unique(np.column_stack([start, period, length])[long], axis=0)
    return Runs(rows[:, 0], rows[:, 2], rows[:, 1])


def _kept(n: int, runs: Runs) -> np.ndarray:
    """Words that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs.start + runs.period, 1)
    np.add.at(change, runs.start + runs.length, -1)
    return np.cumsum(change)[:n] == 0


def _texts(data: np.ndarray, w: Words, pick: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Of each text, the picked words with a space between."""
    counts = np.diff(bounds)
    gap = np.ones(len(pick), np.int64)
    gap[bounds[1:][counts > 0] - 1] = 0
    sizes = w.ends[pick] - w.starts[pick] + gap
    store = np.append(data, np.uint8(0x20))
    out = gather(store, w.starts[pick], sizes)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    out[upto[1:][gap == 1] - 1] = 0x20
    return pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(upto[bounds].astype(np.int32)), pa.py_buffer(out)])


#: From which word on a text is taken as a repetition of so many words; (None, count of words) -> None leaves it.
Tail = Callable[[int | None, int], tuple[int, int] | None]

_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_OUT = {"n_words": T.LongType(), "runs": T.ArrayType(_RUN), "collapsed": T.StringType()}


def scan(docs: DataFrame, tail: Tail | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (``start, length, period``, in words, by start and period) and ``collapsed``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``collapsed`` has the words that no
    run holds after its first period, with one space between. ``tail`` gives, by the id
    and the count of words, from where on a text is to be taken as repeating its next
    so many words.

    A null or empty text has no runs and an empty ``collapsed``. Columns of these names
    are replaced; rows and other columns stay, so repeated rows do too. A task holds one
    whole text at least; no shuffle.
    """
    bound_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in _OUT]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, kind) for c, kind in _OUT.items()])
    source = docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text_col}`"].alias("__text"), docs[f"`{id_col}`"].alias("__id"))

    def part_rows(part, ids: list) -> tuple[np.ndarray, Runs, np.ndarray, pa.Array]:
        w = words(part, NON_SPACE, lower=False)
        pick = np.arange(len(w.codes))
        if tail:
            for i, doc_id in enumerate(ids):
                low, high = int(w.bounds[i]), int(w.bounds[i + 1])
                repeated = tail(doc_id, high - low)
                if repeated:
                    a, p = repeated
                    pick[low + a : high] = low + a + np.arange(high - low - a) % p
        runs = find(w.codes[pick], w.bounds)
        kept = _kept(len(pick), runs)
        left = np.concatenate([[0], np.cumsum(kept)])[w.bounds]
        owner = np.searchsorted(w.bounds, runs.start, "right") - 1
        local = Runs(runs.start - w.bounds[owner], runs.length, runs.period)
        return np.diff(w.bounds), local, np.bincount(owner, minlength=part.n), _texts(part.data, w, pick[kept], left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("__id").to_pylist() if tail else []
            for part in slices(batch.column("__text"), JOINED_BYTES):
                n_words, runs, counts, collapsed = part_rows(part, ids[part.first : part.first + part.n])
                fields = pa.StructArray.from_arrays([pa.array(x) for x in runs], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), fields)
                made = [pa.array(n_words), lists, collapsed]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(part.first, part.n) for i in range(len(keep))] + made, names=[*keep, *_OUT])

    return source.mapInArrow(lean(run), schema)
