"""Log likelihood of texts under a hidden Markov model of words.

Tokens are words and one end for each text. Words that make up a ``HEAD``-th of all
training tokens, and occur twice at least, are symbols of their own: at most ``HEAD``
of them, which every task can hold. Other words are one symbol in the chain, times
their smoothed share of its tokens, which a join looks up.

Counts of words and of the chain's states cover every training text. Baum-Welch
takes expected counts in tasks and sums them over all partitions, first over a fixed
share of the texts, then over all of them. Each text's likelihood is exact: a scaled forward recursion over the whole text. Texts are
cut into segments that numpy walks side by side; products of a segment's transition
matrices give the recursion's state at its ends, so nothing is lost at a cut.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import remainder
from .storage import Workspace, bound_batches, lean
from .wordhash import NON_SPACE, mix, slices, words

#: Latent states; a word is a symbol if its share of training tokens is 1 / HEAD or more.
STATES, HEAD = 8, 500_000
#: Baum-Welch rounds, each with the share of the training texts that it goes over: one text in 16, then all.
ROUNDS = ((16, 8), (1, 2))
#: How likely a state stays to begin with.
LASTING = 0.9
#: Counts added to the transitions of a state, and to its emissions in the words' overall shares.
LEAST_MOVES, PRIOR = 0.5, 20.0
#: Tokens of a segment, and those walked together.
SEGMENT, TOGETHER = 1024, 1 << 18
OTHER, END, FIRST = 0, 1, 2
#: The transition matrices' products are scaled once in so many tokens.
SCALED = 8


class Index:
    """Place of 64-bit codes in an array without repeats; -1 for others."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        size = 1 << max(4, (4 * len(codes)).bit_length())
        self.mask = np.uint64(size - 1)
        self.slots = np.full(size, -1, np.int32)
        live, slot = np.arange(len(codes), dtype=np.int32), (codes & self.mask).astype(np.int64)
        while len(live):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = live[free]
            left = self.slots[slot] != live
            live, slot = live[left], (slot[left] + 1) & (size - 1)

    def find(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), -1, np.int32)
        live, slot = np.arange(len(codes)), (codes & self.mask).astype(np.int64)
        while len(live):
            at = self.slots[slot]
            some = at >= 0
            live, slot, at = live[some], slot[some], at[some]
            same = self.codes[at] == codes[live]
            out[live[same]] = at[same]
            live, slot = live[~same], (slot[~same] + 1) & (len(self.slots) - 1)
        return out


class Vocabulary(NamedTuple):
    """Codes and counts of the symbols that are words; N, V; tokens and kinds of other training words; count of ends."""

    codes: np.ndarray
    counts: np.ndarray
    tokens: int
    kinds: int
    other_tokens: int
    other_kinds: int
    ends: int

    def shares(self) -> np.ndarray:
        """Of each symbol, the smoothed share of training tokens."""
        c = np.concatenate([[self.other_tokens, self.ends], self.counts]) + 1.0
        return c / c.sum()


class Chain(NamedTuple):
    """First states, transitions, and emissions by symbol and state."""

    first: np.ndarray
    moves: np.ndarray
    emit: np.ndarray


def begin(vocabulary: Vocabulary, states: int, lasting: float = LASTING) -> Chain:
    """Lasting states whose emissions differ from the words' shares at random, by the words' codes."""
    shares = vocabulary.shares()
    codes = np.concatenate([np.zeros(FIRST, np.uint64), vocabulary.codes])
    noise = np.column_stack([mix(codes ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) for k in range(states)])
    emit = shares[:, None] * (0.25 + 1.5 * (noise >> np.uint64(11)).astype(float) / (1 << 53))
    emit[:FIRST] = shares[:FIRST, None]
    moves = np.full((states, states), (1 - lasting) / max(states - 1, 1))
    np.fill_diagonal(moves, lasting if states > 1 else 1.0)
    return Chain(np.full(states, 1 / states), moves, emit / emit.sum(0))


class Counts(NamedTuple):
    """Expected counts of first states, transitions and emissions."""

    first: np.ndarray
    moves: np.ndarray
    emit: np.ndarray


def no_counts(symbols: int, states: int) -> Counts:
    return Counts(np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)))


def improved(counts: Counts, shares: np.ndarray) -> Chain:
    """The chain that fits expected counts, smoothed."""
    first, moves = counts.first + LEAST_MOVES, counts.moves + LEAST_MOVES
    emit = counts.emit + PRIOR * shares[:, None]
    return Chain(first / first.sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(0))


class _Segments(NamedTuple):
    """Segments of texts in order: where they start, how long they are, their text and their number in it."""

    start: np.ndarray
    length: np.ndarray
    text: np.ndarray
    number: np.ndarray


def _cut(bounds: np.ndarray) -> _Segments:
    sizes = np.diff(bounds)
    many = -(-sizes // SEGMENT)
    text = np.repeat(np.arange(len(sizes)), many)
    number = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    start = bounds[:-1][text] + number * SEGMENT
    return _Segments(start, np.minimum(SEGMENT, bounds[1:][text] - start), text, number)


def _groups(length: np.ndarray) -> Iterator[np.ndarray]:
    """Segments, longest first, in groups of about TOGETHER tokens."""
    order = np.argsort(-length, kind="stable")
    group = np.cumsum(length[order]) // TOGETHER
    yield from np.split(order, np.flatnonzero(np.diff(group)) + 1) if len(order) else ()


def _active(length: np.ndarray) -> np.ndarray:
    """Of segments, longest first: how many reach each step."""
    return np.searchsorted(-length, -np.arange(length[0]), "left")


def _products(chain: Chain, ids: np.ndarray, s: _Segments) -> np.ndarray:
    """Of each segment, the scaled product of transitions and emissions over its tokens."""
    k = len(chain.first)
    out = np.empty((len(s.start), k, k))
    for g in _groups(s.length):
        start, active = s.start[g], _active(s.length[g])
        # whatever stands before a text, it begins in the first states
        m = np.where((s.number[g] == 0)[:, None, None], chain.first[None, None, :], chain.moves) * chain.emit[ids[start]][:, None, :]
        for t in range(1, len(active)):
            a = active[t]
            m[:a] = (m[:a].reshape(-1, k) @ chain.moves).reshape(a, k, k) * chain.emit[ids[start[:a] + t]][:, None, :]
            if t % SCALED == 0:
                m[:a] /= m[:a].max((1, 2), keepdims=True)
        out[g] = m / m.max((1, 2), keepdims=True)
    return out


def _ends(chain: Chain, ids: np.ndarray, s: _Segments, back: bool) -> tuple[np.ndarray, np.ndarray]:
    """States before each segment, and (``back``) how likely what follows it is from each state, but for a factor."""
    k, n = len(chain.first), len(s.start)
    before, after = np.full((n, k), 1 / k), np.ones((n, k))
    long = np.flatnonzero(s.length[:-1] + s.length[1:] > SEGMENT) if n > 1 else np.zeros(0, np.int64)
    some = np.unique(np.concatenate([long[s.text[long] == s.text[long + 1]], long[s.text[long] == s.text[long + 1]] + 1]))
    if not len(some):
        return before, after
    where = np.full(n, -1)
    where[some] = np.arange(len(some))
    products = _products(chain, ids, _Segments(*(x[some] for x in s)))
    by_number = np.argsort(s.number[some], kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(s.number[some][by_number], prepend=-1)), len(some))
    rows = [some[by_number[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for at in rows[1:]:
        v = np.einsum("si,sij->sj", before[at - 1], products[where[at - 1]])
        before[at] = v / v.sum(1, keepdims=True)
    for at in rows[:0:-1] if back else ():
        v = np.einsum("sij,sj->si", products[where[at]], after[at])
        after[at - 1] = v / v.sum(1, keepdims=True)
    return before, after


def walk(chain: Chain, ids: np.ndarray, bounds: np.ndarray, counts: Counts | None = None) -> np.ndarray:
    """Natural log likelihood of each text; expected counts are added to ``counts``.

    Text ``i`` has the symbols ``ids[bounds[i]:bounds[i + 1]]``, one at least.
    """
    s = _cut(bounds)
    before, after = _ends(chain, ids, s, counts is not None)
    logs = np.zeros(len(s.start))
    back = np.ascontiguousarray(chain.moves.T)
    for g in _groups(s.length):
        start, active, fresh = s.start[g], _active(s.length[g]), s.number[g] == 0
        offsets = np.concatenate([[0], np.cumsum(active)])
        symbols = np.concatenate([ids[start[:a] + t] for t, a in enumerate(active)])
        emit = chain.emit[symbols]
        alpha, scale = np.empty_like(emit), np.empty(len(symbols))
        for t, a in enumerate(active):
            here = slice(offsets[t], offsets[t + 1])
            v = np.where(fresh[:, None], chain.first, before[g] @ chain.moves) if t == 0 else alpha[offsets[t - 1] : offsets[t - 1] + a] @ chain.moves
            v *= emit[here]
            scale[here] = c = v.sum(1)
            alpha[here] = v / c[:, None]
        log = np.log(scale)
        for t, a in enumerate(active):
            logs[g[:a]] += log[offsets[t] : offsets[t + 1]]
        if counts is None:
            continue
        gamma = alpha
        emit /= scale[:, None]
        beta = after[g]
        for t in range(len(active) - 1, -1, -1):
            here, a = slice(offsets[t], offsets[t + 1]), active[t]
            b = beta[:a]
            if t + 1 < len(active):
                n = active[t + 1]
                b[:n] = emit[offsets[t + 1] : offsets[t + 1] + n] @ back  # holds emission times beta by now
            own = alpha[here] * b
            total = own.sum(1, keepdims=True)
            emit[here] *= b
            came = alpha[offsets[t - 1] : offsets[t - 1] + a] if t else before[g]
            flow = emit[here] / total
            if t == 0:
                counts.first[:] += (own / total)[fresh].sum(0)
                came, flow = came[~fresh], flow[~fresh]
            counts.moves[:] += chain.moves * (came.T @ flow)
            gamma[here] = own / total
        for k in range(gamma.shape[1]):
            counts.emit[:, k] += np.bincount(symbols, gamma[:, k], len(counts.emit))
    return np.bincount(s.text, logs, len(bounds) - 1)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [words(part, NON_SPACE).codes for part in slices(batch.column("text"))]
        codes, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
        ends = [pa.array([None], pa.int64()), pa.array([batch.num_rows])]
        yield pa.RecordBatch.from_arrays(ends, names=["code", "c"])
        yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(counts)], names=["code", "c"])


def _vocabulary(work: Workspace, texts: DataFrame, head: int) -> tuple[Vocabulary, DataFrame]:
    """The symbols, and ``code, c`` of other training words."""
    counted = texts.mapInArrow(lean(_count_rows), "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))
    counted = work.put(counted, "counts")
    tokens, kinds, ends = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("code").isNull(), F.col("c"))), F.lit(0))).first()
    least = max(2, -(-tokens // head))
    of_words = counted.where(F.col("code").isNotNull())
    # as many as a HEAD-th of all tokens each: HEAD rows at most
    got = of_words.where(F.col("c") >= least).orderBy("code").toArrow()
    codes, counts = got.column("code").to_numpy().view(np.uint64), got.column("c").to_numpy()
    rest = of_words.where(F.col("c") < least)
    other_tokens = tokens - ends - int(counts.sum())
    return Vocabulary(codes, counts, tokens, kinds, other_tokens, kinds - len(codes) - (ends > 0), ends), rest


def _encoded(work: Workspace, texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``row, id, learn, ids`` (little-endian 32-bit symbols with the end) ``, codes, times`` of the words that are no symbols."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary.codes)
    kept = ["id", "learn"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for batch in batches:
            for part in slices(batch.column("text")):
                w = words(part, NON_SPACE)
                sizes = np.diff(w.bounds)
                text = np.repeat(np.arange(part.n), sizes)
                symbols = np.full(len(w.codes) + part.n, END, "<i4")
                found = index.find(w.codes)
                symbols[np.arange(len(text)) + text] = np.where(found < 0, OTHER, found + FIRST)
                bounds = w.bounds + np.arange(part.n + 1)
                codes, owner = w.codes[found < 0], text[found < 0]
                order = np.lexsort((codes, owner))
                codes, owner = codes[order], owner[order]
                new = np.ones(len(codes), bool)
                new[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
                at = np.flatnonzero(new)
                lists = pa.array(np.searchsorted(owner[at], np.arange(part.n + 1)), pa.int32())
                times = np.diff(np.append(at, len(codes))).astype(np.int32)
                made = [
                    pa.Array.from_buffers(pa.binary(), part.n, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(symbols)]),
                    pa.ListArray.from_arrays(lists, pa.array(codes[at].view(np.int64))), pa.ListArray.from_arrays(lists, pa.array(times)),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(part.first, part.n) for c in kept] + made, names=[*kept, "ids", "codes", "times"])

    schema = f"id {texts.schema['id'].dataType.simpleString()}, learn boolean, ids binary, codes array<long>, times array<int>"
    return work.put(texts.mapInArrow(lean(run), schema).withColumn("row", F.monotonically_increasing_id()), "symbols")


def _symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts of a batch one after another, and their bounds."""
    if not len(column):
        return np.zeros(0, "<i4"), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes()
    return np.frombuffer(raw, "<i4"), (offsets - offsets[0]) // 4


def _expected(texts: DataFrame, chain: Chain) -> Counts:
    """Expected counts under ``chain``, summed over all tasks; a row for each symbol that a task met."""
    shared = texts.sparkSession.sparkContext.broadcast(chain)
    symbols, states = chain.emit.shape
    names = [f"e{k}" for k in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = no_counts(symbols, states)
        for batch in batches:
            walk(shared.value, *_symbols(batch.column("ids")), counts)
        some = np.flatnonzero(counts.emit.any(1))
        if len(some):
            # below the symbols: the first states, then transitions by state
            key = np.concatenate([np.arange(-1 - states, 0), some]).astype(np.int32)
            rows = np.concatenate([counts.moves[::-1], counts.first[None], counts.emit[some]])
            yield pa.RecordBatch.from_arrays([pa.array(key), *[pa.array(rows[:, k]) for k in range(states)]], names=["symbol", *names])

    summed = texts.select("ids").mapInArrow(lean(run), f"symbol int, {', '.join(f'{n} double' for n in names)}").groupBy("symbol").agg(*[F.sum(n).alias(n) for n in names])
    got = summed.toArrow()  # as many rows as the chain has symbols at most
    out, key = no_counts(symbols, states), got.column("symbol").to_numpy()
    values = np.column_stack([got.column(n).to_numpy() for n in names]) if len(key) else np.zeros((0, states))
    out.emit[key[key >= 0]] = values[key >= 0]
    out.moves[-2 - key[key < -1]] = values[key < -1]
    out.first[:] = values[key == -1].sum(0)
    shared.destroy()
    return out


def _learnt(encoded: DataFrame, vocabulary: Vocabulary, chain: Chain, rounds: Sequence[tuple[int, int]]) -> Chain:
    learn, shares = encoded.where("learn"), vocabulary.shares()
    for share, times in rounds:
        texts = learn.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(share)) == 0)
        for _ in range(times):
            chain = improved(_expected(texts, chain), shares)
    return chain


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, head: int = HEAD, rounds: Sequence[tuple[int, int]] = ROUNDS, lasting: float = LASTING) -> DataFrame:
    """A row for each row of ``docs``: ``id_col, n_tokens, n_known, train_tokens, base_score, score``.

    Texts where ``learn`` is true train the model; all are scored. ``n_known`` counts the
    tokens that occur in training texts, ``base_score`` is the log10 probability under
    their add-one unigram model, ``score`` under the hidden Markov model. A null text is
    empty and has the end alone. Repeated rows are scored each; other columns are
    ignored; without training texts all tokens are unknown.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    work = Workspace(spark, "hmm")
    texts = docs.select(docs[f"`{id_col}`"].alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"))
    vocabulary, rest = _vocabulary(work, texts.where("learn"), head)
    encoded = _encoded(work, texts, vocabulary)
    chain = _learnt(encoded, vocabulary, begin(vocabulary, states, lasting), rounds)
    seen = np.concatenate([[0, vocabulary.ends], vocabulary.counts])
    shared = spark.sparkContext.broadcast((chain, seen > 0, np.log10(seen + 1.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, logs = shared.value
        for batch in batches:
            ids, bounds = _symbols(batch.column("ids"))
            text = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            sums = [np.bincount(text, v, batch.num_rows) for v in (known[ids], ids == OTHER, logs[ids])]
            made = [pa.array(np.diff(bounds)), *[pa.array(v.astype(np.int64)) for v in sums[:2]], pa.array(sums[2]), pa.array(walk(model, ids, bounds) / np.log(10))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), *made], names=["row", "id", "n_tokens", "known", "others", "logs", "chain"])

    walked = encoded.select("row", "id", "ids").mapInArrow(lean(run), f"row long, id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, known long, others long, logs double, chain double")
    # words that are no symbols; those that training texts lack add nothing
    others = encoded.select("row", F.explode(F.arrays_zip("codes", "times")).alias("w")).select("row", F.col("w.codes").alias("code"), F.col("w.times").alias("times"))
    sums = others.join(rest, "code").groupBy("row").agg(F.sum("times").alias("some"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"))
    v = vocabulary
    more, some = F.coalesce("more", F.lit(0.0)), F.coalesce("some", F.lit(0))
    base = F.col("logs") + more - F.col("n_tokens") * float(np.log10(v.tokens + v.kinds + 1))
    total = F.col("chain") + more - F.col("others") * float(np.log10(v.other_tokens + v.other_kinds + 1))
    return walked.join(sums, "row", "left").select(F.col("id").alias(id_col), "n_tokens", (F.col("known") + some).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), total.alias("score"))


def classify(docs: DataFrame, divisor: int = 7, held_out: int = 2) -> DataFrame:
    """Train on the texts whose remainder isn't ``held_out`` and score every document."""
    out = score(docs, remainder("doc_id", divisor) != held_out)
    return out.withColumn("held_out", remainder("doc_id", divisor) == held_out)
