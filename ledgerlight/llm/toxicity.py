"""Toxicity by a factorization machine over hashed terms.

A text is the set of its words' hash buckets, once each however often they occur.
Linear weights catch words that are toxic anywhere; the factors' pairwise products
catch combinations, such as an insult and a mention of a group, that no sum of
weights can. Buckets that the labels say nothing about, neither alone nor beside
another one, are left out first (a two-sample test of each), so a long clean text
gathers no noise.

The machine is fitted with numpy on a bounded sample of labelled rows
(``TRAIN_ROWS``). Scoring reads whole texts as arrays and moves no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import remainder, sample
from .storage import bound_batches, lean
from .wordhash import ALPHANUMERIC, slices, words

#: Hash buckets; labelled rows that the fit takes at most, and of these the rows of each label whose pairs are counted.
BITS, TRAIN_ROWS, PAIR_ROWS = 20, 12_000, 1_500
#: A bucket stays with this z score in either direction and this many texts.
LEAST_Z, LEAST_TEXTS = 4.0, 3
#: So does a pair of buckets where, among the texts with either, the other has this score (root of the
#: likelihood ratio, as z scores mislead at small counts). Texts that each must have: no split of fewer with the one reaches it.
PAIR_Z = 6.0
PAIR_TEXTS = PAIR_Z**2 / (2 * np.log(2))
FACTORS, EPOCHS, RATE, DECAY, BATCH = 8, 60, 0.05, 1e-4, 256


class Machine(NamedTuple):
    """``slot`` maps a bucket to its row of weights and factors, or -1."""

    slot: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, texts: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
        """Scores before the logistic function of n texts with (text, bucket) pairs, each once."""
        rows = self.slot[buckets]
        known = rows >= 0
        texts, rows = texts[known], rows[known]
        out = np.full(n, self.bias) + np.bincount(texts, self.weights[rows], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[rows, f]
            out += 0.5 * (np.bincount(texts, v, n) ** 2 - np.bincount(texts, v * v, n))
        return out


def text_buckets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For texts some at a time: first, count, and the distinct (text, bucket) pairs."""
    for part in slices(texts):
        w = words(part, ALPHANUMERIC)
        doc = np.repeat(np.arange(part.n), np.diff(w.bounds))
        key = np.unique(doc.astype(np.uint64) << np.uint64(BITS) | w.codes >> np.uint64(64 - BITS))
        yield part.first, part.n, (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _bucket_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, n, doc, bucket in text_buckets(batch.column("text")):
            ends = np.searchsorted(doc, np.arange(n + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bucket, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(first, n), lists], names=["label", "buckets"])


def _ratio(inside: np.ndarray, outside: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """Twice the log likelihood ratio of two rates being one, for counts in ``positive`` and ``negative`` texts."""

    def part(k: np.ndarray, n: np.ndarray) -> np.ndarray:
        return k * np.log(np.maximum(k, 1)) + (n - k) * np.log(np.maximum(n - k, 1)) - n * np.log(np.maximum(n, 1))

    return 2 * (part(inside, positive) + part(outside, negative) - part(inside + outside, positive + negative))


def paired(doc: np.ndarray, bucket: np.ndarray, toxic: np.ndarray, columns: int = 256) -> np.ndarray:
    """Buckets that say something beside another one, whatever they say alone.

    Every pair of buckets is counted, in blocks, over ``PAIR_ROWS`` texts of each label
    (or all there are); ``doc`` ascends.
    """
    rng = np.random.default_rng(3)
    number = np.full(len(toxic), -1, np.int32)
    sizes = []
    for side in (toxic, ~toxic):
        ids = np.flatnonzero(side)
        ids = np.sort(rng.choice(ids, min(len(ids), PAIR_ROWS), replace=False))
        number[ids] = np.arange(len(ids), dtype=np.int32)
        sizes.append(len(ids))
    own = number[doc] >= 0
    doc, bucket = doc[own], bucket[own]
    total = np.bincount(bucket, minlength=1 << BITS)
    often = np.flatnonzero(total >= PAIR_TEXTS)
    place = np.full(len(total), -1, np.int32)
    place[often] = np.arange(len(often), dtype=np.int32)
    own = place[bucket] >= 0
    doc, bucket = doc[own], place[bucket[own]]
    sides = []
    for side, n in zip((toxic, ~toxic), sizes, strict=True):
        own = side[doc]
        sides.append((number[doc[own]], bucket[own], n))
    alone = [np.bincount(c, minlength=len(often)).astype(np.float64) for _, c, _ in sides]
    keep = np.zeros(len(often), bool)
    for first in range(0, len(often), columns):
        counts = []
        for d, c, n in sides:
            both = np.zeros((min(columns, len(often) - first), len(often)), np.float32)
            for at in range(0, n, columns):
                a, b = np.searchsorted(d, [at, at + columns])
                block = np.zeros((min(columns, n - at), len(often)), np.float32)
                block[d[a:b] - at, c[a:b]] = 1
                both += block[:, first : first + columns].T @ block
            counts.append(both.astype(np.float64))
        # each beside the other, so that a word isn't kept for the toxic words around it
        score = np.minimum(_ratio(*counts, *(x[first : first + columns, None] for x in alone)), _ratio(*counts, *(x[None] for x in alone)))
        i, j = np.nonzero(score >= PAIR_Z**2)
        keep[first + i] = keep[j] = True
    return often[keep]


def fit(lists: list[np.ndarray], labels: np.ndarray) -> Machine:
    """A machine for these texts' buckets; without both labels, one that scores all alike."""
    n, toxic = len(lists), labels.astype(bool)
    slot = np.full(1 << BITS, -1, np.int32)
    positive = int(toxic.sum())
    if not 0 < positive < n:
        rate = (positive + 0.5) / (n + 1)
        return Machine(slot, float(np.log(rate / (1 - rate))), np.zeros(0), np.zeros((0, FACTORS)))
    size = np.array([len(x) for x in lists])
    doc, bucket = np.repeat(np.arange(n, dtype=np.int32), size), np.concatenate(lists).astype(np.int32)
    inside = np.bincount(bucket[toxic[doc]], minlength=1 << BITS)
    total = np.bincount(bucket, minlength=1 << BITS)
    share = (total + 1) / (n + 2)
    z = (inside / positive - (total - inside) / (n - positive)) / np.sqrt(share * (1 - share) * (1 / positive + 1 / (n - positive)))
    alone = np.flatnonzero((np.abs(z) >= LEAST_Z) & (total >= LEAST_TEXTS))
    kept = np.union1d(alone, paired(doc, bucket, toxic))
    slot[kept] = np.arange(len(kept), dtype=np.int32)
    known = slot[bucket] >= 0
    doc, row = doc[known], slot[bucket[known]]
    starts = np.searchsorted(doc, np.arange(n + 1))
    rng = np.random.default_rng(7)
    w, v = np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), FACTORS))
    bias = float(np.log(positive / (n - positive)))
    # adaptive steps (Adagrad) on the logistic loss
    seen_w, seen_v, seen_b = np.full(len(kept), 1e-8), np.full((len(kept), FACTORS), 1e-8), 1e-8
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            chosen = np.sort(order[at : at + BATCH])
            counts = starts[chosen + 1] - starts[chosen]
            m = len(chosen)
            pos = np.arange(int(counts.sum())) + np.repeat(starts[chosen] - (np.cumsum(counts) - counts), counts)
            d, r = np.repeat(np.arange(m), counts), row[pos]
            vr = v[r]
            sums = np.zeros((m, FACTORS))
            np.add.at(sums, d, vr)
            squares = np.bincount(d, (vr * vr).sum(1), m)
            logit = bias + np.bincount(d, w[r], m) + 0.5 * ((sums * sums).sum(1) - squares)
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - toxic[chosen]) / m
            grad_w = np.bincount(r, error[d], len(kept)) + DECAY * w / max(1, n // BATCH)
            grad_v = np.zeros_like(v)
            np.add.at(grad_v, r, error[d][:, None] * (sums[d] - vr))
            grad_v += DECAY * v / max(1, n // BATCH)
            grad_b = float(error.sum())
            seen_w += grad_w**2
            seen_v += grad_v**2
            seen_b += grad_b**2
            w -= 4 * RATE * grad_w / np.sqrt(seen_w)
            v -= RATE * grad_v / np.sqrt(seen_v)
            bias -= RATE * grad_b / np.sqrt(seen_b)
    return Machine(slot, bias, w, v)


def train(docs: DataFrame, labels: DataFrame, divisor: int = 5, held_out: int = 0, rows: int = TRAIN_ROWS) -> Machine:
    """Fit on at most ``rows`` labelled documents whose remainder isn't ``held_out``."""
    bound_batches(docs.sparkSession)
    chosen = sample(labels, "toxic", divisor, held_out, rows)
    # bounded by ``rows``, so every task can hold the sample's ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("label", "text")
    got = texts.mapInArrow(lean(_bucket_lists), "label int, buckets array<int>").toArrow()
    flat = got.column("buckets").combine_chunks()
    offsets, values = flat.offsets.to_numpy(), flat.values.to_numpy()
    return fit([values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], got.column("label").to_numpy())


def score(docs: DataFrame, machine: Machine, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``; columns of these names are replaced.

    A null or empty text scores as one without words. Rows and other columns stay.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(machine)
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    source = docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text_col}`"].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            logits = np.full(batch.num_rows, m.bias)
            for first, n, doc, bucket in text_buckets(batch.column("__text")):
                logits[first : first + n] = m.logits(doc, bucket, n)
            p = 1 / (1 + np.exp(-np.clip(logits, -60, 60)))
            made = [pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + made, names=[*keep, "score", "predicted"])

    return source.mapInArrow(lean(run), schema)


def classify(docs: DataFrame, labels: DataFrame, divisor: int = 5, held_out: int = 0) -> DataFrame:
    """Train on the labelled rows that aren't held out and score every document."""
    scored = score(docs, train(docs, labels, divisor, held_out))
    return scored.withColumn("held_out", remainder("doc_id", divisor) == held_out)
