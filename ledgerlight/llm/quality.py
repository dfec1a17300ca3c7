"""Quality by a regularised quadratic discriminant over document statistics.

Each text gives a vector of transformed statistics (see :data:`FEATURES`). Each
class has a Gaussian whose covariance is shrunk towards the pooled one and that
towards its diagonal. The score is the logistic function of the difference of both
log densities, which the Cholesky factors kept with the model give as a
Mahalanobis norm and a log determinant.

The Gaussians are fitted with numpy on a bounded sample of labelled rows
(``TRAIN_ROWS``). Statistics and scores are of whole texts and move no rows.
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
from .wordhash import NON_SPACE, byte_class, slices, words

FEATURES = (
    "log_words", "log_word_length", "letters", "digits", "upper", "symbols", "stops", "lines", "spaces", "distinct_words",
    "repeated_neighbours", "top_word", "repeated_lines", "words_without_letters", "high_bytes",
)
TRAIN_ROWS = 12_000
#: Weight of the pooled covariance in a class's, and of the diagonal in both; the least variance.
POOLED, DIAGONAL, LEAST_VARIANCE = 0.2, 0.1, 1e-4
_UPPER, _LOWER, _DIGIT, _HIGH = byte_class((0x41, 0x5A)), byte_class((0x61, 0x7A)), byte_class((0x30, 0x39)), byte_class((0x80, 0xFF))
_STOP, _SPACE, _LINE = byte_class((0x2C, 0x2C), (0x2E, 0x2E), (0x3F, 0x3F), (0x3B, 0x3B)), byte_class((0x20, 0x20), (0x09, 0x0D)), byte_class((0x0A, 0x0A))
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _HIGH | _STOP | _SPACE)
_LETTER = _UPPER | _LOWER | _HIGH
_NOT_LINE = ~_LINE


def _counts(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _distinct(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's codes: how many differ, and how often the most frequent one occurs."""
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    order = np.lexsort((codes, doc))
    d, c = doc[order], codes[order]
    new = np.ones(len(c), bool)
    new[1:] = (d[1:] != d[:-1]) | (c[1:] != c[:-1])
    at = np.flatnonzero(new)
    sizes = np.diff(np.append(at, len(c)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, d[at], sizes)
    return np.bincount(d[at], minlength=n), top


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of :data:`FEATURES` for each text; an empty or null one has zeros. Shares are by square root, counts by log."""
    out = np.zeros((len(texts), len(FEATURES)))
    for part in slices(texts):
        data, off, n = part.data, part.offsets, part.n
        size = np.maximum(np.diff(off), 1)
        w, lines = words(part, NON_SPACE), words(part, _NOT_LINE)
        n_words, n_lines = np.diff(w.bounds), np.diff(lines.bounds)
        some, some_lines = np.maximum(n_words, 1), np.maximum(n_lines, 1)
        letter = _LETTER[data]
        upper, letters = _counts(_UPPER[data], off), _counts(letter, off)
        distinct, top = _distinct(w.codes, w.bounds)
        same = np.zeros(len(w.codes), bool)
        same[1:] = w.codes[1:] == w.codes[:-1]
        first = w.bounds[:-1][n_words > 0]
        same[first] = False
        line_kinds, _ = _distinct(lines.codes, lines.bounds)
        sums = np.concatenate([[0], np.cumsum(letter)])
        bare = sums[w.ends] == sums[w.starts]
        shares = [
            letters / size, _counts(_DIGIT[data], off) / size, upper / np.maximum(letters, 1), _counts(_SYMBOL[data], off) / size, _counts(_STOP[data], off) / some,
            n_lines / some, _counts(_SPACE[data], off) / size, distinct / some, _counts(same, w.bounds) / some, (top - 1).clip(0) / some,
            (n_lines - line_kinds) / some_lines, _counts(bare, w.bounds) / some, _counts(_HIGH[data], off) / size,
        ]
        rows = np.column_stack([np.log1p(n_words), np.log1p(_counts(~_SPACE[data], off) / some), *[np.sqrt(np.clip(s, 0, 1)) for s in shares]])
        rows[n_words == 0] = 0
        out[part.first : part.first + n] = rows
    return out


class Discriminant(NamedTuple):
    """Per class (0, 1): log prior, mean, and the inverse Cholesky factor of its covariance with the log determinant."""

    centre: np.ndarray
    scale: np.ndarray
    priors: np.ndarray
    means: np.ndarray
    whiten: np.ndarray
    logdets: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.centre) / self.scale
        density = [self.priors[k] - 0.5 * ((((x - self.means[k]) @ self.whiten[k].T) ** 2).sum(1) + self.logdets[k]) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -60, 60)))


def fit(x: np.ndarray, labels: np.ndarray) -> Discriminant:
    """Both Gaussians; a class without rows has the pooled one, so that all score by the priors alone."""
    d = x.shape[1] if x.size else len(FEATURES)
    centre = x.mean(0) if len(x) else np.zeros(d)
    scale = np.maximum(x.std(0), 1e-3) if len(x) else np.ones(d)
    z = (x - centre) / scale
    groups = [z[labels == k] for k in (0, 1)]
    means = np.array([g.mean(0) if len(g) else np.zeros(d) for g in groups])
    scatter = [(g - m).T @ (g - m) for g, m in zip(groups, means, strict=True)]
    pooled = sum(scatter) / max(len(z), 1)
    whiten, logdets = [], []
    for g, s in zip(groups, scatter, strict=True):
        own = s / len(g) if len(g) > d else pooled
        cov = (1 - POOLED) * own + POOLED * pooled
        cov = (1 - DIAGONAL) * cov + DIAGONAL * np.diag(np.diag(cov)) + LEAST_VARIANCE * np.eye(d)
        factor = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(factor))
        logdets.append(2 * np.log(np.diag(factor)).sum())
    share = np.array([len(g) + 1 for g in groups]) / (len(z) + 2)
    return Discriminant(centre, scale, np.log(share), means, np.array(whiten), np.array(logdets))


def _statistic_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column("text"))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("label"), lists], names=["label", "x"])


def train(docs: DataFrame, labels: DataFrame, divisor: int = 4, held_out: int = 2, rows: int = TRAIN_ROWS) -> Discriminant:
    """Fit on at most ``rows`` labelled documents whose remainder isn't ``held_out``."""
    bound_batches(docs.sparkSession)
    chosen = sample(labels, "quality", divisor, held_out, rows)
    # bounded by ``rows``, so every task can hold the sample's ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("label", "text")
    got = texts.mapInArrow(lean(_statistic_rows), "label int, x array<double>").toArrow()
    x = got.column("x").combine_chunks().values.to_numpy().reshape(-1, len(FEATURES))
    return fit(x, got.column("label").to_numpy())


def score(docs: DataFrame, model: Discriminant, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: better) and ``predicted``; columns of these names are replaced.

    A null or empty text has zero statistics and is scored by them. Rows and other
    columns stay.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    source = docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text_col}`"].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.scores(statistics(batch.column("__text")))
            made = [pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + made, names=[*keep, "score", "predicted"])

    return source.mapInArrow(lean(run), schema)


def classify(docs: DataFrame, labels: DataFrame, divisor: int = 4, held_out: int = 2) -> DataFrame:
    """Train on the labelled rows that aren't held out and score every document."""
    scored = score(docs, train(docs, labels, divisor, held_out))
    return scored.withColumn("held_out", remainder("doc_id", divisor) == held_out)
