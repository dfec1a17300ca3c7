"""Secret scans: fixed patterns, and credentials linked from parts.

Three patterns are reported wherever they match. Parts of a credential are weak by
themselves: an access identifier, a random-looking token, an endpoint. They are
reported only where complementary parts stand together: within one paragraph, a
token that lies inside the reach of an identifier or an endpoint. The link is an
interval join by sorted positions, so a text with very many parts costs no more
than sorting them.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .storage import bound_batches, lean

#: Kinds in the order that ties of a start follow; the last three are linked parts.
KINDS = ("assign", "access", "hex", "identifier", "token", "endpoint")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A whole run of hexadecimal digits of the least length, as a run is matched from its first digit.
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
#: Parts: who, what with, and where.
IDENTIFIER = re.compile(r"""(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})""", re.ASCII | re.IGNORECASE)
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"(?:[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+|(?:host|endpoint|server|url)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]+(?::[0-9]{2,5})?)", re.ASCII | re.IGNORECASE)
#: A paragraph ends at an empty line; parts link over so many characters in one.
SCOPE = re.compile(r"\n[\x20\t]*\n")
REACH = 400
#: Bits for each character that a random token has at least, and characters of two kinds at least.
LEAST_BITS = 3.2


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def base_spans(text: str) -> list[Span]:
    """Matches of the three patterns, by start and kind."""
    found = [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [Span(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def looks_random(token: str) -> bool:
    """Letters and digits in turn, and characters spread as in a random string."""
    kinds = bool(re.search("[a-z]", token)) + bool(re.search("[A-Z]", token)) + bool(re.search("[0-9]", token))
    bits = -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values())
    return kinds >= 2 and any(c.isdigit() for c in token) and bits >= LEAST_BITS


def _within(lows: np.ndarray, highs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each interval, whether one of the sorted parts ``starts, ends`` overlaps it."""
    if not len(starts):
        return np.zeros(len(lows), bool)
    reach = np.maximum.accumulate(ends)
    before = np.searchsorted(starts, highs, "left")
    return (before > 0) & (reach[np.maximum(before - 1, 0)] > lows)


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Parts whose complement stands in reach; none that a base span covers."""
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text) if looks_random(m.group())]
    if not tokens and not base:
        return []
    identifiers = [m.span() for m in IDENTIFIER.finditer(text)]
    endpoints = [m.span() for m in ENDPOINT.finditer(text)]
    if not identifiers and not endpoints and not any(b.kind == 1 for b in base):
        return []
    breaks = np.array([0, *[m.end() for m in SCOPE.finditer(text)], len(text) + 1])
    covered = np.array([(b.start, b.end) for b in base], np.int64).reshape(-1, 2)

    def intervals(spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        a = np.array(sorted(spans), np.int64).reshape(-1, 2)
        return a[:, 0], a[:, 1]

    def reached(spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts, ends = intervals(spans)
        scope = np.searchsorted(breaks, starts, "right") - 1
        return starts, ends, np.maximum(starts - REACH, breaks[scope]), np.minimum(ends + REACH, breaks[scope + 1])

    secret = tokens + [(b.start, b.end) for b in base if b.kind != 1]
    who = identifiers + [(b.start, b.end) for b in base if b.kind == 1]
    out: list[Span] = []
    s_start, s_end, low, high = reached(secret)
    linked = _within(low, high, *intervals(who)) | _within(low, high, *intervals(endpoints))
    pairs = list(zip(s_start[linked].tolist(), s_end[linked].tolist(), strict=True))
    for kind, spans in ((3, identifiers), (4, tokens), (5, endpoints)):
        starts, ends, low, high = reached(spans)
        keep = np.isin(starts, s_start[linked]) if kind == 4 else _within(low, high, *intervals(pairs))
        keep &= ~_within(starts, ends, covered[:, 0], covered[:, 1])
        out += [Span(s, kind, e) for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]
    return out


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones together) replaced by a mark of its first kind."""
    out, at = [], 0
    for s in sorted(spans):
        if s.end <= at:
            continue
        if s.start >= at:
            out += [text[at : s.start], f"[{KINDS[s.kind]}]"]
        at = s.end
    return "".join([*out, text[at:]])


_OUTPUTS = {"n_assign": T.LongType(), "n_access": T.LongType(), "n_hex": T.LongType(), "base_sha256": T.StringType(), "spans": T.StringType(), "redacted": T.StringType()}


def scan(docs: DataFrame, outputs: tuple[str, ...] = ("n_assign", "n_access", "n_hex", "base_sha256", "spans"), text_col: str = "text") -> DataFrame:
    """``docs`` with the named outputs; a column of that name is replaced.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and kind.
    ``base_sha256`` digests those of the three patterns, ``spans`` lists the linked
    parts too, ``redacted`` is the text without any of them (null if it is null). A
    null or empty text has no spans. Rows and other columns stay as they are, so
    repeated rows do too. No shuffle.
    """
    bound_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in outputs]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(o, _OUTPUTS[o]) for o in outputs])
    kinds = [pa.int64() if isinstance(_OUTPUTS[o], T.LongType) else pa.string() for o in outputs]
    source = docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text_col}`"].alias("__text"))

    def values(text: str | None) -> tuple:
        base = base_spans(text or "")
        spans = sorted(base + linked_spans(text or "", base))
        got = {
            "n_assign": sum(s.kind == 0 for s in base),
            "n_access": sum(s.kind == 1 for s in base),
            "n_hex": sum(s.kind == 2 for s in base),
            "base_sha256": hashlib.sha256(spelled(base).encode()).hexdigest(),
            "spans": spelled(spans),
            "redacted": text and redacted(text, spans),
        }
        return tuple(got[o] for o in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [values(t) for t in batch.column("__text").to_pylist()]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + made, names=[*keep, *outputs])

    return source.mapInArrow(lean(run), schema)
