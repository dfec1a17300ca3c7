"""Periodic runs against a search through all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import queries, runs
from ledgerlight.llm.wordhash import mix

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def by_all_periods(w):
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                t = w[i : i + length]
                if not any(t[p:] == t[: length - p] for p in range(1, q)):
                    out.add((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def random_words(rng):
    k, out = rng.choice([1, 2, 2, 3, 5]), []
    for _ in range(rng.randint(0, 6)):
        p = [rng.randrange(k) for _ in range(rng.randint(1, 12))]
        out += (p * rng.randint(1, 9))[: rng.randint(0, 90)] + [rng.randrange(k + 2) for _ in range(rng.randint(0, 5))]
    return out


def codes(words):
    return mix(np.array(words, np.uint64) + np.uint64(1)) if words else np.zeros(0, np.uint64)


def found_in(docs):
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    got = runs.find(codes([x for d in docs for x in d]), bounds)
    out = [[] for _ in docs]
    for s, length, q in zip(*(x.tolist() for x in got), strict=True):
        i = int(np.searchsorted(bounds, s, "right")) - 1
        out[i].append((s - int(bounds[i]), length, q))
    return out


def test_random_words_against_all_periods():
    rng = random.Random(7)
    for _ in range(800):
        docs = [random_words(rng) for _ in range(rng.randint(1, 4))]
        assert found_in(docs) == [by_all_periods(d) for d in docs]


@pytest.mark.parametrize("q", [1, 2, 3, 4, 5, 8, 9, 31, 32, 33, 100])
def test_every_offset_and_the_least_length(q):
    period = list(range(10, 10 + q))
    for lead in range(9):
        for length in (max(6, 4 * q) - 1, max(6, 4 * q), 4 * q + q // 2 + 3):
            w = [1000 + i for i in range(lead)] + [period[i % q] for i in range(length)] + [5, 6, 7]
            assert found_in([w, w]) == [by_all_periods(w)] * 2


def test_all_alike_nested_and_aperiodic_words():
    fibonacci = [0], [0, 1]
    while len(fibonacci[1]) < 3000:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    nested = ([1, 1, 1, 1, 1, 1, 2] * 5 + [3]) * 4
    w = [[7] * 5000, fibonacci[1], nested, [], [4]]
    assert found_in(w) == [[(0, 5000, 1)], [], by_all_periods(nested), [], []]


def test_wavelet_tree_against_sorting():
    rng = np.random.default_rng(3)
    values = rng.permutation(1000)[:300]
    tree = runs.Wavelet(values, 10)
    low = rng.integers(0, 300, 200)
    high = low + rng.integers(1, 301 - low)
    x = rng.integers(0, 1001, 200)
    k = np.array([rng.integers(0, b - a) for a, b in zip(low, high, strict=True)])
    assert tree.below(low, high, x % 1000).tolist() == [int((values[a:b] < y % 1000).sum()) for a, b, y in zip(low, high, x, strict=True)]
    assert tree.smallest(low, high, k).tolist() == [int(np.sort(values[a:b])[i]) for a, b, i in zip(low, high, k, strict=True)]


def test_scan_of_odd_tables(spark, odd_docs, no_docs):
    docs = odd_docs.union(spark.createDataFrame([(50, "A\ta\x0bA a A a A a x", "k", 0.5), (51, "é é  é\né é é é", "k", 0.5), (52, " ".join(["w"] * 30_000), "k", 0.5)], odd_docs.schema)).withColumn("runs", F.lit(1))
    got = runs.scan(docs).collect()
    assert len(got) == docs.count() and runs.scan(no_docs).collect() == []
    for r in got:
        w = SPACED.findall(r.text or "")
        want = [(0, 30_000, 1)] if r.doc_id == 52 else by_all_periods(w) if len(w) < 1000 else [tuple(x) for x in r.runs]
        assert [tuple(x) for x in r.runs] == want and r.n_words == len(w) and r.collapsed == collapsed(w, want)
        assert r.key == "k" and r.score == 0.5


def test_query_against_all_periods(spark, data):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, data).collect()}
    n = planted = 0
    for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect():
        w = SPACED.findall(r.text or "")
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
        if len(w) > 4000:
            continue
        n, found = n + 1, by_all_periods(w)
        planted += bool(found)
        best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None,) * 3)
        row = got[r.doc_id]
        assert (row.n_runs, row.start, row.length, row.period) == (len(found), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert row.runs_sha256 == sha("".join(f"{s},{length},{q}\n" for s, length, q in found)) and row.collapsed_sha256 == sha(collapsed(w, found))
    assert n > 150 and planted > 5
