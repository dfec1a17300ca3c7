"""The hidden Markov language model against plain recursions and counts."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import hmm, queries
from ledgerlight.llm.wordhash import mix

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def tokens(text):
    return [*SPACED.findall((text or "").translate(LOWER)), None]


def random_chain(rng, states, symbols):
    return hmm.Chain(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(symbols), states).T.copy())


def packed(texts):
    return np.concatenate(texts).astype(np.int32), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def test_likelihood_is_the_sum_over_all_paths():
    rng = np.random.default_rng(1)
    chain = random_chain(rng, 3, 5)
    texts = [rng.integers(0, 5, n) for n in (1, 2, 4, 6)]
    for text, got in zip(texts, hmm.walk(chain, *packed(texts)), strict=True):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(text)):
            p = chain.first[path[0]] * chain.emit[text[0], path[0]]
            for a, b, w in zip(path, path[1:], text[1:], strict=False):
                p *= chain.moves[a, b] * chain.emit[w, b]
            total += p
        assert got == pytest.approx(math.log(total), abs=1e-12)


@pytest.mark.parametrize("segment, together", [(5, 20), (1, 1), (7, 1000), (1024, 1 << 18)])
def test_walk_in_segments_against_the_plain_recursion(monkeypatch, segment, together):
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    monkeypatch.setattr(hmm, "TOGETHER", together)
    rng = np.random.default_rng(2)
    chain = random_chain(rng, 4, 30)
    texts = [rng.integers(0, 30, n) for n in (1, 3, 5, 6, 10, 11, 23, 150, 2, 5)]
    counts, want, logs = hmm.no_counts(30, 4), hmm.no_counts(30, 4), []
    got = hmm.walk(chain, *packed(texts), counts)
    for text in texts:
        n = len(text)
        alpha, beta = np.zeros((n, 4)), np.ones((n, 4))
        for t in range(n):
            alpha[t] = (chain.first if t == 0 else alpha[t - 1] @ chain.moves) * chain.emit[text[t]]
        for t in range(n - 2, -1, -1):
            beta[t] = chain.moves @ (chain.emit[text[t + 1]] * beta[t + 1])
        p = alpha[-1].sum()
        logs.append(math.log(p))
        gamma = alpha * beta / p
        want.first[:] += gamma[0]
        np.add.at(want.emit, text, gamma)
        for t in range(1, n):
            want.moves[:] += alpha[t - 1][:, None] * chain.moves * (chain.emit[text[t]] * beta[t]) / p
    assert np.allclose(got, logs, atol=1e-9) and np.allclose(got, hmm.walk(chain, *packed(texts)), atol=1e-9)
    for a, b in zip(counts, want, strict=True):
        assert np.allclose(a, b, atol=1e-9)


def test_very_long_texts_keep_their_scale():
    rng = np.random.default_rng(3)
    chain = random_chain(rng, 4, 2000)
    text = rng.integers(0, 2000, 20_000)
    counts = hmm.no_counts(2000, 4)
    got = hmm.walk(chain, *packed([text, text[:3]]), counts)
    a, total = chain.first, 0.0
    for t, w in enumerate(text):
        v = (chain.first if t == 0 else a @ chain.moves) * chain.emit[w]
        total += math.log(v.sum())
        a = v / v.sum()
    assert got[0] == pytest.approx(total, rel=1e-12)
    assert counts.emit.sum() == pytest.approx(20_003) and counts.moves.sum() == pytest.approx(20_001) and counts.first.sum() == pytest.approx(2)


def test_index_against_a_dictionary():
    rng = np.random.default_rng(4)
    codes = np.unique(mix(rng.integers(0, 5000, 3000).astype(np.uint64)) & np.uint64(0xFFFF0000FFFF))
    places = {c: i for i, c in enumerate(codes.tolist())}
    asked = np.concatenate([codes, mix(np.arange(4000, dtype=np.uint64)) & np.uint64(0xFFFF0000FFFF)])
    assert hmm.Index(codes).find(asked).tolist() == [places.get(c, -1) for c in asked.tolist()]
    assert hmm.Index(codes[:0]).find(asked).tolist() == [-1] * len(asked)


def base_by_hand(rows, learn):
    c = Counter(t for i, x in rows if learn(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return n, [(i, len(t), sum(c[x] > 0 for x in t), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)) for i, t in ((i, tokens(x)) for i, x in rows)]


def test_query_against_counts_by_hand(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    n, want = base_by_hand(rows, lambda i: not held(i))
    got = {r.doc_id: r for r in queries.op11_hidden_markov(spark, data).collect()}
    assert len(got) == len(rows)
    for i, n_tokens, n_known, base in want:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), n_tokens, n_known, n)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score < 0
    # the chain says more about texts that it hasn't seen than single words do
    assert sum(r.score for r in got.values() if r.held_out) > 0.97 * sum(r.base_score for r in got.values() if r.held_out)


def test_words_beyond_the_symbols_are_looked_up(spark):
    rows = [(i, " ".join(f"w{(i * 13 + j * j) % (9 + i % 50)}" for j in range(5 + i % 30)) + (" Ünique" if i % 3 else "")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    n, want = base_by_hand(rows, lambda i: i % 4 != 0)
    for head in (20, 60, 10_000):
        got = {r.doc_id: r for r in hmm.score(docs, F.col("doc_id") % 4 != 0, head=head, states=3).collect()}
        for i, n_tokens, n_known, base in want:
            assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n_tokens, n_known, n)
            assert got[i].base_score == pytest.approx(base, abs=1e-9)


def test_learns_an_order_of_words(spark):
    rng = np.random.default_rng(5)
    nouns, verbs = [f"n{i}" for i in range(8)], [f"v{i}" for i in range(8)]
    rows = [(i, " ".join(rng.choice(nouns if j % 2 else verbs) for j in range(2 * rng.integers(3, 30)))) for i in range(800)]
    got = hmm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 100, states=4, rounds=((1, 15),), lasting=0.3).where("doc_id < 100").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] - got[1] > 0.2 * got[2]  # log10(2) = 0.3 a word is there to learn


def test_odd_tables(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    n, want = base_by_hand(rows, lambda i: i is not None and i % 2 == 0)
    got = hmm.score(odd_docs, F.col("doc_id") % 2 == 0).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in sorted(got, key=key)] == [(*w[:3], n) for w in sorted(want, key=key)]
    assert hmm.score(no_docs, F.lit(True)).collect() == []
    untrained = hmm.score(odd_docs, F.lit(False)).collect()
    assert all(r.n_known == r.train_tokens == 0 and r.base_score == 0 and math.isfinite(r.score) for r in untrained)
