"""The Merkle manifest against a plain recursive tree, and against SQL."""

import hashlib

import pytest
from compare import differences, duck
from pyspark.sql import functions as F

from ledgerlight.llm import merkle, queries

COLUMNS = ["doc_id", "lang", "text"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def spelled(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return levels


def beside(levels, i, fanout):
    out = []
    for below in levels[:-1]:
        run = below[i - i % fanout : i - i % fanout + fanout]
        out.append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
        i //= fanout
    return out


def by_hand(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], sha("".join(map(spelled, r)))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = tree([h for _, h in groups[g]], fanout)
    top = tree([trees[g][-1][0] for g in order], fanout)
    out = []
    for k, g in enumerate(order):
        for i, (doc_id, leaf) in enumerate(groups[g]):
            path = beside(trees[g], i, fanout) + beside(top, k, fanout)
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], tuple(path), sha("".join(a + b for a, b in path))))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r[0], r.leaf, r.subroot, r.root, tuple(map(tuple, r.path)), r.proof_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("fanout, block, n", [(2, 8, 103), (3, 9, 100), (2, 1024, 40), (5, 1, 61), (2, 2, 65)])
def test_manifest_against_a_plain_tree(spark, monkeypatch, fanout, block, n):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = [(i * 7 % n, ["en", "de", None, ""][min(i % 9, 3)], f"text {i} é") for i in range(n)] + [(5000, "one", None), (None, "en", "x"), (None, None, "y"), (3, "en", "same"), (3, "en", "same"), (3, "en", "other")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3).withColumns({"pos": F.lit(1), "n": F.lit(2), "path": F.lit("p")})
    got = merkle.manifest(docs, COLUMNS, "lang", "doc_id", fanout=fanout)
    assert found(got) == by_hand(rows, fanout)
    assert got.where("NOT verified").isEmpty() and got.where("folded_root <> root").isEmpty()


def test_changed_copies_are_told(spark):
    rows = [(i, "en" if i % 3 else None, f"t{i}" if i % 5 else None) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = merkle.manifest(docs, COLUMNS, "lang", "doc_id", {"text": F.when(F.col("doc_id") < 12, F.concat("text", F.lit("!"))).otherwise(F.col("text"))}).collect()
    assert {r.doc_id for r in got if not r.verified} == {i for i in range(12) if i % 5}  # null stays null


def test_small_and_empty_tables(spark, no_docs, odd_docs):
    assert merkle.manifest(no_docs, ["doc_id", "text"], "key", "doc_id").collect() == []
    one = merkle.manifest(spark.createDataFrame([(1, "en", "x")], "doc_id long, lang string, text string"), COLUMNS, "lang", "doc_id").first()
    assert one.root == one.subroot == one.leaf == one.folded_root and one.verified and one.proof_sha256 == sha("")
    got = merkle.manifest(odd_docs, ["doc_id", "key", "text"], "key", "doc_id")
    assert found(got) == by_hand([(r.doc_id, r.key, r.text) for r in odd_docs.collect()], 2)
    with pytest.raises(ValueError):
        merkle.manifest(odd_docs, ["doc_id"], "key", "doc_id", fanout=1)


def test_query_agrees_with_sql(spark, data):
    name = "op13_merkle_manifest"
    assert differences(queries.QUERIES[name](spark, data), duck(data), queries.ORACLE_SQL[name]) == ""
