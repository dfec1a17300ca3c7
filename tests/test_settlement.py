"""Reconciliation against the loop over pairs that its rule describes."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators.matching import conditioned_degrees, sole_partners
from ledgerlight.plans import settlement

M = "id long, kind string, gross string, currency string, psp string, order_ref string"
D = "id long, gross string, currency string, psp string, order_ref string"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("gross", F.col("gross").cast("decimal(38,6)"))


def by_pairs(movements, documents):
    candidates, reverse, references = defaultdict(list), defaultdict(list), defaultdict(list)
    for i, m in enumerate(movements):
        for j, d in enumerate(documents):
            if m[1] in ("Settled", "Refunded") and m[2] is not None and m[2:4] == d[1:3]:
                candidates[i].append(j)
                reverse[j].append(i)
                if (m[4] and m[4] == d[3]) or (m[5] and m[5] == d[4]):
                    references[i].append(j)
    used = Counter(j for js in references.values() for j in js)
    sure = {i: js[0] for i, js in references.items() if len(js) == 1 and used[js[0]] == 1}
    doc_of = {j: j for j in sure.values()}

    def status(matches, back, found):
        if found:
            return "confirmada"
        if not matches:
            return "sin_coincidencia"
        return "candidata" if len(matches) == 1 and len(back[matches[0]]) == 1 else "ambigua"

    out = [("movement", m[0], status(candidates[i], reverse, i in sure), documents[sure[i]][0] if i in sure else None, len(candidates[i])) for i, m in enumerate(movements)]
    out += [("document", d[0], status(reverse[j], candidates, j in doc_of), d[0] if j in doc_of else None, len(reverse[j])) for j, d in enumerate(documents)]
    return sorted(out, key=str)


def test_a_reference_counts_within_its_amount_alone(spark):
    m = [(1, "Settled", "10", "EUR", "a", ""), (2, "Settled", "20", "EUR", "", ""), (3, "Fee", "10", "EUR", "a", ""), (4, "Refunded", "30", "EUR", "p", "o"), (5, "Settled", None, "EUR", "a", "")]
    d = [(11, "10", "EUR", "a", ""), (12, "10", "EUR", "other", ""), (13, "99", "EUR", "a", ""), (21, "20", "EUR", "", ""), (22, "20", "EUR", "x", ""), (31, "30", "EUR", "p", "o"), (32, "30", "USD", "p", None)]
    got = sorted((tuple(r) for r in settlement.reconcile(frame(spark, m, M), frame(spark, d, D)).collect()), key=str)
    assert got == by_pairs(m, d)
    found = {(r[0], r[1]): r[2:4] for r in got}
    assert found["movement", 1] == ("confirmada", 11) and found["document", 12] == ("ambigua", None)
    # both without a reference, and another document of the amount
    assert found["movement", 2] == ("ambigua", None)
    # both references lead to one document: one edge
    assert found["movement", 4] == ("confirmada", 31) and found["document", 31] == ("confirmada", 31)
    assert found["movement", 3] == ("sin_coincidencia", None) and found["movement", 5] == ("sin_coincidencia", None)


@pytest.mark.parametrize("seed", range(6))
def test_random_rows_against_pairs(spark, seed):
    rng = random.Random(seed)
    ref = lambda n: rng.choice(["", None, *[f"r{i}" for i in range(n)]])
    money = lambda: rng.choice([None, "1", "1.5", "2", "7"])
    n = 4 + 12 * seed
    m = [(i, rng.choice(["Settled", "Refunded", "Fee"]), money(), rng.choice(["EUR", "USD"]), ref(n), ref(n)) for i in range(n)]
    d = [(100 + i, money(), rng.choice(["EUR", "USD"]), ref(n), ref(n)) for i in range(n + 3)]
    # a NULL amount is that of a row without one: it agrees with nothing
    got = sorted((tuple(r) for r in settlement.reconcile(frame(spark, m, M), frame(spark, d, D)).collect()), key=str)
    assert got == by_pairs(m, d)


def test_a_hot_amount_makes_no_pairs(spark):
    m = spark.range(20_000).select("id", F.lit("Settled").alias("kind"), F.lit(5).cast("decimal(38,6)").alias("gross"), F.lit("EUR").alias("currency"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("psp"), F.lit("").alias("order_ref"))
    d = m.drop("kind").withColumn("psp", F.when(F.col("id") % 2 == 0, F.col("psp")).otherwise("none"))
    got = {(r.side, r.status): r.n for r in settlement.reconcile(m, d).groupBy("side", "status").agg(F.count("*").alias("n")).collect()}
    assert got == {("movement", "confirmada"): 10_000, ("movement", "ambigua"): 10_000, ("document", "confirmada"): 10_000, ("document", "ambigua"): 10_000}


def test_degrees_over_three_columns(spark):
    rng = random.Random(3)
    rows = lambda: [(i, rng.choice("xy"), *[rng.choice(["", None, "1", "2"]) for _ in range(3)]) for i in range(40)]
    left, right = rows(), rows()
    schema = "id long, k string, a string, b string, c string"
    got = {r.id: (r.edges, r.other) for r in conditioned_degrees(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], ["a", "b", "c"], F.col("id")).collect()}
    for i, k, *own in left:
        ends = [r[0] for r in right if r[1] == k and any(x and x == y for x, y in zip(own, r[2:], strict=True))]
        assert got[i] == (len(ends), ends[0] if len(ends) == 1 else None)


def test_rows_with_faults_are_kept(spark):
    names = "row long, account string, batch string, date string, kind string, currency string, original_currency string, net_credit string, net_debit string, gross_credit string, gross_debit string, psp string, order_ref string"
    good = (1, "A", "7", "2025-01-02T23:30:00Z", "Settled", "eur", "usd", "10,50", "", "12.00", None, "p", "o")
    change = lambda **x: tuple(x.get(n, v) for n, v in zip([c.split()[0] for c in names.split(", ")], good, strict=True))
    rows = [good, change(row=2, kind="Fee", gross_credit="", original_currency=""), change(row=3, batch=None, kind="?"), change(row=4, kind="?"), change(row=5, net_credit=" "), change(row=6, net_credit="1.000,5"), change(row=7, gross_credit=""), change(row=8, original_currency="€"), change(row=9, currency="", date="x"), change(row=10, date="2025-13-40")]
    got = {r.row: r for r in settlement.movement_rows(spark.createDataFrame(rows, names)).collect()}
    assert {k: r.error for k, r in got.items()} == {1: None, 2: None, 3: "cuenta_o_lote", 4: "tipo", 5: "neto_vacio", 6: "neto", 7: "bruto_vacio", 8: "moneda_original", 9: "moneda", 10: "fecha"}
    assert (str(got[1].net), str(got[1].gross), got[1].currency, got[1].original_currency, str(got[1].booked)) == ("10.500000", "12.000000", "EUR", "USD", "2025-01-02")
    assert got[2].gross is None and got[2].original_currency == "" and got[6].net is None
    docs = spark.createDataFrame([(1, "F1", "x", "02/01/2025", "9,5", "EUR", "", ""), (2, "", "x", "bad", "9", "EUR", "", ""), (3, "F3", "x", "02/01/2025", "9.000,1", "EUR", "", "")], "row long, number string, partner string, date string, amount string, currency string, psp string, order_ref string")
    assert [(r.row, r.error) for r in settlement.document_rows(docs).orderBy("row").collect()] == [(1, None), (2, "numero"), (3, "importe")]


def test_a_row_moves_a_fixed_number_of_times(spark):
    m = frame(spark, [(1, "Settled", "10", "EUR", "a", "")], M)
    d = frame(spark, [(11, "10", "EUR", "a", "")], D)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = settlement.reconcile(m, d)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # by amount, by each reference and to the partner; besides, the sizes of the amounts
    assert len([line for line in plan.splitlines() if "Exchange" in line]) <= 5
    assert len([line for line in plan.splitlines() if "Join" in line]) == 1


@pytest.mark.parametrize("seed", range(3))
def test_sole_partners_over_three_columns(spark, seed):
    rng = random.Random(seed)
    rows = [(i % 2 == 0, i, rng.choice("xyz"), *[rng.choice(["", None, *map(str, range(40))]) for _ in range(3)]) for i in range(90)]
    got = {r.id: r.partner for r in sole_partners(spark.createDataFrame(rows, "l boolean, id long, k string, a string, b string, c string"), ["k"], ["a", "b", "c"], "l", "id").collect()}
    ends = {r[1]: [o[1] for o in rows if o[0] != r[0] and o[2] == r[2] and any(x and x == y for x, y in zip(r[3:], o[3:], strict=True))] for r in rows}
    assert got == {i: e[0] if len(e) == 1 and ends[e[0]] == [i] else None for i, e in ends.items()}
    assert any(got.values())


def test_a_row_without_id_is_no_partner_but_an_end(spark):
    rows = [(True, 1, "k", "a", ""), (False, None, "k", "a", ""), (True, 2, "k", "b", "o"), (False, None, "k", "b", ""), (False, 3, "k", "", "o"), (True, 4, "k", "c", ""), (False, 5, "k", "c", "")]
    got = sole_partners(spark.createDataFrame(rows, "l boolean, id long, k string, a string, b string"), ["k"], ["a", "b"], "l", "id")
    assert {r.id: r.partner for r in got.where("id IS NOT NULL").collect()} == {1: None, 2: None, 3: None, 4: 5, 5: 4}
