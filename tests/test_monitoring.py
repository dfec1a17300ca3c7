"""Alerts against the loop over samples; markets by evidence."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import monitoring

SAMPLE = "job long, at long, availability string, price double, includes_tax boolean, gap string, stock_conflict boolean, own_price double, eligible boolean"


def by_loop(samples):
    out, last = [], {}
    for job, at, stock, price, tax, gap, clash, own, eligible in sorted(samples):
        was = last.get(job)
        last[job] = (stock, price, tax, gap, clash, own)
        if was and was[0] != stock:
            out.append((job, at, "availability", was[0], stock))
        prior = bool(was and not was[3] and was[2] is True)
        if not gap and tax is True and prior and was[1] and price is not None and abs((price - was[1]) / was[1] * 100) >= 5:
            out.append((job, at, "price_up" if price > was[1] else "price_down", str(was[1]), str(price)))
        cheaper = bool(prior and was[0] == "available" and not was[4] and was[5] is not None and was[1] is not None and was[1] < was[5])
        if eligible and own is not None and price is not None and price < own and not cheaper:
            out.append((job, at, "undercut", None if not was or was[1] is None else str(was[1]), str(price)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_samples_against_the_loop(spark, seed):
    rng = random.Random(seed)
    one = lambda *xs: rng.choice(xs)
    samples = [(one(1, 2, 3), i, one("available", "unavailable", "unknown"), one(None, 0.0, 90.0, 94.0, 95.0, 100.0, 105.0), one(True, True, True, False, None), one(None, "", "", "x"), one(True, False, False, None), one(None, 95.0, 100.0), one(True, True, False, None)) for i in range(300)]
    alerts = monitoring.sample_alerts(spark.createDataFrame(samples, SAMPLE).repartition(3), ["job"], "at")
    rows = alerts.collect()
    assert sorted(((r.job, r.at, r.kind, r.old_value, r.new_value) for r in rows), key=str) == by_loop(samples)
    assert len({r.event_key for r in rows}) == len(rows) and {x[2] for x in by_loop(samples)} == {"availability", "price_up", "price_down", "undercut"}
    again = monitoring.sample_alerts(spark.createDataFrame(samples, SAMPLE), ["job"], "at")
    assert {r.event_key for r in again.collect()} == {r.event_key for r in rows}


def test_an_undercut_is_told_once(spark):
    row = lambda at, price, **x: tuple({"job": 1, "at": at, "availability": "available", "price": price, "includes_tax": True, "gap": "", "stock_conflict": False, "own_price": 100.0, "eligible": True, **x}.values())
    samples = [row(1, 99.0), row(2, 98.0), row(3, 101.0), row(4, 99.0), row(5, 99.0, availability="unavailable"), row(6, 99.0), row(7, 98.5, own_price=98.0), row(8, 97.9, own_price=98.0)]
    got = [(r.at, r.kind) for r in monitoring.sample_alerts(spark.createDataFrame(samples, SAMPLE), ["job"], "at").orderBy("at", "kind").collect()]
    assert [x for x in got if x[1] == "undercut"] == [(1, "undercut"), (4, "undercut"), (6, "undercut"), (8, "undercut")]
    assert [x for x in got if x[1] == "availability"] == [(5, "availability"), (6, "availability")]


def test_stale_prices_are_told_once_for_each_success(spark):
    jobs = spark.createDataFrame([(1, 10, 20, 5), (2, 10, 30, 5), (3, 10, 20, None), (1, 11, 20, 5), (1, 10, 20, 5)], "job long, last_ok_at long, valid_until long, offer long")
    rows = monitoring.stale_alerts(jobs, ["job"], F.lit(30)).collect()
    assert sorted((r.job, r.last_ok_at) for r in rows) == [(1, 10), (1, 10), (1, 11)] and len({r.event_key for r in rows}) == 2


def test_markets_by_evidence(spark):
    schema = "market string, market_source string, market_conflict boolean, configured_market string, market_verified boolean, evidence_url string, market_note string"
    good = ("ES", True, "u", "n")
    rows = [("ES", "x", False, *good), ("PT", "x", False, *good), ("PT", "x", None, "ES", False, "u", "n"), ("", "", True, *good), (None, None, None, *good), (None, None, None, "ES", True, "", "n"), (None, None, None, "ES", True, "u", None), ("ES", "x", True, None, None, None, None)]
    got = [tuple(r) for r in monitoring.resolved_markets(spark.createDataFrame(rows, schema).coalesce(1)).select("sales_market", "market_reason", "market_review").collect()]
    assert got == [("ES", "ficha", False), ("PT", "contradictorio", True), ("PT", "ficha", False), ("ES", "contradictorio", True), ("ES", "configuración", False), ("", "sin evidencia", False), ("", "sin evidencia", False), ("ES", "contradictorio", True)]
