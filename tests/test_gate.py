"""The rolling budget against a loop over requests."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import gate


def by_loop(requests, incidents, limits):
    """Each request looks through all grants before it."""
    out, grants = {}, {}
    for key, at, rid in sorted((r for r in requests if None not in r), key=lambda r: (r[0], r[1], r[2])):
        daily, minute, pause = limits(key)
        now = [i for i in incidents if i[0] == key and i[1] <= at]
        last = max(now, key=lambda i: i[1], default=None)
        if last and (last[3] is None or last[3] > at):
            if last[2] is None:
                out[rid] = ("blocked_manual", None)
                continue
            if last[2] > at:
                out[rid] = ("blocked_wait", last[2])
                continue
        recent = sorted(g for g in grants.get(key, []) if g > at - 86_400)
        within = [g for g in recent if g > at - 60]
        if len(recent) >= daily:
            out[rid] = ("budget_daily", recent[-daily] + 86_400 if daily else None)
        elif len(within) >= minute:
            out[rid] = ("rate_minute", within[-minute] + 60 if minute else None)
        elif recent and pause and recent[-1] + pause > at:
            out[rid] = ("pause", recent[-1] + pause)
        else:
            out[rid] = ("allowed", None)
            grants.setdefault(key, []).append(at)
    return out


def gated(spark, requests, incidents, limits):
    asked = spark.createDataFrame(requests, "key string, at double, id long").repartition(4)
    opened = spark.createDataFrame(incidents, "key string, at double, retry_after double, closed_at double")
    values = [F.coalesce(*[F.when(F.col("key") == k, F.lit(float(limits(k)[i]))) for k in sorted({r[0] for r in requests if r[0]})]) for i in range(3)]
    held = gate.with_incidents(asked, opened, ["key"], "at")
    return gate.rolling_budget(held, ["key"], "at", "id", daily=values[0], per_minute=values[1], pause=values[2])


@pytest.mark.parametrize("seed", range(5))
def test_random_streams_against_the_loop(spark, seed):
    rng = random.Random(seed)
    span = rng.choice([300, 90_000, 400_000])
    requests = [(rng.choice("abcd"), float(rng.randrange(span)), i) for i in range(600)] + [(None, 1.0, 900), ("a", None, 901)]
    incidents = []
    for k in "ab":
        at = 0
        while (at := at + rng.randrange(1, span // 3)) < span:  # one open at a time
            closed = at + rng.randrange(1, span // 4)
            incidents.append((k, float(at), rng.choice([None, float(at + rng.randrange(span // 2))]), float(closed) if rng.random() < 0.8 else None))
            at = closed
            if incidents[-1][3] is None:
                break
    limits = lambda k: {"a": (5, 2, 0), "b": (40, 3, 20.5), "c": (0, 1, 0), "d": (1000, 0, 5)}[k]
    rows = gated(spark, requests, incidents, limits).collect()
    got = {r.id: (r.gate, r.retry_at) for r in rows}
    assert len(rows) == len(requests) and got.pop(900)[0] == got.pop(901)[0] == "no_time"
    assert got == by_loop(requests, incidents, limits)


def test_refused_requests_use_nothing(spark):
    asked = [("a", float(t), i) for i, t in enumerate([0, 10, 20, 30, 86_400, 86_405])]
    got = {r.id: r.gate for r in gated(spark, asked, [], lambda k: (1, 9, 0)).collect()}
    # the grant of 0 is a whole day old at 86,400, so it no longer counts; then that one does
    assert [got[i] for i in range(6)] == ["allowed", "budget_daily", "budget_daily", "budget_daily", "allowed", "budget_daily"]


def test_one_key_in_many_batches_keeps_a_day_of_grants(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        asked = spark.range(5000).select(F.lit("k").alias("key"), (F.col("id") * 7).cast("double").alias("at"), "id")
        got = gate.rolling_budget(asked, ["key"], "at", "id", daily=F.lit(50), per_minute=F.lit(3), pause=F.lit(0))
        counts = {r.gate: r["count"] for r in got.groupBy("gate").count().collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = by_loop([("k", i * 7.0, i) for i in range(5000)], [], lambda k: (50, 3, 0))
    assert counts == {g: sum(1 for v in want.values() if v[0] == g) for g in {v[0] for v in want.values()}}
    ledger = gate.Ledger()
    for i in range(5000):
        ledger.ask(i * 7.0, 50, 3, 0)
    assert len(ledger.grants) <= 50
