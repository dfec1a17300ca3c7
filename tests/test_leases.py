"""Claims in batches and in a stream with timers, against the loop of the rule."""

import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerlight.streaming import alerts
from ledgerlight.streaming.leases import CLAIMS, Lease, Leases, Rules, decide, lease_stream

CLAIM = "order_id long, status string, batch_id string, claimed_until long, attempts int"


def claim_by_loop(orders, claims, now, batch, lease, most):
    rows = {c[0]: c[1:] for c in claims}
    taken = set()
    for i in dict.fromkeys(orders):
        status, _, until, attempts = rows.get(i, (None, None, None, 0))
        if status == "sent" or (status == "pending" and (until or 0) > now) or (status and most is not None and attempts >= most):
            continue
        rows[i] = ("pending", batch, now + lease, attempts + 1)
        taken.add(i)
    return rows, taken


@pytest.mark.parametrize("seed", range(4))
def test_passes_against_the_loop(spark, seed):
    rng = random.Random(seed)
    claims = [(i, rng.choice(["sent", "failed", "pending"]), rng.choice("xy"), rng.choice([None, 0, 99, 100, 101]), rng.randrange(7)) for i in range(60)]
    orders = [rng.randrange(90) for _ in range(80)]
    most = rng.choice([None, 3, 5])
    want, taken = claim_by_loop(orders, claims, 100, "now", 600, most)
    frame = alerts.claim(spark.createDataFrame([(i,) for i in orders], "order_id long"), spark.createDataFrame(claims, CLAIM), 100, "now", most=most)
    got = frame.collect()
    assert {r.order_id: (r.status, r.batch_id, r.claimed_until, r.attempts) for r in got} == want and {r.order_id for r in got if r.claimed_now} == taken
    again = alerts.claim(spark.createDataFrame([(i,) for i in orders], "order_id long"), frame.drop("claimed_now"), 100, "again", most=most)
    assert again.where("claimed_now").isEmpty()
    for status in ("sent", "failed"):
        closed = {r.order_id: (r.status, r.batch_id, r.claimed_until, r.attempts) for r in alerts.close_batch(frame, "x", status).collect()}
        assert closed == {i: (status, b, None, n) if b == "x" and s == "pending" else (s, b, u, n) for i, (s, b, u, n) in want.items()}
    out = {r.order_id for r in alerts.exhausted(frame, 5, 100).collect()}
    assert out == {i for i, (s, _, u, n) in want.items() if s != "sent" and n >= 5 and (u or 0) <= 100}


def test_a_worker_whose_lease_ran_out_closes_nothing():
    rules = Rules(lease=10, most=3, wait=4, longest=6)
    lease, told = decide("7", None, "order", None, 100, rules)
    assert (lease, told) == (Lease("pending", "7-1", 110, 1), "claim")
    assert decide("7", lease, "order", None, 109, rules) == (lease, None) == decide("7", lease, "timer", None, 109, rules)
    second, told = decide("7", lease, "order", None, 110, rules)  # over when it ends
    assert (second, told) == (Lease("pending", "7-2", 120, 2), "claim")
    assert decide("7", second, "sent", "7-1", 111, rules) == (second, None)
    failed, _ = decide("7", second, "failed", "7-2", 112, rules)
    assert failed == Lease("failed", "7-2", 118, 2)  # 4 doubled is more than 6
    assert decide("7", failed, "order", None, 117, rules) == (failed, None)
    third, _ = decide("7", failed, "timer", None, 118, rules)
    worn, told = decide("7", third, "timer", None, 128, rules)
    assert told == "exhausted" and decide("7", worn, "order", None, 999, rules) == (worn, None) == decide("7", worn, "timer", None, 999, rules)
    sent, _ = decide("7", worn, "sent", "7-3", 130, rules)
    assert sent.status == "sent" and decide("7", sent, "order", None, 10_000, rules) == (sent, None)
    assert decide("8", None, "sent", "8-1", 1, rules) == (None, None) == decide("8", None, "timer", None, 1, rules)


def test_stream_goes_on_with_its_leases_after_a_restart(spark, tmp_path):
    source, claims, progress = (f"{tmp_path}/{n}" for n in ("in", "out", "progress"))
    put = lambda *rows: spark.createDataFrame(rows, "order_id long, kind string, batch string").coalesce(1).write.mode("append").parquet(source)
    rules = Rules(lease=15_000, most=2, wait=1000, longest=1000)
    put((1, "order", None), (2, "order", None), (2, "order", None), (None, "order", None), (3, "other", None), (4, "order", None))

    def start():
        events = spark.readStream.schema("order_id long, kind string, batch string").parquet(source)
        return lease_stream(events, rules).writeStream.option("checkpointLocation", progress).trigger(processingTime="200 milliseconds").start(claims, "parquet")

    def told():
        return sorted((r.order_id, r.action, r.attempt) for r in spark.read.schema(CLAIMS).parquet(claims).collect())

    def wait(n, seconds=90):
        end = time.time() + seconds
        while time.time() < end and len(told()) < n:
            time.sleep(0.3)
        return told()

    query = start()
    first = [(1, "claim", 1), (2, "claim", 1), (4, "claim", 1)]
    assert wait(3) == first
    query.stop()
    put((1, "sent", "1-1"), (4, "sent", "4-9"), (1, "order", None))  # 4's report has another batch
    query = start()  # timers of the first run are in its checkpoint
    try:
        assert wait(7) == sorted([*first, (2, "claim", 2), (4, "claim", 2), (2, "exhausted", 2), (4, "exhausted", 2)])
        put((2, "order", None), (1, "order", None))
        time.sleep(2)
        assert len(told()) == 7 and query.exception() is None
    finally:
        query.stop()


class Store:
    """One value and its timers, with the calls that were made."""

    def __init__(self):
        self.value, self.updates, self.timers = None, 0, []

    getValueState = lambda self, *_: self
    exists = lambda self: self.value is not None
    get = lambda self: self.value
    registerTimer = lambda self, at: self.timers.append(at)
    getCurrentProcessingTimeInMs = lambda self: self.now

    def update(self, value):
        self.value, self.updates = value, self.updates + 1


def test_a_bucket_asks_its_store_once_a_batch():
    store, leases = Store(), Leases(Rules(lease=100, most=2), forget=1000)
    leases.init(store)
    store.now = 0
    rows = [{"order_id": i, "kind": "order", "batch": None} for i in range(256)]
    assert [r.batch for r in leases.handleInputRows((0,), rows + rows, store)] == [f"{i}-1" for i in range(256)]
    assert (store.updates, store.timers) == (1, [100])
    store.now = 50
    assert not list(leases.handleInputRows((0,), [{"order_id": 3, "kind": "sent", "batch": "3-1"}, *rows[:9]], store))
    assert (store.updates, store.timers) == (2, [100])
    store.now = 100  # 3 was sent, all others are claimed again
    assert [r.order_id for r in leases.handleExpiredTimer((0,), store, None)] == [i for i in range(256) if i != 3]
    store.now = 1050  # each order is forgotten by its own last change
    assert [(r.order_id, r.attempt) for r in leases.handleInputRows((0,), [rows[3]], store)] == [(3, 1)]
    assert {r.action for r in leases.handleExpiredTimer((0,), store, None)} == {"exhausted"}
