"""Claims of orders in a stream: leases, backoff and exhaustion by timers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

#: The store that timers and states with an end need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lease(NamedTuple):
    """``status``: pending, failed, sent; ``until``: end of the lease or of the wait (ms, 0: none); ``batch`` of the last claim."""

    status: str
    batch: str
    until: int
    attempts: int


class Rules(NamedTuple):
    """Milliseconds of a lease, attempts at most (None: no limit), and the first and the longest wait after a failure."""

    lease: int = 600_000
    most: int | None = 5
    wait: int = 60_000
    longest: int = 3_600_000


def decide(key: str, lease: Lease | None, kind: str, batch: str | None, now: int, rules: Rules) -> tuple[Lease | None, str | None]:
    """The lease after an event and what to tell: ``claim`` or ``exhausted``.

    ``order`` asks for a claim, ``sent`` and ``failed`` close the lease of their own batch
    alone, ``timer`` comes when a lease or a wait has ended. A lease that ends now is over.
    An exhausted lease stays pending, so its batch may still report.
    """
    if kind in ("sent", "failed"):
        if lease is None or lease.status != "pending" or lease.batch != batch:
            return lease, None
        if kind == "sent":
            return lease._replace(status="sent", until=0), None
        wait = min(rules.wait * 2 ** (lease.attempts - 1), rules.longest)
        return lease._replace(status="failed", until=now + wait), None
    if lease is None and kind == "order":
        return Lease("pending", f"{key}-1", now + rules.lease, 1), "claim"
    if lease is None or lease.status == "sent" or not lease.until or lease.until > now:
        return lease, None
    if rules.most is not None and lease.attempts >= rules.most:
        return lease._replace(until=0), "exhausted"
    n = lease.attempts + 1
    return Lease("pending", f"{key}-{n}", now + rules.lease, n), "claim"


#: Low bits of an order's id that its bucket leaves out: 256 orders' leases are one value, and a batch asks the store for each bucket alone.
BUCKET_BITS = 8

_LEASE = StructType([
    StructField("order_id", LongType()), StructField("status", StringType()), StructField("batch", StringType()), StructField("until", LongType()), StructField("attempts", IntegerType()),
    StructField("changed", LongType()),
])
_STATE = StructType([StructField("leases", ArrayType(_LEASE))])
CLAIMS = StructType([StructField("order_id", LongType()), StructField("action", StringType()), StructField("batch", StringType()), StructField("attempt", IntegerType()), StructField("at", LongType())])


class Leases(StatefulProcessor):
    """The leases of a bucket's orders as one value; each is forgotten ``forget`` ms after its own last change, the value after the last of all."""

    def __init__(self, rules: Rules, forget: int) -> None:
        self.rules, self.forget = rules, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("leases", _STATE, self.forget)

    def _held(self, now: int) -> dict[int, tuple[Lease, int]]:
        """Lease and time of its last change by order."""
        found = self.state.get() if self.state.exists() else None
        return {i: (Lease(*lease), changed) for i, *lease, changed in found[0] if changed + self.forget > now} if found else {}

    def _next(self, events: Iterable[tuple[int, str, str | None]], held: dict[int, tuple[Lease, int]], now: int) -> Iterator[Row]:
        timers = set()
        changed = False
        for order, kind, batch in events:
            lease = held[order][0] if order in held else None
            after, told = decide(str(order), lease, kind, batch, now, self.rules)
            if told:
                yield Row(order_id=order, action=told, batch=after.batch, attempt=after.attempts, at=now)
            if after is not None and after != lease:
                held[order], changed = (after, now), True
                if after.until:
                    timers.add(after.until)  # a batch makes few different ends
        if changed:
            self.state.update(([(i, *lease, at) for i, (lease, at) in held.items()],))
            for until in timers:
                self.handle.registerTimer(until)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        yield from self._next(((r["order_id"], r["kind"], r["batch"]) for r in rows), self._held(now), now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = self._held(now)
        due = [(i, "timer", None) for i, (lease, _) in held.items() if lease.until and lease.until <= now]
        yield from self._next(due, held, now)

    def close(self) -> None:
        pass


def lease_stream(events: DataFrame, rules: Rules = Rules(), forget_days: float = 30) -> DataFrame:
    """``order_id, action, batch, attempt, at`` from a stream of ``order_id, kind, batch``.

    ``kind`` is ``order``, ``sent`` or ``failed`` (see :func:`decide`); other rows and rows without
    an id are left out. An order has one live claim at a time; a worker that doesn't
    report loses it when the lease ends, and its late report changes nothing. State and
    timers live in the query's checkpoint, so a restart goes on with them. Orders with
    neighbouring ids share a value of the state, 256 at most, however many orders there are.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    known = events.where(F.col("order_id").isNotNull() & F.col("kind").isin("order", "sent", "failed"))
    rows = known.select(F.col("order_id").cast("long").alias("order_id"), "kind", F.col("batch").cast("string").alias("batch"))
    return rows.withColumn("bucket", F.shiftright("order_id", BUCKET_BITS)).groupBy("bucket").transformWithState(Leases(rules, int(forget_days * 86_400_000)), CLAIMS, "Append", "ProcessingTime")
