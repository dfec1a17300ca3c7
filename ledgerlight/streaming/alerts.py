"""Streams of events: alerts once, changes, and claims that survive a retry."""

from __future__ import annotations

import datetime
import logging
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.commits import CommitLog, Conflict


def alerts_once(events: DataFrame, at: str, *keys: str, late: str = "1 day") -> DataFrame:
    """One row for each event key; state older than ``late`` behind the newest event is dropped."""
    key = F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), 256)
    return events.withColumn("event_key", key).withWatermark(at, late).dropDuplicatesWithinWatermark(["event_key"])


def changes(samples: DataFrame, key: str, value: str, at: str, threshold: float = 5.0) -> DataFrame:
    """``key, at, previous, value, kind`` where a sample moved by the threshold (in percent) against the one before it.

    A sample older than the last one seen is no change (R7); one without a value or time counts for nothing.
    """
    out = f"{key} string, at timestamp, previous double, value double, kind string"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        # a key's samples come in several Arrow batches, in no order
        samples = pd.concat([*batches, pd.DataFrame({"at": pd.Series(dtype="datetime64[ns]"), "value": pd.Series(dtype=float)})])[["at", "value"]].dropna().sort_values("at", kind="stable")
        if last is not None:
            samples = samples[samples["at"].map(pd.Timestamp.timestamp) >= last[0]]
        was = samples["value"].shift(fill_value=float("nan") if last is None else last[1])
        move = (samples["value"] - was) / was.where(was != 0) * 100
        moved = samples[move.abs() >= threshold]
        if len(samples):
            state.update((samples["at"].iloc[-1].timestamp(), float(samples["value"].iloc[-1])))
        kind = ["price_up" if m > 0 else "price_down" for m in move[move.abs() >= threshold]]
        yield pd.DataFrame({key: k[0], "at": moved["at"].array, "previous": was[move.abs() >= threshold].array, "value": moved["value"].array, "kind": kind})

    rows = samples.select(F.col(key).cast("string").alias(key), F.col(at).cast("timestamp").alias("at"), F.col(value).cast("double").alias("value"))
    return rows.groupBy(key).applyInPandasWithState(run, out, "seconds double, value double", "append", GroupStateTimeout.NoTimeout)


class Heartbeats(StreamingQueryListener):
    """What the polled queries of a session did last, as records in a commit log that other sessions read.

    A record has ``source`` (the query's name), ``state`` (started, checked, idle, stopped),
    ``at`` (ISO), ``batch``, ``rows`` and ``error``. Spark tells the listener on the driver; no
    job is run for it.
    """

    def __init__(self, log: CommitLog) -> None:
        self.log = log
        self.names: dict[str, str] = {}

    def _beat(self, run: object, state: str, at: str, **more: object) -> None:
        record = {"source": self.names.get(str(run)), "state": state, "at": at} | more
        while True:  # any next number will do
            try:
                return self.log.commit(self.log.latest() + 1, record)
            except Conflict:
                continue

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name
        self._beat(event.runId, "started", event.timestamp)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._beat(p.runId, "checked", p.timestamp, batch=p.batchId, rows=p.numInputRows)

    def onQueryIdle(self, event) -> None:
        self._beat(event.runId, "idle", event.timestamp)

    def onQueryTerminated(self, event) -> None:
        now = datetime.datetime.now(datetime.UTC).isoformat()
        self._beat(event.runId, "stopped", now, error=(event.exception or "")[:2000] or None)


def last_beats(log: CommitLog) -> dict[str, dict]:
    """Of each source the last record, with ``checked_at`` of its last check, ``rows`` of all and ``error`` of the last stop."""
    out: dict[str, dict] = {}
    for n in log.numbers():
        r = log.read(n)
        held = out.setdefault(r["source"], {"checked_at": None, "rows": 0, "error": None})
        held |= {"state": r["state"], "at": r["at"]}
        if r["state"] == "checked":
            held |= {"checked_at": r["at"], "rows": held["rows"] + r["rows"]}
        if r["state"] == "stopped":
            held["error"] = r["error"]
    return out


def poll(stream: DataFrame, name: str, handle: Callable[[DataFrame, int], None], progress: str, every: str = "5 minutes", once: bool = False) -> StreamingQuery:
    """``handle`` each batch of a source that is asked ``every`` so often, or ``once``.

    The query resumes from ``progress``; a batch that fails is handled again, so
    ``handle`` must be able to repeat one (as :func:`claim` is). :class:`Heartbeats` on the
    session tells that it lives.
    """
    writer = stream.writeStream.queryName(name).foreachBatch(handle).option("checkpointLocation", progress)
    return (writer.trigger(once=True) if once else writer.trigger(processingTime=every)).start()


def keep_polling(start: Callable[[], StreamingQuery], stop: threading.Event, wait: float = 60.0, cycles: int | None = None) -> int:
    """A failure doesn't end the loop: ``start`` again ``wait`` seconds after the query ends, until ``stop`` is set; how many starts there were."""
    n = 0
    while not stop.is_set() and (cycles is None or n < cycles):
        n += 1
        query = None
        try:
            query = start()
            while not query.awaitTermination(1) and not stop.is_set():
                pass
        except StreamingQueryException as failed:
            logging.getLogger(__name__).warning("polled query failed: %s", failed)
        finally:
            if query is not None and query.isActive:
                query.stop()
        if cycles is None or n < cycles:
            stop.wait(wait)
    return n


def claim(orders: DataFrame, claims: DataFrame, now: int, batch: str, lease: int = 600, most: int | None = None) -> DataFrame:
    """The claim table after one pass: new, failed and expired orders are taken, sent ones never, exhausted ones stay.

    ``orders``: order_id; ``claims``: order_id, status (pending, sent, failed), batch_id,
    claimed_until, attempts. A lease that ends now is over, and so is one without an end.
    ``most`` attempts are made (None: no limit). Written by one batch job (or
    ``foreachBatch``) it is idempotent: a second pass at the same time takes nothing.
    """
    asked = orders.select("order_id", F.lit(True).alias("__asked")).where("order_id IS NOT NULL").distinct()
    rows = asked.join(claims, "order_id", "full_outer")
    tries = F.coalesce("attempts", F.lit(0))
    free = F.col("status").isNull() | (F.col("status") == "failed") | ((F.col("status") == "pending") & (F.coalesce("claimed_until", F.lit(0)) <= now))
    taken = F.coalesce("__asked", F.lit(False)) & free
    if most is not None:
        taken &= F.col("status").isNull() | (tries < most)
    return rows.select(
        "order_id", F.when(taken, "pending").otherwise(F.col("status")).alias("status"), F.when(taken, F.lit(batch)).otherwise(F.col("batch_id")).alias("batch_id"),
        F.when(taken, now + lease).otherwise(F.col("claimed_until")).cast("long").alias("claimed_until"), F.when(taken, tries + 1).otherwise(tries).cast("int").alias("attempts"), taken.alias("claimed_now"),
    )


def close_batch(claims: DataFrame, batch: str, status: str) -> DataFrame:
    """R2: the claims after a batch reported ``sent`` or ``failed``: only rows that are still its own and pending change."""
    own = (F.col("batch_id") == batch) & (F.col("status") == "pending")
    own = F.coalesce(own, F.lit(False))
    return claims.withColumns({"status": F.when(own, status).otherwise(F.col("status")), "claimed_until": F.when(~own, F.col("claimed_until"))})


def exhausted(claims: DataFrame, most: int, now: int) -> DataFrame:
    """R2: orders that no pass will take again: all attempts made and no lease in force."""
    return claims.where((F.col("status") != "sent") & (F.col("attempts") >= most) & (F.coalesce("claimed_until", F.lit(0)) <= now)).select("order_id")


def stale(last_seen: DataFrame, at: str, now, hours: int) -> DataFrame:
    """What hasn't been seen for so many hours."""
    return last_seen.where(F.col(at) < now - F.expr(f"INTERVAL {hours} HOURS"))
