"""Requests against budgets that only granted requests use up."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .series import as_of

DAY, MINUTE = 86_400, 60


def with_incidents(requests: DataFrame, incidents: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """``requests`` with ``refused`` and ``until``: whether the last incident of the key still holds them up.

    ``incidents``: keys, ``at`` (opened), ``retry_after`` and ``closed_at`` (NULL while it is
    open); a key has one open at a time. An incident without ``retry_after`` asks for a
    person (``blocked_manual``); another one holds until then (``blocked_wait``). Where
    ``requests`` has a ``refused`` already, that stays.
    """
    seen = as_of(requests, incidents.withColumn("__opened", F.lit(True)), keys, at, ["__opened", "retry_after", "closed_at"])
    held = F.col("__opened") & (F.col("closed_at").isNull() | (F.col("closed_at") > F.col(at)))
    why = F.when(held & F.col("retry_after").isNull(), "blocked_manual").when(held & (F.col("retry_after") > F.col(at)), "blocked_wait")
    before, until = (F.col(c) if c in requests.columns else F.lit(None) for c in ("refused", "until"))
    until = F.when(before.isNull() & (why == "blocked_wait"), F.col("retry_after")).otherwise(until)
    return seen.withColumns({"until": until.cast("double"), "refused": F.coalesce(before, why)}).drop("__opened", "retry_after", "closed_at")


class Ledger:
    """Grants of one key within a day: no more than its daily limit lets through."""

    def __init__(self) -> None:
        self.grants: deque[float] = deque()

    def ask(self, now: float, daily: int, per_minute: int, pause: float) -> tuple[str, float | None]:
        """The verdict and, where it is a refusal that passes, when. The first check that refuses counts."""
        grants = self.grants
        while grants and grants[0] <= now - DAY:
            grants.popleft()
        if len(grants) >= daily:
            return "budget_daily", grants[-daily] + DAY if daily else None
        # the minute is full if the grant that many places back lies in it
        if not per_minute or (len(grants) >= per_minute and grants[-per_minute] > now - MINUTE):
            return "rate_minute", grants[-per_minute] + MINUTE if per_minute else None
        if grants and pause and grants[-1] + pause > now:
            return "pause", grants[-1] + pause
        grants.append(now)
        return "allowed", None


def rolling_budget(requests: DataFrame, keys: Sequence[str], at: str, *order: str, daily: Column, per_minute: Column, pause: Column) -> DataFrame:
    """``requests`` with ``gate`` and ``retry_at``: a greedy limiter over each key's requests in time.

    In order of ``at`` (seconds) and ``order``: a row with a ``refused`` keeps that; a day's
    grants (strictly newer than 24 hours) up to ``daily``, a minute's up to ``per_minute``,
    and ``pause`` seconds since the last one let it through, and only then does it count.

    Each decision rests on those before it, which no window frame can say: rows are dealt
    by key, put in order and folded as they pass, with one key's grants of a day in memory.
    A row without a key or time is ``refused`` as ``no_time``; NULL limits let nothing through.
    """
    known = requests.columns
    refused = F.col("refused") if "refused" in known else F.lit(None).cast("string")
    until = F.col("until") if "until" in known else F.lit(None).cast("double")
    missing = F.col(at).isNull()
    for k in keys:
        missing |= F.col(k).isNull()
    rest = [c for c in known if c not in ("refused", "until", "gate", "retry_at")]
    own = [F.when(missing, "no_time").otherwise(refused), until, F.col(at).cast("double"), *(F.coalesce(c, F.lit(0)) for c in (daily.cast("int"), per_minute.cast("int"), pause.cast("double")))]
    names = ["__refused", "__until", "__at", "__daily", "__minute", "__pause"]
    rows = requests.select(*rest, F.struct(*keys).alias("__key"), *[c.alias(n) for c, n in zip(own, names, strict=True)])
    dealt = rows.withColumn("__key", F.to_json("__key")).repartition("__key").sortWithinPartitions("__key", "__at", *order)
    schema = T.StructType([requests.schema[c] for c in rest] + [T.StructField("gate", T.StringType()), T.StructField("retry_at", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ledger = None, Ledger()
        for batch in batches:
            gates, retries = [], []
            for k, why, wait, now, *limits in zip(*(batch.column(n).to_pylist() for n in ("__key", *names)), strict=True):
                if k != key:
                    key, ledger = k, Ledger()
                gate, retry = (why, wait) if why else ledger.ask(now, *limits)
                gates.append(gate)
                retries.append(retry)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(rest))], pa.array(gates, pa.string()), pa.array(retries, pa.float64())], names=[*rest, "gate", "retry_at"])

    return dealt.mapInArrow(run, schema)
