"""Snapshots of a table that are added whole or not at all, and checked when they are read."""

from __future__ import annotations

import datetime
import hashlib
import json
import uuid
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .commits import CommitLog, Conflict

_PARTS = 8


class Damaged(RuntimeError):
    """A snapshot's rows aren't those that were committed."""


class Reference(NamedTuple):
    snapshot_id: int
    snapshot_date: datetime.date
    iso_year: int
    iso_week: int
    product_count: int
    run_at: datetime.datetime
    engine_version: str
    parameters: dict
    data_sha256: str


def digest(rows: DataFrame) -> tuple[int, str]:
    """The count of rows and a digest of them as a set with repeats, in one pass without an order.

    A row is the SHA-256 of its canonical JSON (columns by name, NULL spelled out); its
    eight 32-bit parts are summed exactly over all rows, and the sums are digested.
    """
    columns = sorted(rows.columns)
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in columns]), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring("__row", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")) for i in range(_PARTS)]
    n, *sums = rows.select(row.alias("__row")).agg(F.count("*"), *parts).first()
    return n, hashlib.sha256(f"{n}:{','.join(str(s or 0) for s in sums)}:{','.join(columns)}".encode()).hexdigest()


class SnapshotStore:
    """K5, C4: ``data/<id>/`` holds rows, ``log/`` a record for each snapshot.

    Rows are written first and counted and digested from what was written; the record
    makes them a snapshot. A run that dies before leaves files that nobody reads, a
    repeated run adds a snapshot of its own, and a week is read by its last run, so no
    row counts twice.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/log")

    def save(self, rows: DataFrame, snapshot_date: datetime.date, run_at: datetime.datetime, engine_version: str, parameters: Mapping | None = None) -> Reference:
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{folder}")
        n, sha = digest(self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/{folder}"))
        year, week, _ = snapshot_date.isocalendar()
        record = {
            "snapshot_date": snapshot_date.isoformat(), "iso_year": year, "iso_week": week, "product_count": n, "run_at": run_at.isoformat(), "engine_version": engine_version,
            "parameters": json.loads(json.dumps(dict(parameters or {}), default=str)), "data_sha256": sha, "folder": folder, "schema": rows.schema.jsonValue(),
        }
        while True:  # any next number will do
            number = self.log.latest() + 1
            try:
                self.log.commit(number, record)
                return self._reference(number, record)
            except Conflict:
                continue

    @staticmethod
    def _reference(number: int, r: dict) -> Reference:
        return Reference(number, datetime.date.fromisoformat(r["snapshot_date"]), r["iso_year"], r["iso_week"], r["product_count"], datetime.datetime.fromisoformat(r["run_at"]), r["engine_version"], r["parameters"], r["data_sha256"])

    def references(self) -> list[Reference]:
        """Newest run first."""
        return sorted((self._reference(n, self.log.read(n)) for n in self.log.numbers()), key=lambda r: (r.run_at, r.snapshot_id), reverse=True)

    def load(self, snapshot_id: int) -> tuple[DataFrame, Reference]:
        """The rows of a snapshot; :class:`Damaged` if their count or digest isn't the committed one, ``KeyError`` without such a snapshot."""
        if snapshot_id not in self.log.numbers():
            raise KeyError(f"no snapshot {snapshot_id}")
        record = self.log.read(snapshot_id)
        rows = self.spark.read.schema(T.StructType.fromJson(record["schema"])).parquet(f"{self.path}/data/{record['folder']}")
        try:
            found = digest(rows)
        except Exception as error:
            raise Damaged(f"snapshot {snapshot_id} can't be read") from error
        if found != (record["product_count"], record["data_sha256"]):
            raise Damaged(f"snapshot {snapshot_id} doesn't have its digest")
        return rows, self._reference(snapshot_id, record)

    def load_week(self, snapshot_date: datetime.date) -> tuple[DataFrame, Reference] | None:
        """The last run of a date; None without any."""
        for r in self.references():
            if r.snapshot_date == snapshot_date:
                return self.load(r.snapshot_id)
        return None
