"""A table of one row for each key that batches are merged into."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import keyed
from .commits import CommitLog


class KeyedTable:
    """K6: Parquet files by bucket of the key, under versions in a :class:`CommitLog`.

    A version names the folder of each bucket. An upsert reads and rewrites the buckets
    that the batch's keys fall in, in a new folder, and commits a version that points
    there; files of other buckets stay as they are. Readers keep to the version they
    began with. A writer whose version another one has built on meanwhile gets
    ``commits.Conflict`` and leaves no trace; nothing is merged twice, as a failed batch
    has no version.

    * ``log/``: ``schema, keys, buckets, folders`` (by bucket), ``batch``
    * ``data/<id>/bucket=<b>/``: rows
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/log")

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int = 64) -> KeyedTable:
        """An empty table; ``commits.Conflict`` where there is one."""
        table = cls(spark, path)
        table.log.commit(1, {"schema": schema.jsonValue(), "keys": list(keys), "buckets": buckets, "folders": {}, "batch": None})
        return table

    def version(self) -> int:
        return self.log.latest()

    def _read(self, record: dict, buckets: Sequence[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(record["schema"])
        folders = [f"{self.path}/data/{f}" for b, f in sorted(record["folders"].items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.log.read(version or self.version()))

    def _bucket(self, record: dict) -> Column:
        return F.pmod(F.xxhash64(*record["keys"]), F.lit(record["buckets"])).cast("int")

    def _write(self, rows: DataFrame, record: dict, touched: Sequence[int], base: int, batch: str | None) -> int:
        folder = uuid.uuid4().hex
        path = f"{self.path}/data/{folder}"
        rows.withColumn("bucket", self._bucket(record)).repartition("bucket").write.partitionBy("bucket").parquet(path)
        kept = {b: f for b, f in record["folders"].items() if int(b) not in set(touched)}
        made = {name.removeprefix("bucket="): f"{folder}/{name}" for name in self.log.children(path) if name.startswith("bucket=")}
        try:
            self.log.commit(base + 1, record | {"folders": kept | made, "batch": batch})
        except BaseException:
            self.log.delete(path)
            raise
        return base + 1

    def upsert(self, new: DataFrame, order: Sequence[str], newest: Sequence[str] = (), base: int | None = None, batch: str | None = None) -> int:
        """Merge ``new`` (its last row of a key by ``order``) as :func:`keyed.upsert` does; the new version.

        ``base`` is the version that the caller has read, else the last one. A ``batch`` that
        is committed already is not merged again, so a stream's batch may be repeated.
        """
        base = self.version() if base is None else base
        record = self.log.read(base)
        if batch is not None and any(self.log.read(n)["batch"] == batch for n in self.log.numbers()):
            return self.version()
        columns = [f["name"] for f in record["schema"]["fields"]]
        last = new.groupBy(*record["keys"]).agg(F.max_by(F.struct(*[c for c in columns if c not in record["keys"]]), F.struct(*order)).alias("__row"))
        last = last.select(*record["keys"], "__row.*").select(*columns)
        touched = [r[0] for r in last.select(self._bucket(record).alias("b")).distinct().collect()]  # as many as the table has buckets at most
        old = self._read(record, [str(b) for b in touched])
        return self._write(keyed.upsert(old, last, record["keys"], newest).select(*columns), record, touched, base, batch)

    def replace(self, rows: DataFrame, base: int | None = None, batch: str | None = None) -> int:
        """K8: a new version with just these rows, one for each key."""
        base = self.version() if base is None else base
        record = self.log.read(base)
        columns = [f["name"] for f in record["schema"]["fields"]]
        return self._write(rows.select(*columns), record, range(record["buckets"]), base, batch)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete data that none of the last ``keep`` versions has. Writers must be at rest."""
        used = {f.split("/")[0] for n in self.log.numbers()[-keep:] for f in self.log.read(n)["folders"].values()}
        gone = [f for f in self.log.children(f"{self.path}/data") if f not in used]
        for f in gone:
            self.log.delete(f"{self.path}/data/{f}")
        return gone
