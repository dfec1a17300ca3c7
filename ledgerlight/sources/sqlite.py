"""SQLite tables as a Spark source."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
)
from pyspark.sql.types import StructType

_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: Declared types by the part of their name (in this order), for a schema that isn't given.
_TYPES = (("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connect(path: str) -> sqlite3.Connection:
    """A connection that can't write; the file must be there."""
    con = sqlite3.connect(f"file:{path.removeprefix('file://').replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True)
    con.execute("PRAGMA query_only = 1")
    return con


class TooManyRows(RuntimeError):
    """The guard of a read was passed."""


class RowRange(InputPartition):
    """Rows of a file whose id is in ``[low, high)``."""

    def __init__(self, file: str, low: int, high: int) -> None:
        super().__init__((file, low, high))
        self.file, self.low, self.high = file, low, high


def _files(path: str) -> list[str]:
    """The file, or the ``*.db`` files of a folder."""
    folder = Path(path.removeprefix("file://"))
    return sorted(str(f) for f in folder.glob("*.db")) if folder.is_dir() else [path]


def _condition(f: Filter, kinds: dict[str, str]) -> tuple[str, list] | None:
    """A filter as SQL and its values; None for one that SQLite might judge otherwise."""
    attribute = getattr(f, "attribute", ())  # NOT has none of its own
    if len(attribute) != 1 or attribute[0] not in kinds:
        return None
    column, kind = _quoted(attribute[0]), kinds[attribute[0]]
    if isinstance(f, IsNull | IsNotNull):
        return f"{column} IS {'NOT ' * isinstance(f, IsNotNull)}NULL", []
    value = f.value
    values = list(value) if isinstance(f, In) else [value]
    wanted = (str,) if kind == "string" else (int, float)
    # numbers and text compare alike on both sides only within their own kind
    if kind not in ("string", "bigint", "int", "double") or any(isinstance(v, bool) or not isinstance(v, wanted) for v in values):
        return None
    if type(f) in _COMPARED:
        return f"{column} {_COMPARED[type(f)]} ?", values
    if isinstance(f, In) and len(values) <= 500:
        return f"{column} IN ({', '.join('?' * len(values))})", values
    if isinstance(f, StringStartsWith) and value:
        return f"substr({column}, 1, ?) = ?", [len(value), value]
    return None


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.columns = [f.name for f in schema.fields]
        self.kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        self.path, self.table = options["path"], options["dbtable"]
        self.parts = max(1, int(options.get("numpartitions", "8")))
        self.most = int(options["maxrows"]) if options.get("maxrows") else None
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            found = _condition(f, self.kinds)
            if found:
                self.where.append(found)
            else:
                yield f

    def _clause(self, *more: str) -> tuple[str, list]:
        conditions = [*more, *[c for c, _ in self.where]]
        return (f" WHERE {' AND '.join(conditions)}" if conditions else ""), [v for _, vs in self.where for v in vs]

    def partitions(self) -> Sequence[RowRange]:
        clause, values = self._clause()
        out, left = [], self.most
        for file in _files(self.path):
            con = connect(file)
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}{clause}", values).fetchone()
                if left is not None:
                    # one more than allowed tells that there are too many
                    left -= con.execute(f"SELECT count(*) FROM (SELECT 1 FROM {_quoted(self.table)}{clause} LIMIT ?)", [*values, left + 1]).fetchone()[0]
                    if left < 0:
                        raise TooManyRows(f"{self.table} has more than {self.most} rows")
            finally:
                con.close()
            if low is not None:
                step = -(-(high + 1 - low) // self.parts)
                out += [RowRange(file, a, min(a + step, high + 1)) for a in range(low, high + 1, step)]
        return out or [RowRange(self.path, 0, 0)]

    def read(self, partition: RowRange) -> Iterator[tuple[Any, ...]]:
        clause, values = self._clause("rowid >= ?", "rowid < ?")
        casts = {"string": "TEXT", "double": "REAL", "bigint": "INTEGER", "int": "INTEGER"}
        chosen = ", ".join(f"CAST({_quoted(c)} AS {casts[self.kinds[c]]})" if self.kinds[c] in casts else _quoted(c) for c in self.columns)
        if partition.low == partition.high:
            return
        con = connect(partition.file)
        try:
            yield from con.execute(f"SELECT {chosen} FROM {_quoted(self.table)}{clause}", [partition.low, partition.high, *values])
        finally:
            con.close()


class SqliteStream(DataSourceStreamReader):
    """Rows of a table that only grows: an offset is the last row id taken.

    Each batch goes from the last offset to the largest row id there is, cut into row
    ranges; the query's checkpoint keeps the offset, so a restart takes new rows alone.
    """

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.rows = SqliteReader(schema, options)

    def initialOffset(self) -> dict[str, int]:
        return {"row": 0}

    def latestOffset(self) -> dict[str, int]:
        con = connect(self.rows.path)
        try:
            return {"row": con.execute(f"SELECT coalesce(max(rowid), 0) FROM {_quoted(self.rows.table)}").fetchone()[0]}
        finally:
            con.close()

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> Sequence[RowRange]:
        low, high = start["row"] + 1, end["row"] + 1
        step = max(1, -(-(high - low) // self.rows.parts))
        return [RowRange(self.rows.path, a, min(a + step, high)) for a in range(low, high, step)]

    def read(self, partition: RowRange) -> Iterator[tuple[Any, ...]]:
        return self.rows.read(partition)


class SqliteSource(DataSource):
    """``format("sqlite")``: options ``path`` (a file that driver and executors all see, or a folder of ``*.db``), ``dbtable``, ``numPartitions`` (8 a file) and ``maxRows``.

    A file's row ids are cut into ``numPartitions`` ranges, a partition each; comparisons, IN, IS NULL and prefixes
    go into SQLite's WHERE, and the columns of a given schema are all that it reads. The
    file is opened to read alone. With ``maxRows`` a longer result (after the filters) is
    an error, never a cut table. Tables without row ids can't be read so.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        con = connect(_files(self.options["path"])[0])
        try:
            found = con.execute(f"PRAGMA table_info({_quoted(self.options['dbtable'])})").fetchall()
        finally:
            con.close()
        if not found:
            raise ValueError(f"no table {self.options['dbtable']}")
        kind = lambda declared: next((t for part, t in _TYPES if part in (declared or "").upper()), "string")
        return ", ".join(f"`{r[1]}` {kind(r[2])}" for r in found)

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, {k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema: StructType) -> SqliteStream:
        return SqliteStream(schema, {k.lower(): v for k, v in self.options.items()})


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str | None = None, partitions: int = 8, most: int | None = None):
    """A table of a SQLite file as a DataFrame (see :class:`SqliteSource`)."""
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("sqlite").option("path", path).option("dbtable", table).option("numPartitions", partitions)
    reader = reader.option("maxRows", most) if most is not None else reader
    return (reader.schema(schema) if schema else reader).load()


def poll_sqlite(spark: SparkSession, path: str, table: str, schema: str | None = None, partitions: int = 8):
    """A SQLite file's growing table as a stream (see :class:`SqliteStream`)."""
    spark.dataSource.register(SqliteSource)
    reader = spark.readStream.format("sqlite").option("path", path).option("dbtable", table).option("numPartitions", partitions)
    return (reader.schema(schema) if schema else reader).load()
