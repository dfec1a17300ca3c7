"""A numbered log of small JSON records in a shared folder; each number is taken once."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer took the number first."""


class CommitLog:
    """Records ``00000001.json`` on, through Hadoop's file system of the path.

    A record is written under a name of its own and then renamed to its number, which
    fails where that exists: whoever comes second gets :class:`Conflict`. A reader sees
    a whole record or none. This is as atomic as the store's rename is; a store that
    renames by copying needs one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._where = jvm.org.apache.hadoop.fs.Path(self.path)
        self._conf = spark._jsc.hadoopConfiguration()
        self._files = self._where.getFileSystem(self._conf)

    def _of(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._where, name)

    def numbers(self) -> list[int]:
        if not self._files.exists(self._where):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._where)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        stream = self._files.open(self._of(f"{number:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> int:
        """The last number taken; 0 before any."""
        return max(self.numbers(), default=0)

    def commit(self, number: int, record: dict) -> None:
        jvm = self.spark._jvm
        staged = self._of(f".{uuid.uuid4().hex}.tmp")
        stream = self._files.create(staged, False)
        try:
            stream.write(json.dumps(record, sort_keys=True, ensure_ascii=False).encode())
        finally:
            stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self._conf)
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._files.makeQualified(staged), self._files.makeQualified(self._of(f"{number:08d}.json")), plain)
        except Py4JJavaError as error:
            self._files.delete(staged, False)
            if "FileAlreadyExistsException" in str(error.java_exception.toString()):
                raise Conflict(f"{self.path}: record {number} was committed by another writer") from error
            raise

    def delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self._conf).delete(where, True)

    def children(self, path: str) -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(self._conf)
        return [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
