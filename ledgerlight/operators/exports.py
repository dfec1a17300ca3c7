"""Names of exported files that are never shared by different files."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An order's files and bytes at most (fixed values), and the views that a product needs.
MOST_FILES, MOST_BYTES = 2000, 256 << 20
REQUIRED_VIEWS = ("frontal", "lateral", "perspectiva")


def spelt(ean: str, name: str, checksum: str, level: int) -> str:
    """``ean/name``, then with the checksum behind its stem, then with a number behind that."""
    if not level:
        return f"{ean}/{name}"
    path, extra = PurePosixPath(name), f"-{level - 1}" if level > 1 else ""
    return f"{ean}/{path.stem}__{checksum}{extra}{path.suffix}"


class Order:
    """Paths given in an order, up to its limits."""

    def __init__(self, most_files: int, most_bytes: int) -> None:
        self.given: dict[str, str] = {}
        self.bytes, self.refused = 0, False
        self.most_files, self.most_bytes = most_files, most_bytes

    def add(self, ean: str, name: str, checksum: str, size: int) -> str | None:
        """The first of the file's names that no file with another checksum has; None from the limit on."""
        level = 0
        while not self.refused:
            path = spelt(ean, name, checksum, level)
            if self.given.get(path, checksum) == checksum:
                if path not in self.given:
                    self.bytes += size
                    if self.bytes > self.most_bytes or len(self.given) >= self.most_files:
                        self.refused = True
                        break
                    self.given[path] = checksum
                return path
            level += 1
        return None


def export_names(files: DataFrame, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``files`` (order_id, ean, name, checksum, size, view, place) with ``path``, each name and checksum of a product once.

    In order of ``place``, a file gets its name in the export; if an earlier file of another
    checksum has it, the checksum goes behind the stem, and a number too if that is taken.
    Equal files under one path are one. Each name rests on those given before, so orders are
    dealt to tasks, sorted and folded as they pass; a task holds the paths of one order, no
    more than ``most_files``, as an order beyond a limit is refused: its further files get no path.
    """
    keys = ["order_id", "ean", "name", "checksum"]
    once = files.groupBy(*keys).agg(F.min_by(F.struct("size", "view", "place"), "place").alias("f")).select(*keys, "f.*")
    dealt = once.repartition("order_id").sortWithinPartitions("order_id", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, order = None, Order(most_files, most_bytes)
        for batch in batches:
            paths = []
            for key, *file in zip(*(batch.column(c).to_pylist() for c in ("order_id", "ean", "name", "checksum", "size")), strict=True):
                if (key,) != current:
                    current, order = (key,), Order(most_files, most_bytes)
                paths.append(order.add(*file))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.string())], names=[*batch.schema.names, "path"])

    return dealt.mapInArrow(run, T.StructType([*once.schema.fields, T.StructField("path", T.StringType())]))


def export_orders(lines: DataFrame, named: DataFrame) -> DataFrame:
    """``order_id, files, bytes, missing_views, lines_without_ean, partial, refused`` for each order of ``lines`` (order_id, ean).

    ``named``: the result of :func:`export_names`. An order with a file that got no path is
    refused whole: no files, no bytes. It is partial if one of its products lacks a required
    view or one of its lines a code.
    """
    coded = F.coalesce(F.col("ean") != "", F.lit(False))
    paths = named.groupBy("order_id", "path").agg(F.min("size").alias("size"))
    totals = paths.groupBy("order_id").agg(F.count("path").alias("files"), F.sum(F.when(F.col("path").isNotNull(), F.col("size"))).alias("bytes"), F.bool_or(F.col("path").isNull()).alias("refused"))
    views = named.groupBy("order_id", "ean").agg(F.collect_set("view").alias("views"))
    asked = lines.where(coded).select("order_id", "ean").distinct().join(views, ["order_id", "ean"], "left")
    missing = F.size(F.array_except(F.array(*map(F.lit, REQUIRED_VIEWS)), F.coalesce("views", F.array().cast("array<string>"))))
    lacking = asked.groupBy("order_id").agg(F.sum(missing).cast("long").alias("missing_views"))
    out = lines.groupBy("order_id").agg(F.count_if(~coded).alias("lines_without_ean")).join(totals, "order_id", "left").join(lacking, "order_id", "left")
    refused = F.coalesce("refused", F.lit(False))
    held = lambda c: F.when(refused, 0).otherwise(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    out = out.withColumn("missing_views", F.coalesce("missing_views", F.lit(0).cast("long")))
    return out.select("order_id", held("files"), held("bytes"), "missing_views", "lines_without_ean", ((F.col("missing_views") > 0) | (F.col("lines_without_ean") > 0)).alias("partial"), refused.alias("refused"))
