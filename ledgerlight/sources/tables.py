"""Readers and writers: text-typed files, aliased headers, exports, snapshots."""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codes


def canonicalize(df: DataFrame, aliases: Mapping[str, Sequence[str]], required: Sequence[str], defaults: Mapping[str, object] | None = None) -> DataFrame:
    """§1.3, P1-P3: header spellings become canonical names, canonical columns first; a missing required one is an error, a missing optional one its default."""
    by_name = {c.strip().lower(): c for c in df.columns}
    found = {name: by_name[s.lower()] for name, spellings in aliases.items() for s in (name, *spellings) if s.lower() in by_name}
    missing = [r for r in required if r not in found]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    known = [F.col(f"`{found[n]}`").alias(n) if n in found else F.lit((defaults or {}).get(n)).alias(n) for n in aliases]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in found.values()]
    return df.select(*known, *rest)


def coerce(df: DataFrame, numbers: Sequence[str] = (), times: Sequence[str] = ()) -> DataFrame:
    """Columns as numbers (zero where there is none) and times (NULL where there is none)."""
    number = lambda c: F.coalesce(F.nanvl(F.trim(F.col(c).cast("string")).try_cast("double"), F.lit(0.0)), F.lit(0.0))
    return df.withColumns({c: number(c) for c in numbers} | {c: F.try_to_timestamp(F.col(c).cast("string")) for c in times})


def scan(df: DataFrame, required: Sequence[str], keep: Column | None = None) -> DataFrame:
    """A table (``spark.read.jdbc`` or a file) with the columns that must be there, and the rows to keep."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df if keep is None else df.where(keep)


def sniff_separator(spark: SparkSession, path: str) -> str:
    """Of ``; , tab`` the one that the header has most of."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    return max(";,\t", key=line.count)


def read_text_table(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Every column as trimmed text, NULL as empty; quoted cells may hold line ends and quotes; a ragged row is an error.

    A file is one task, as a line end inside a cell can't be told from the middle of it.
    """
    sep = separator or sniff_separator(spark, path)
    raw = spark.read.csv(path, sep=sep, header=True, inferSchema=False, mode="FAILFAST", encoding="UTF-8", multiLine=True, quote='"', escape='"')
    names = [c.lstrip("﻿").strip() for c in raw.columns]
    if len({n.lower() for n in names}) < len(names) or "" in names:
        raise ValueError("blank or repeated header")
    return raw.select(*[F.coalesce(F.trim(raw[f"`{c}`"]), F.lit("")).alias(n) for c, n in zip(raw.columns, names, strict=True)])


def read_feed(spark: SparkSession, path: str, aliases: Mapping[str, Sequence[str]], key: str) -> DataFrame:
    """An authorised price feed; the first row of a code counts, by its file's name and its place in the file."""
    rows = canonicalize(read_text_table(spark, path), aliases, [key])
    place = F.struct(F.input_file_name(), F.input_file_block_start(), F.monotonically_increasing_id())
    first = rows.select("*", place.alias("__place")).groupBy(key).agg(F.min_by(F.struct(*rows.columns), "__place").alias("__row"))
    return first.select("__row.*")


def parse_codes(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Pasted code lists as rows ``keys, position, code, gtin``.

    ``keys`` tell the lists apart; without them all rows are one list. The first of
    equal codes of a list stays, an invalid one has no gtin.
    """
    parts = df.select(*keys, F.posexplode(F.split(F.col(column), r"[\s,;]+")).alias("position", "code")).where("code <> ''")
    first = parts.groupBy(*keys, "code").agg(F.min("position").alias("position"))
    return first.select(*keys, "position", "code", codes.normalize_gtin(F.col("code")).alias("gtin"))


OBSERVATIONS = T.StructType(
    [
        T.StructField("schema", T.StringType()),
        T.StructField("observaciones", T.ArrayType(T.StructType([T.StructField(n, T.DoubleType() if n == "precio_venta" else T.BooleanType() if n == "iva_incluido" else T.StringType()) for n in (
            "ean_consultado", "competidor", "precio_venta", "moneda", "mercado", "iva_incluido", "disponibilidad", "fecha_observacion", "coincidencia", "url")]))),
    ]
)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """A row for each observation of a versioned JSON document."""
    return observations(spark.read.schema(OBSERVATIONS).json(path, multiLine=True))


def observations(docs: DataFrame, *keys: str) -> DataFrame:
    """Offers of parsed documents with the columns ``keys``; a version other than 1 gives none, an invalid code no ean."""
    docs = docs.where(F.col("schema").endswith("/1"))
    rows = docs.select(*keys, F.explode("observaciones").alias("o")).select(*keys, "o.*")
    return rows.withColumn("captured_at", F.try_to_timestamp("fecha_observacion")).withColumn("ean", codes.normalize_gtin(F.col("ean_consultado")))


def feed_items(xml: Column) -> Column:
    """Links of an RSS feed's items."""
    return F.regexp_extract_all(xml, F.lit(r"(?s)<item>.*?<link>\s*(.*?)\s*</link>.*?</item>"), 1)


def robots_rules(df: DataFrame, column: str, agent: str = "*", *keys: str) -> DataFrame:
    """``keys, allow, path``: the rules for an agent in each row's robots text.

    Agents in a row share the rules behind them. The groups that name the agent count,
    else those of ``*``; rules without a path say nothing. NULL has no rules.
    """
    line = lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]*:([^#]*)", 1)).alias("v"))
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(column), F.lit("")), r"\r?\n"), line), lambda x: x["k"].isin("user-agent", "allow", "disallow"))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("agents"), F.lit(False).alias("open"), none.alias("seen"), F.array().cast("array<struct<agents:array<string>,allow:boolean,path:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        named, name = x["k"] == "user-agent", F.lower(x["v"])
        agents = F.when(named, F.when(acc["open"], F.array_append(acc["agents"], name)).otherwise(F.array(name))).otherwise(acc["agents"])
        rule = F.struct(acc["agents"].alias("agents"), (x["k"] == "allow").alias("allow"), x["v"].alias("path"))
        out = F.when(named | (x["v"] == ""), acc["out"]).otherwise(F.array_append(acc["out"], rule))
        return F.struct(agents.alias("agents"), named.alias("open"), F.when(named, F.array_append(acc["seen"], name)).otherwise(acc["seen"]).alias("seen"), out.alias("out"))

    read = df.select(*keys, F.aggregate(lines, start, step).alias("r"))
    mine = F.when(F.array_contains("r.seen", agent.lower()), F.lit(agent.lower())).otherwise(F.lit("*"))
    held = read.select(*keys, mine.alias("mine"), F.explode("r.out").alias("rule")).where(F.array_contains("rule.agents", F.col("mine")))
    return held.select(*keys, "rule.allow", "rule.path").orderBy(*keys, F.length("path").desc(), F.desc("allow"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (``spark.checkpoint.dir``), or on this machine where it is one alone; it goes when the driver's JVM ends."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = f"{(shared or f'file:///tmp/checkpoints/{os.getuid()}').rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return f"{path}/rows"


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """``name, interval_hours, ean``, a row for each product of a watch group; a group without an interval has 24 hours."""
    groups = spark.read.schema("name string, interval_hours int, eans array<string>").json(path)
    return groups.select("name", F.coalesce("interval_hours", F.lit(24)).alias("interval_hours"), F.explode("eans").alias("ean"))


def write_csv(df: DataFrame, path: str, *partition_by: str) -> None:
    """K1, K2: semicolons, a header, quotes doubled inside cells, one folder for each partition."""
    writer = df.write.mode("overwrite").option("sep", ";").option("header", True).option("escape", '"').option("lineSep", "\r\n")
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def limited(df: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """A guarded read: at most ``most`` rows, and whether there were more."""
    probe = df.limit(most + 1)
    return probe.limit(most), probe.count() > most


def back_up(df: DataFrame, path: str) -> None:
    """K9."""
    df.write.mode("errorifexists").parquet(path)
