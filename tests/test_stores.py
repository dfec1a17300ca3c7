"""Versions, races and damage of the tables that are written to."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import keyed
from ledgerlight.sources.commits import CommitLog, Conflict
from ledgerlight.sources.keyed_table import KeyedTable
from ledgerlight.sources.snapshots import Damaged, SnapshotStore, digest

ROWS = "id long, name string, seen int, at int"


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/table"


def local(path):
    return Path(path.removeprefix("file://"))


def files(path):
    return {str(f.relative_to(local(path))): f.stat().st_mtime_ns for f in (local(path) / "data").rglob("*.parquet")}


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_upserts_rewrite_only_the_buckets_they_touch(spark, path):
    old = spark.createDataFrame([(i, f"n{i}", i, 0) for i in range(200)], ROWS)
    table = KeyedTable.create(spark, path, old.schema, ["id"], 16)
    assert table.read().collect() == [] and table.upsert(old, ["at"]) == 2
    before, first = files(path), table.log.read(2)["folders"]
    new = spark.createDataFrame([(3, " ", 1, 1), (3, "late", 9, 3), (3, "early", 9, 2), (999, "x", 5, 1)], ROWS)
    assert table.upsert(new, ["at"], newest=["seen"]) == 3
    want = {r[0]: r for r in values(old)} | {3: (3, "late", 9, 3), 999: (999, "x", 5, 1)}
    assert values(table.read()) == sorted(want.values()) and values(table.read(2)) == values(old)
    after, second = files(path), table.log.read(3)["folders"]
    moved = {b for b in second if first.get(b) != second[b]}
    assert len(moved) <= 2 and before.items() <= after.items()
    blank = table.upsert(spark.createDataFrame([(3, "", None, 7)], ROWS), ["at"], newest=["seen"])
    assert [tuple(r) for r in table.read(blank).where("id = 3").collect()] == [(3, "late", 9, 7)]


def test_the_second_of_two_writers_fails_and_leaves_nothing(spark, path):
    table = KeyedTable.create(spark, path, spark.createDataFrame([], ROWS).schema, ["id"], 4)
    with pytest.raises(Conflict):
        KeyedTable.create(spark, path, table.read().schema, ["id"], 4)
    mine, theirs = table.version(), table.version()
    table.upsert(spark.createDataFrame([(1, "a", 1, 1)], ROWS), ["at"], base=mine)
    held = set((local(path) / "data").iterdir())
    with pytest.raises(Conflict):
        table.upsert(spark.createDataFrame([(2, "b", 1, 1)], ROWS), ["at"], base=theirs)
    assert set((local(path) / "data").iterdir()) == held and values(table.read()) == [(1, "a", 1, 1)]
    table.upsert(spark.createDataFrame([(2, "b", 1, 1)], ROWS), ["at"])  # from the new version it may
    assert values(table.read()) == [(1, "a", 1, 1), (2, "b", 1, 1)]


def test_a_repeated_batch_counts_once_and_torn_data_is_never_read(spark, path):
    table = KeyedTable.create(spark, path, spark.createDataFrame([], ROWS).schema, ["id"], 4)
    batch = spark.createDataFrame([(1, "a", 1, 1)], ROWS)
    assert table.upsert(batch, ["at"], batch="7") == table.upsert(batch, ["at"], batch="7") == 2
    torn = local(path) / "data" / "dead" / "bucket=0"
    torn.mkdir(parents=True)
    (torn / "part-0.parquet").write_bytes(b"PAR1 cut off")
    (local(path) / "log" / ".half.tmp").write_text('{"schema":')
    assert values(table.read()) == [(1, "a", 1, 1)] and table.version() == 2
    table.upsert(spark.createDataFrame([(1, "b", 1, 2)], ROWS), ["at"])
    table.upsert(spark.createDataFrame([(1, "c", 1, 3)], ROWS), ["at"])
    gone = table.vacuum(keep=2)
    assert "dead" in gone and values(table.read()) == [(1, "c", 1, 3)] and values(table.read(3)) == [(1, "b", 1, 2)]


def test_replace_keeps_what_retention_keeps(spark, path):
    rows = spark.createDataFrame([(i, f"n{i % 3}", i, i) for i in range(30)], ROWS)
    table = KeyedTable.create(spark, path, rows.schema, ["id"], 4)
    table.replace(rows)
    kept = keyed.retained(table.read(), ["name"], "at", "id", F.lit(28), rows.where("id = 5"))
    table.replace(kept)
    assert [r[0] for r in values(table.read())] == [5, 27, 28, 29]


def test_a_log_gives_a_number_once(spark, path):
    log = CommitLog(spark, path)
    assert log.latest() == 0 and log.numbers() == []
    log.commit(1, {"a": "é"})
    with pytest.raises(Conflict):
        log.commit(1, {"a": 2})
    assert log.read(1) == {"a": "é"} and log.numbers() == [1] and not [f for f in local(path).iterdir() if f.name.endswith(".tmp")]


WEEK, RUN = dt.date(2025, 1, 6), dt.datetime(2025, 1, 6, 8, tzinfo=dt.UTC)


def test_snapshots_are_read_by_week_and_id(spark, path):
    store = SnapshotStore(spark, path)
    assert store.references() == [] and store.load_week(WEEK) is None
    rows = spark.createDataFrame([(1, "A", 2.5), (2, None, None), (2, None, None)], "product long, abcd string, pvo double")
    one = store.save(rows.limit(1), WEEK, RUN, "1", {"margin": 90, "day": WEEK})
    two = store.save(rows, WEEK, RUN + dt.timedelta(hours=1), "2")
    three = store.save(rows.limit(0), WEEK + dt.timedelta(days=7), RUN, "2")
    assert [one.snapshot_id, two.snapshot_id, three.snapshot_id] == [1, 2, 3] and one.parameters == {"margin": 90, "day": "2025-01-06"} and (one.iso_year, one.iso_week) == (2025, 2)
    # a rerun is read in place of the first one, not beside it
    got, reference = store.load_week(WEEK)
    assert reference == two and sorted(got.collect(), key=str) == sorted(rows.collect(), key=str)
    assert store.load(1)[0].count() == 1 and store.load(3)[0].count() == 0
    assert [r.snapshot_id for r in store.references()] == [2, 3, 1]
    with pytest.raises(KeyError):
        store.load(4)


def test_damage_is_told_and_torn_writes_are_no_snapshot(spark, path):
    store = SnapshotStore(spark, path)
    rows = spark.range(100).select(F.col("id").alias("product"), F.lit("A").alias("abcd"))
    store.save(rows, WEEK, RUN, "1")
    torn = local(path) / "data" / "dead"
    torn.mkdir()
    (torn / "part-0.parquet").write_bytes(b"PAR1")
    assert len(store.references()) == 1 and store.load_week(WEEK)[0].count() == 100
    folder = local(path) / "data" / store.log.read(1)["folder"]
    part = next(folder.glob("*.parquet"))
    for crc in folder.glob(".*.crc"):
        crc.unlink()
    whole = part.read_bytes()
    rows.withColumn("abcd", F.when(F.col("product") == 3, "B").otherwise("A")).coalesce(1).write.mode("overwrite").parquet(f"{path}/other")
    part.write_bytes(next((local(path) / "other").glob("*.parquet")).read_bytes())
    with pytest.raises(Damaged):
        store.load(1)
    part.write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Damaged):
        store.load(1)
    part.unlink()
    with pytest.raises(Damaged):
        store.load(1)


def test_digests_know_repeats_nulls_and_names_but_no_order(spark):
    of = lambda rows, schema="a long, b string": digest(spark.createDataFrame(rows, schema))
    base = of([(1, "x"), (2, None)])
    assert base == of([(2, None), (1, "x")]) and base[0] == 2
    others = [of([(1, "x"), (2, "")]), of([(1, "x"), (2, None), (2, None)]), of([(1, "x")]), of([(1, "x"), (2, None)], "a long, c string"), of([])]
    assert len({base, *others}) == 6
