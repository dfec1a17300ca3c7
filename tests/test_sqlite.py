"""SQLite tables: ranges of rows, pushed filters, a source that never writes."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from ledgerlight.sources.sqlite import connect, read_sqlite


@pytest.fixture
def path(tmp_path):
    file = f"{tmp_path}/shop.db"
    con = sqlite3.connect(file)
    con.execute('CREATE TABLE offers (id INTEGER PRIMARY KEY, ean TEXT, price REAL, "odd ""name" VARCHAR(9), note)')
    con.executemany("INSERT INTO offers VALUES (?, ?, ?, ?, ?)", [(i * 3, None if i % 7 == 0 else f"{i:013d}", i / 4, f"n{i % 5}", None if i % 2 else i) for i in range(1000)])
    con.execute("CREATE TABLE empty_one (a INTEGER)")
    con.commit()
    con.close()
    return file


def test_rows_types_and_partitions(spark, path):
    df = read_sqlite(spark, path, "offers", partitions=5)
    assert df.dtypes == [("id", "bigint"), ("ean", "string"), ("price", "double"), ('odd "name', "string"), ("note", "string")]
    assert df.rdd.getNumPartitions() == 5
    rows = {r[0]: tuple(r) for r in df.collect()}
    assert len(rows) == 1000 and rows[0] == (0, None, 0.0, "n0", "0") and rows[9] == (9, "0000000000003", 0.75, "n3", None)
    assert read_sqlite(spark, path, "empty_one").collect() == []
    with pytest.raises(Exception, match="no table other"):
        read_sqlite(spark, path, "other").collect()


def test_filters_reach_the_source(spark, path):
    df = read_sqlite(spark, path, "offers", "id long, ean string, price double", partitions=3)
    filters = [F.col("id") > 1500, F.col("price") <= 200.5, F.col("ean").isNotNull(), F.col("ean").startswith("00000000005"), F.col("id").isin(1503, 1506, 1509), F.col("ean") == "0000000000501", F.col("ean").isNull(), F.col("id") % 2 == 0, (F.col("id") < 30) & ~F.col("ean").contains("1")]
    plain = spark.createDataFrame(df.collect(), df.schema)
    for f in filters:
        assert sorted(map(tuple, df.where(f).collect()), key=str) == sorted(map(tuple, plain.where(f).collect()), key=str)
    # what SQLite has applied isn't applied again
    pushed = df.where((F.col("id") > 1500) & F.col("ean").startswith("00000000005"))._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith" not in pushed.split("BatchScan")[0] and "> 1500" not in pushed.split("BatchScan")[0]
    # few rows are left to cut
    assert df.where("id >= 1500 AND id < 1510").rdd.getNumPartitions() <= 3


def test_a_read_is_guarded_and_never_writes(spark, path):
    assert read_sqlite(spark, path, "offers", most=1000).count() == 1000
    assert read_sqlite(spark, path, "offers", most=10).where("id < 30").count() == 10
    with pytest.raises(Exception, match="more than 999 rows"):
        read_sqlite(spark, path, "offers", most=999).count()
    with connect(path) as con, pytest.raises(sqlite3.OperationalError, match="readonly"):
        con.execute("DELETE FROM offers")
    with pytest.raises(Exception):
        read_sqlite(spark, path, "offers").write.format("sqlite").option("path", path).option("dbtable", "offers").mode("append").save()
    with pytest.raises(sqlite3.OperationalError):
        connect(path + ".missing")


def test_a_folder_of_files_is_one_table(spark, tmp_path):
    for n in range(3):
        con = sqlite3.connect(f"{tmp_path}/{n}.db")
        con.execute("CREATE TABLE t (a INTEGER, b TEXT)")
        con.executemany("INSERT INTO t VALUES (?, ?)", [(10 * n + i, "x") for i in range(4 * n)])
        con.commit()
        con.close()
    df = read_sqlite(spark, str(tmp_path), "t", partitions=2, most=12)
    assert sorted(r.a for r in df.collect()) == [10, 11, 12, 13, *range(20, 28)] and df.rdd.getNumPartitions() == 4
    with pytest.raises(Exception, match="more than 11"):
        read_sqlite(spark, str(tmp_path), "t", most=11).collect()
