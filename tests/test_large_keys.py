"""Queries over keys that only larger tables have."""

import pytest

from ledgerlight import plans

PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("large"))
    keys = [99_998, 99_999, 100_001, 999_990, 999_991, 999_995, 999_999, 1_000_003]
    spark.createDataFrame([(k, "n", "Brand#7", "t", 1, 9.0) for k in keys], PART).write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(n, k, 1, 1, 12.0, 9.0, 0.05, 0.0, "A", "O") for n, k in enumerate(keys)], LINE).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_another_model_is_never_the_parts_own(spark, large):
    want = lambda k: {3: "rejected", 2: "probable"}.get(k % 4, "exact")
    for r in plans.QUERIES["F14_identity"](spark, large).collect():
        assert r.match == want(r.p_partkey), r
    parts = {r.l_orderkey * 10 + 1: r.l_partkey for r in spark.read.parquet(f"{large}/lineitem.parquet").collect()}
    for r in plans.QUERIES["X33_identified_offers"](spark, large).collect():
        assert r.match == want(parts[r.id]) and (r.price_eur is None) == (r.match != "exact"), r
