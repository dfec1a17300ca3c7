"""Plans whose tasks hold what a shuffle deals them, not what a file has."""

import itertools
import random
from datetime import datetime

from ledgerlight import plans
from ledgerlight.operators import references, series
from ledgerlight.plans import web


def _plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_order_evidence_groups_dealt_rows(spark, data):
    below = None
    for line in _plan(plans.QUERIES["X17_order_evidence"](spark, data)):  # from the last step down to the scans
        if "Aggregate" in line:
            below = "Aggregate"
        elif "Exchange" in line:
            below = "Exchange"
        assert not ("FileScan" in line and below == "Aggregate"), line


def test_searches_of_a_product_are_compared_among_themselves(spark):
    rows = [(1, "9", "9", "b", "M1", "x"), (2, "9", None, "b", "m 1", "x y"), (3, "", "5", "", "", "")]
    plan = references.search_plan(spark.createDataFrame(rows, "id long, ean string, original_ean string, brand string, model string, color string"))
    assert not [line for line in _plan(plan) if "Exchange" in line]
    got = {}
    for r in plan.orderBy("id", "step").collect():
        got.setdefault(r.id, []).append((r.step, r.query))
    assert 3 not in got and got[1] == [(0, "9"), (1, "B M1 X"), (2, "M1 X"), (4, "M1X"), (5, "M1-X")]
    assert len({q for _, q in got[2]}) == len(got[2])


def test_lookup_of_ids_with_several_rows(spark):
    rows = [(1, "n", "b", 5), (1, "m", "b", 5), (2, "n", "b", 5), (2, "m", "b", 5), (2, "m", "b", 5), (3, "m", "b", 6), (4, "x", "b", 1), (5, "x", None, 1), (6, "x", None, 1), (7, "x", "b", 2)]
    parts = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int")
    found = web.lookup_of_all(parts)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2, 0), (2, 1, 0), (3, 1, 1), (3, 2, 1), (4, 7, 1), (7, 4, 1)]


def test_a_small_tables_pages_are_read_by_all_cores(spark, data):
    for name in ("N5_product_pages", "N5_page_facts", "F13_references"):
        assert [line for line in _plan(plans.QUERIES[name](spark, data)) if "REPARTITION_BY_NUM" in line], name


def test_history_holds_no_table_of_runs(spark, data):
    steps = [line.split("(")[0] for line in _plan(plans.QUERIES["R6_change_only_history"](spark, data))]
    assert not [line for line in steps if "Aggregate" in line]
    assert len([line for line in steps if "Sort" in line]) == len([line for line in steps if "Exchange" in line]) == 1


def test_history_against_the_loop(spark):
    rng = random.Random(4)
    at = lambda: rng.choice([None, *[datetime(2001, 1, day) for day in range(1, 9)]])
    rows = [(rng.randrange(5), n, at(), rng.choice([True, False, None]), rng.choice("ab")) for n in range(150)]
    rows += [(9, 200, None, True, "a"), (9, 201, None, True, "a"), (None, 202, datetime(2001, 1, 1), None, None), (None, 203, None, None, None)]
    want = []
    for key, of in itertools.groupby(sorted(rows, key=lambda r: (str(r[0]), r[2] or datetime.min, r[1])), key=lambda r: r[0]):
        for content, run in itertools.groupby(of, key=lambda r: r[3:]):
            run = list(run)
            times = [r[2] for r in run if r[2]]
            want.append((key, *content, min(times, default=None), max(times, default=None), len(run)))
    got = series.change_points(spark.createDataFrame(rows, "k int, id int, at timestamp_ntz, x boolean, y string"), ["k"], ["x", "y"], "at", "id")
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
