"""Stock: product facts, ABCD classes, ledgers, snapshots."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import elapsed_days, week_start
from ..operators import keyed, ledger
from ..operators.ranks import exact_percentile
from ..sources.snapshots import SnapshotStore
from ..sources.tables import scratch
from .registry import Tables, query
from .views import MOVES, NOW, moves, now

MARGIN_DAYS, DEAD_DAYS, PERCENTILE, ALERT_DAYS = 90, 180, 0.8, 15

FACTS = f"""{MOVES}, facts AS (SELECT product, min(CASE WHEN kind = 'entry' THEN moved_at END) AS first_purchase, max(CASE WHEN kind = 'entry' THEN moved_at END) AS last_restock,
  max(CASE WHEN kind = 'exit' THEN moved_at END) AS last_sale,
  CAST(count(*) FILTER (WHERE kind = 'exit' AND moved_at >= TIMESTAMP '{NOW}' - INTERVAL 180 DAY) AS BIGINT) AS sales_180,
  coalesce(sum(CASE WHEN kind = 'exit' AND moved_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY THEN qty END), 0.0) AS units_7 FROM moves GROUP BY product)"""


def product_facts(rows: DataFrame, at: Column) -> DataFrame:
    """A1: all facts of a product in one pass over its moves."""
    entry, sale = F.col("kind") == "entry", F.col("kind") == "exit"
    since = lambda days: sale & (F.col("moved_at") >= at - F.expr(f"INTERVAL {days} DAYS"))
    return rows.groupBy("product").agg(
        F.min(F.when(entry, F.col("moved_at"))).alias("first_purchase"), F.max(F.when(entry, F.col("moved_at"))).alias("last_restock"),
        F.max(F.when(sale, F.col("moved_at"))).alias("last_sale"), F.count_if(since(180)).alias("sales_180"),
        F.coalesce(F.sum(F.when(since(7), F.col("qty"))), F.lit(0.0)).alias("units_7"),
    )


def classify(df: DataFrame, at: Column, threshold: int = DEAD_DAYS) -> DataFrame:
    """Class, alert and blocked capital of products with pvo, stock and the facts; the first class that fits wins."""
    pvo, stock = F.coalesce("pvo", F.lit(0.0)), F.coalesce("stock", F.lit(0.0))
    limit = F.lit(exact_percentile(df.select(pvo.alias("pvo")), "pvo", PERCENTILE))
    age = elapsed_days(F.col("first_purchase"), at)
    restocked = F.coalesce(F.date_trunc("day", "last_restock") > F.date_trunc("day", "last_sale"), F.lit(False))
    idle = F.coalesce(elapsed_days(F.when(restocked, F.col("last_restock")).otherwise(F.col("last_sale")), at), F.lit(9999))
    sold, margin = F.col("last_sale").isNotNull(), F.coalesce(age >= MARGIN_DAYS, F.lit(False))
    until_d = F.coalesce(MARGIN_DAYS - age, F.lit(9999))
    dead = (stock > 0) & margin & (idle >= threshold) & (F.coalesce("sales_180", F.lit(0)) == 0)
    young = ~sold & F.coalesce(age < MARGIN_DAYS, F.lit(False))
    kind = F.when(dead, "D").when(sold & margin & (pvo >= limit), "A").when(sold | young, "B").otherwise("C")
    alert = F.when(dead, "LIQUIDAR").when(sold, "OK").when(young, F.when(until_d <= ALERT_DAYS, "REVISAR").otherwise("OK")).otherwise("BAJO IMPACTO")
    return df.select(*df.columns, kind.alias("abcd"), alert.alias("alert"), idle.cast("long").alias("idle_days"), F.round(pvo * stock, 2).alias("capital"))


def abcd(t: Tables) -> DataFrame:
    """The classes of all products by all their moves; products without moves have no facts."""
    parts = t.part.select(F.col("p_partkey").alias("product"), F.col("p_retailprice").alias("pvo"), F.col("p_size").cast("double").alias("stock"))
    return classify(parts.join(product_facts(moves(t), now()), "product", "left"), now())


ABCD = f"""WITH {FACTS},
base AS (SELECT p_partkey AS product, p_retailprice AS pvo, CAST(p_size AS DOUBLE) AS stock, f.* EXCLUDE (product) FROM part LEFT JOIN facts f ON p_partkey = f.product),
lim AS (SELECT quantile_cont(pvo, 0.8) AS p80 FROM base),
n AS (SELECT *, datediff('day', first_purchase, TIMESTAMP '{NOW}') AS age,
  coalesce(datediff('day', CASE WHEN last_restock > last_sale THEN last_restock ELSE last_sale END, TIMESTAMP '{NOW}'), 9999) AS idle FROM base, lim),
abcd AS (SELECT product, pvo, stock, first_purchase, last_restock, last_sale, sales_180, units_7,
  CASE WHEN stock > 0 AND age >= 90 AND idle >= 180 AND coalesce(sales_180, 0) = 0 THEN 'D' WHEN last_sale IS NOT NULL AND age >= 90 AND pvo >= p80 THEN 'A'
   WHEN last_sale IS NOT NULL OR age < 90 THEN 'B' ELSE 'C' END AS abcd,
  CASE WHEN stock > 0 AND age >= 90 AND idle >= 180 AND coalesce(sales_180, 0) = 0 THEN 'LIQUIDAR' WHEN last_sale IS NOT NULL THEN 'OK'
   WHEN age < 90 THEN CASE WHEN 90 - age <= 15 THEN 'REVISAR' ELSE 'OK' END ELSE 'BAJO IMPACTO' END AS alert,
  CAST(idle AS BIGINT) AS idle_days, round(pvo * stock, 2) AS capital FROM n)"""


@query("abcd_classification", f"{ABCD} SELECT * FROM abcd")
def _abcd(t: Tables) -> DataFrame:
    return abcd(t)


@query("abcd_summary", f"{ABCD} SELECT abcd, CAST(count(*) AS BIGINT) AS products, sum(stock) AS stock, round(sum(capital), 1) AS capital, round(avg(pvo), 1) AS mean_pvo FROM abcd GROUP BY abcd ORDER BY abcd")
def _abcd_summary(t: Tables) -> DataFrame:
    """A2, A3, T1."""
    return abcd(t).groupBy("abcd").agg(F.count("*").alias("products"), F.sum("stock").alias("stock"), F.round(F.sum("capital"), 1).alias("capital"), F.round(F.avg("pvo"), 1).alias("mean_pvo")).orderBy("abcd")


@query(
    "product_fact_star",
    f"""WITH {FACTS}, cheap AS (SELECT DISTINCT ON (l_partkey) l_partkey AS product, s_name AS supplier, s_acctbal AS balance FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey ORDER BY l_partkey, s_acctbal, s_suppkey),
inside AS (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1),
held AS (SELECT product, sum(CASE kind WHEN 'entry' THEN qty WHEN 'exit' THEN -qty ELSE 0 END) AS net FROM moves WHERE location IN (SELECT s_suppkey FROM inside) GROUP BY product)
SELECT p_partkey AS product, p_name AS name, f.first_purchase, f.last_sale, coalesce(f.sales_180, 0) AS sales_180, coalesce(h.net, 0.0) AS net, c.supplier, coalesce(c.balance, p_retailprice) AS cost
FROM part LEFT JOIN facts f ON p_partkey = f.product LEFT JOIN held h ON p_partkey = h.product LEFT JOIN cheap c ON p_partkey = c.product""",
)
def _star(t: Tables) -> DataFrame:
    """Facts, stock inside a region, and the preferred supplier beside every product."""
    rows = moves(t)
    inside = t.supplier.join(t.nation.where("n_regionkey = 1"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("location"))
    signed = F.when(F.col("kind") == "entry", F.col("qty")).when(F.col("kind") == "exit", -F.col("qty")).otherwise(0.0)
    held = rows.join(inside, "location", "left_semi").groupBy("product").agg(F.sum(signed).alias("net"))
    sold_by = t.lineitem.select(F.col("l_partkey").alias("product"), F.col("l_suppkey").alias("s_suppkey")).distinct().join(t.supplier, "s_suppkey")
    cheap = keyed.distinct_on(sold_by, ["product"], "s_acctbal", "s_suppkey").select("product", F.col("s_name").alias("supplier"), F.col("s_acctbal").alias("balance"))
    out = t.part.withColumnRenamed("p_partkey", "product").join(product_facts(rows, now()), "product", "left").join(held, "product", "left").join(cheap, "product", "left")
    return out.select(
        "product", F.col("p_name").alias("name"), "first_purchase", "last_sale", F.coalesce("sales_180", F.lit(0)).alias("sales_180"), F.coalesce("net", F.lit(0.0)).alias("net"), "supplier",
        F.coalesce("balance", "p_retailprice").alias("cost"),
    )


LEDGER = f"""{MOVES}, ledger AS (SELECT *, row_number() OVER w AS seq, sum(CASE kind WHEN 'entry' THEN qty WHEN 'exit' THEN -qty ELSE 0 END) OVER w AS stock
  FROM moves WINDOW w AS (PARTITION BY product ORDER BY moved_at, move_id ROWS UNBOUNDED PRECEDING))"""


@query("W4_running_stock", f"WITH {LEDGER} SELECT product, move_id, kind, CAST(seq AS INTEGER) AS seq, stock FROM ledger")
def _running(t: Tables) -> DataFrame:
    return ledger.running_stock(moves(t)).select("product", "move_id", "kind", "seq", "stock")


@query(
    "W5_stockout_periods",
    f"""WITH {LEDGER}, g AS (SELECT *, sum(CASE WHEN kind = 'entry' THEN 1 ELSE 0 END) OVER (PARTITION BY product ORDER BY moved_at, move_id ROWS UNBOUNDED PRECEDING) AS spell FROM ledger),
s AS (SELECT product, spell, min(CASE WHEN kind = 'entry' THEN moved_at END) AS entered_at, min(CASE WHEN stock <= 0 THEN moved_at END) AS started_at FROM g GROUP BY product, spell),
e AS (SELECT product, started_at, lead(entered_at) OVER (PARTITION BY product ORDER BY spell) AS ended_at FROM s)
SELECT product, started_at, ended_at, CAST(datediff('day', started_at, coalesce(ended_at, TIMESTAMP '{NOW}')) AS BIGINT) AS days FROM e WHERE started_at IS NOT NULL""",
)
def _stockouts(t: Tables) -> DataFrame:
    out = ledger.stockout_periods(ledger.running_stock(moves(t)))
    return out.withColumn("days", F.datediff(F.coalesce("ended_at", now()), "started_at").cast("long"))


@query(
    "W8_ledger_extremes",
    f"WITH {LEDGER} SELECT product, min(stock) AS least_stock, arg_min(moved_at, struct_pack(a := stock, b := seq)) AS least_at, CAST(count(*) FILTER (WHERE stock <= 1) AS BIGINT) AS critical_rows, arg_max(stock, seq) AS last_stock FROM ledger GROUP BY product",
)
def _extremes(t: Tables) -> DataFrame:
    return ledger.extremes(ledger.running_stock(moves(t)))


@query(
    "P5_movement_kinds",
    f"WITH {MOVES} SELECT kind, CAST(year(moved_at) AS INTEGER) AS year, CAST(count(*) AS BIGINT) AS rows, sum(CASE WHEN kind = 'other' THEN -qty ELSE qty END) AS listed_qty FROM moves GROUP BY ALL",
)
def _kinds(t: Tables) -> DataFrame:
    """The history lists other moves with the sign turned, though the stock ignores them."""
    qty = F.when(F.col("kind") == "other", -F.col("qty")).otherwise(F.col("qty"))
    return moves(t).groupBy("kind", F.year("moved_at").alias("year")).agg(F.count("*").alias("rows"), F.sum(qty).alias("listed_qty"))


@query(
    "K5_weekly_snapshot",
    f"""{ABCD}, s AS (SELECT CAST(date_trunc('week', coalesce(last_sale, TIMESTAMP '{NOW}')) AS DATE) AS snapshot_date, product, abcd FROM abcd)
SELECT snapshot_date, CAST(weekofyear(snapshot_date) AS INTEGER) AS iso_week, CAST(count(*) AS BIGINT) AS product_count, sha256(string_agg(product || ':' || abcd, ',' ORDER BY product)) AS data_sha256 FROM s GROUP BY snapshot_date""",
)
def _snapshot(t: Tables) -> DataFrame:
    """What a week's snapshot holds, with a digest that a re-read must give again."""
    rows = abcd(t).withColumn("snapshot_date", week_start(F.coalesce("last_sale", now())))
    return snapshot_rows(rows)


def snapshot_rows(rows: DataFrame) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("product", "abcd")))
    spelled = F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["product"].cast("string"), x["abcd"])), ",")
    out = rows.groupBy("snapshot_date").agg(F.count("*").alias("product_count"), F.sha2(spelled, 256).alias("data_sha256"))
    return out.select("snapshot_date", F.weekofyear("snapshot_date").alias("iso_week"), "product_count", "data_sha256")


@query("K5_committed_snapshots", f"""{ABCD} SELECT CAST(3 AS INTEGER) AS snapshot_id, product, abcd FROM abcd""")
def _committed(t: Tables) -> DataFrame:
    """K5, C4: two weeks, the second one run twice; its last run is read back by its digest."""
    store = SnapshotStore(t.spark, scratch(t.spark, "snapshots"))
    rows = abcd(t).select("product", "abcd")
    first, second, at = datetime.date(2025, 1, 6), datetime.date(2025, 1, 13), datetime.datetime(2025, 1, 13, 8, tzinfo=datetime.UTC)
    store.save(rows, first, at - datetime.timedelta(days=7), "1")
    store.save(rows.where("product % 2 = 0"), second, at, "1")
    store.save(rows, second, at + datetime.timedelta(hours=1), "1", {"margin_days": 90})
    back, reference = store.load_week(second)
    return back.select(F.lit(reference.snapshot_id).alias("snapshot_id"), "product", "abcd")
