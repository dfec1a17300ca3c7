"""Watch lists, job queues, budgets, alerts and process figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import gate, grid, keyed, monitoring, series
from ..sources.keyed_table import KeyedTable
from ..sources.tables import scratch
from .registry import Tables, query
from .views import OFFERS, PRODUCTS, offers, products


def matching_rules(catalog: DataFrame, rules: DataFrame) -> DataFrame:
    """Products of each rule; an empty field of a rule asks for nothing.

    ``rules``: rule, brand, category, part (text inside the name). Rules with a brand meet
    products on it, those with a category alone on that; all others are compared with all products.
    """
    fits = (F.coalesce(F.lower("r_category") == F.lower("category"), F.lit(True))) & F.coalesce(F.lower("name").contains(F.lower("r_part")), F.lit(True))
    named = rules.select("rule", F.lower("brand").alias("__brand"), F.col("category").alias("r_category"), F.col("part").alias("r_part"))
    rows = catalog.withColumn("__key", F.lower("brand"))
    with_brand = rows.join(named.where("__brand is not null"), F.col("__key") == F.col("__brand")).where(fits)
    unbranded = named.where("__brand is null")
    by_category = rows.join(unbranded.where("r_category is not null"), F.lower("category") == F.lower("r_category")).where(fits)
    by_text = rows.join(unbranded.where("r_category is null"), fits)
    return with_brand.unionByName(by_category).unionByName(by_text).select("rule", "ean", "brand", "category", "name")


@query(
    "P18_watch_rules",
    f"""WITH {PRODUCTS}, rules(rule, brand, category, part) AS (VALUES (1, 'brand#3', NULL, 'ring'), (2, 'BRAND#4', 'promo', NULL), (3, NULL, 'SMALL', 'red'), (4, 'Brand#5', NULL, NULL))
SELECT CAST(rule AS INTEGER) AS rule, p.ean, p.brand, p.category, p.name FROM products p JOIN rules r ON (r.brand IS NULL OR lower(r.brand) = lower(p.brand)) AND (r.category IS NULL OR lower(r.category) = lower(p.category)) AND (r.part IS NULL OR contains(lower(p.name), r.part))""",
)
def _rules(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([(1, "brand#3", None, "ring"), (2, "BRAND#4", "promo", None), (3, None, "SMALL", "red"), (4, "Brand#5", None, None)], "rule int, brand string, category string, part string")
    return matching_rules(products(t).select("ean", "brand", "category", "name"), rules)


GRID = f"""{OFFERS}, {PRODUCTS}, watched AS (SELECT ean, own_price FROM products WHERE brand = 'Brand#9'), shops AS (SELECT s_suppkey AS competitor_id FROM supplier WHERE s_acctbal > 5000),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ean, competitor_id ORDER BY captured_at DESC, id DESC) AS rn FROM offers) WHERE rn = 1),
grid AS (SELECT w.ean, s.competitor_id, l.id, l.price, CASE WHEN l.id IS NULL THEN 'not_located' WHEN NOT l.exact THEN 'review' WHEN l.vat IS NULL THEN 'vat_unknown' WHEN NOT l.available THEN 'no_stock' WHEN l.captured_at < TIMESTAMP '2000-01-01' THEN 'expired' ELSE 'current' END AS status
  FROM watched w CROSS JOIN shops s LEFT JOIN last l ON l.ean = w.ean AND l.competitor_id = s.competitor_id)"""


def _watched(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Watched products, active competitors, and the newest offer of each of their pairs with the first status that fits."""
    watched = products(t).where("brand = 'Brand#9'").select("ean")
    shops = t.supplier.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("competitor_id"))
    # the scope comes first: only offers of watched products at active shops are compared
    last = keyed.newest(grid.scoped(offers(t), watched, shops), ["ean", "competitor_id"], "captured_at", "id")
    status = (
        F.when(F.col("id").isNull(), "not_located").when(~F.col("exact"), "review").when(F.col("vat").isNull(), "vat_unknown").when(~F.col("available"), "no_stock")
        .when(F.col("captured_at") < F.lit("2000-01-01").cast("timestamp_ntz"), "expired").otherwise("current")
    )
    return watched, shops, last.select("ean", "competitor_id", "id", "price", status.alias("status"))


def monitoring_grid(t: Tables) -> DataFrame:
    """Every watched product at every active competitor, the first status that fits, the best current price of the product beside it.

    The grid is what is asked for: a hand-made watch list times the competitors.
    """
    rows = grid.cells(*_watched(t), best_price=F.min(F.when(F.col("status") == "current", F.col("price"))))
    return rows.select("ean", "competitor_id", "id", "price", F.coalesce("status", F.lit("not_located")).alias("status"), "best_price")


@query("X1_monitoring_grid", f"WITH {GRID} SELECT ean, competitor_id, id, price, status, min(CASE WHEN status = 'current' THEN price END) OVER (PARTITION BY ean) AS best_price FROM grid")
def _grid(t: Tables) -> DataFrame:
    return monitoring_grid(t)


@query(
    "A32_coverage_matrix",
    f"""WITH {GRID} SELECT ean, CAST(count(*) AS BIGINT) AS pairs, CAST(count(*) FILTER (WHERE status = 'current') AS BIGINT) AS current, bool_or(status = 'review') AS any_review, bool_and(status = 'not_located') AS none_located, string_agg(DISTINCT status, ',' ORDER BY status) AS states FROM grid GROUP BY ean""",
)
def _matrix(t: Tables) -> DataFrame:
    """One row a product, with the set of its states."""
    s, n = F.col("state"), F.col("n")
    return grid.counted(*_watched(t), F.col("status"), "not_located").groupBy("ean").agg(
        F.sum("n").alias("pairs"), F.sum(F.when(s == "current", n).otherwise(0)).alias("current"), F.bool_or(s == "review").alias("any_review"), F.bool_and(s == "not_located").alias("none_located"), F.array_join(F.array_sort(F.collect_set("state")), ",").alias("states")
    )


@query(
    "X9_ordered_classes",
    f"""WITH {GRID}, classes(class) AS (VALUES ('current'), ('no_stock'), ('review'), ('vat_unknown'), ('expired'), ('not_located'), ('blocked')) SELECT class, CAST(count(grid.ean) AS BIGINT) AS pairs FROM classes LEFT JOIN grid ON class = status GROUP BY class""",
)
def _classes(t: Tables) -> DataFrame:
    """Classes without rows are reported too."""
    counts = grid.counted(*_watched(t), F.col("status"), "not_located").groupBy("state").agg(F.sum("n").alias("n"))
    classes = t.spark.createDataFrame([(c,) for c in ("current", "no_stock", "review", "vat_unknown", "expired", "not_located", "blocked")], "class string")
    return classes.join(counts, F.col("class") == F.col("state"), "left").select("class", F.coalesce("n", F.lit(0)).alias("pairs"))


EPOCH = "e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS secs, event_type, value, props FROM events)"


def _events(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), "event_type", "value", "props")


GATE = f"""WITH RECURSIVE {EPOCH}, k AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM e),
q AS (SELECT event_id, user_id, secs, CASE WHEN user_id % 11 = 0 THEN 'prohibited' WHEN user_id % 11 = 1 THEN 'not_authorized' END AS refused, 2 + user_id % 3 AS daily, 1 + user_id % 2 AS per_minute, CASE WHEN user_id % 4 = 0 THEN 0 ELSE 1800 END AS pause FROM k WHERE event_type <> 'error'),
i AS (SELECT user_id, secs, CASE WHEN k % 8 > 0 THEN secs + 3600 * (k % 12) END AS retry_after, CASE WHEN k % 3 > 0 THEN secs + 43200 * (k % 5) END AS closed_at FROM k WHERE event_type = 'error'),
j AS (SELECT q.*, retry_after, i.user_id IS NOT NULL AND (closed_at IS NULL OR closed_at > q.secs) AS held FROM q ASOF LEFT JOIN i ON q.user_id = i.user_id AND q.secs >= i.secs),
r AS (SELECT event_id, user_id, secs, daily, per_minute, pause, row_number() OVER (PARTITION BY user_id ORDER BY secs, event_id) AS n, coalesce(refused, CASE WHEN held AND retry_after IS NULL THEN 'blocked_manual' WHEN held AND retry_after > secs THEN 'blocked_wait' END) AS refused, retry_after FROM j),
g AS (SELECT user_id, 0 AS n, CAST([] AS BIGINT[]) AS grants, CAST(NULL AS BIGINT) AS event_id, '' AS gate, CAST(NULL AS DOUBLE) AS retry_at FROM (SELECT DISTINCT user_id FROM r)
UNION ALL SELECT user_id, n, CASE WHEN gate = 'allowed' THEN list_append(day, secs) ELSE day END, event_id, gate, CASE gate WHEN 'blocked_wait' THEN retry_after WHEN 'budget_daily' THEN day[-daily] + 86400 WHEN 'rate_minute' THEN day[-per_minute] + 60 WHEN 'pause' THEN day[-1] + pause END
FROM (SELECT *, CASE WHEN refused IS NOT NULL THEN refused WHEN len(day) >= daily THEN 'budget_daily' WHEN len(list_filter(day, lambda x: x > secs - 60)) >= per_minute THEN 'rate_minute' WHEN len(day) > 0 AND pause > 0 AND day[-1] + pause > secs THEN 'pause' ELSE 'allowed' END AS gate
FROM (SELECT r.*, list_filter(g.grants, lambda x: x > r.secs - 86400) AS day FROM g JOIN r ON r.user_id = g.user_id AND r.n = g.n + 1)))
SELECT event_id, gate, retry_at FROM g WHERE n > 0"""


@query("W10_budget_gate", GATE)
def _gate(t: Tables) -> DataFrame:
    """Authorisation, then incidents, then budgets of which only granted requests use."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = _events(t).withColumn("k", k)
    user, at = F.col("user_id"), F.col("at")
    opened = rows.where("event_type = 'error'").select("user_id", "at", F.when(F.col("k") % 8 > 0, at + 3600 * (F.col("k") % 12)).alias("retry_after"), F.when(F.col("k") % 3 > 0, at + 43200 * (F.col("k") % 5)).alias("closed_at"))
    asked = rows.where("event_type <> 'error'").select("event_id", "user_id", "at", F.when(user % 11 == 0, "prohibited").when(user % 11 == 1, "not_authorized").alias("refused"))
    held = gate.with_incidents(asked, opened, ["user_id"], "at")
    limits = {"daily": 2 + user % 3, "per_minute": 1 + user % 2, "pause": F.when(user % 4 == 0, 0).otherwise(1800)}
    return gate.rolling_budget(held, ["user_id"], "at", "event_id", **limits).select("event_id", "gate", "retry_at")


@query(
    "W11_cycle_spread",
    "SELECT event_id, user_id, CAST(floor((row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) / 50) * 30 AS BIGINT) AS delay FROM events",
)
def _spread(t: Tables) -> DataFrame:
    return series.spread(t.events, ["event_type"], 50, 30, "ts", "event_id").select("event_id", "user_id", "delay")


@query(
    "X19_failure_streaks",
    "WITH c AS (SELECT user_id, sum(CASE WHEN event_type IN ('error', 'view', 'click') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS broken FROM events) SELECT user_id, CAST(count(*) FILTER (WHERE broken = 0) AS BIGINT) AS streak FROM c GROUP BY user_id",
)
def _streaks(t: Tables) -> DataFrame:
    failed = F.col("event_type").isin("error", "view", "click")
    return series.leading_streak(t.events, ["user_id"], failed, F.desc("ts"), F.desc("event_id"))


@query(
    "R3_alert_keys",
    "SELECT sha256(CAST(user_id AS VARCHAR) || '|' || event_type || '|' || strftime(ts, '%Y-%m-%d')) AS event_key, min(event_id) AS first_event, CAST(count(*) AS BIGINT) AS seen FROM events WHERE value > 100 GROUP BY 1",
)
def _alerts(t: Tables) -> DataFrame:
    """One alert a user, kind and day."""
    key = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd")), 256)
    return t.events.where("value > 100").groupBy(key.alias("event_key")).agg(F.min("event_id").alias("first_event"), F.count("*").alias("seen"))


@query(
    "R4_edge_changes",
    """WITH c AS (SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS previous FROM events)
SELECT event_id, user_id, CASE WHEN value >= previous * 1.05 THEN 'price_up' WHEN value <= previous * 0.95 THEN 'price_down' END AS kind FROM c WHERE previous IS NOT NULL AND (value >= previous * 1.05 OR value <= previous * 0.95)""",
)
def _edges(t: Tables) -> DataFrame:
    """What changed by 5 % or more against the sample before."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    was = F.lag("value").over(w)
    kind = F.when(F.col("value") >= F.col("previous") * 1.05, "price_up").when(F.col("value") <= F.col("previous") * 0.95, "price_down")
    return t.events.withColumn("previous", was).withColumn("kind", kind).where("kind is not null").select("event_id", "user_id", "kind")


@query(
    "R4_sample_alerts",
    f"""WITH {EPOCH}, s AS (SELECT event_id, user_id, event_type, secs, CASE WHEN event_id % 3 = 0 THEN 'unavailable' ELSE 'available' END AS availability, value AS price, event_id % 5 > 0 AS tax, CASE WHEN event_id % 7 = 0 THEN 'no price' END AS gap, event_id % 11 = 0 AS conflict, CASE WHEN user_id % 6 > 0 THEN 20.0 + user_id % 40 END AS own, event_id % 4 > 0 AND event_id % 7 > 0 AS eligible FROM e),
p AS (SELECT *, lag(availability) OVER w AS a0, lag(price) OVER w AS p0, coalesce(lag(tax AND gap IS NULL) OVER w, false) AS ok0, lag(conflict) OVER w AS c0, lag(own) OVER w AS o0 FROM s WINDOW w AS (PARTITION BY user_id, event_type ORDER BY secs, event_id))
SELECT event_id, 'availability' AS kind, a0 AS old_value, availability AS new_value FROM p WHERE a0 <> availability
UNION ALL SELECT event_id, CASE WHEN price > p0 THEN 'price_up' ELSE 'price_down' END, 'price', 'price' FROM p WHERE tax AND gap IS NULL AND ok0 AND p0 <> 0 AND abs((price - p0) / p0 * 100) >= 5
UNION ALL SELECT event_id, 'undercut', 'price', 'price' FROM p WHERE eligible AND price < own AND NOT coalesce(ok0 AND a0 = 'available' AND NOT c0 AND p0 < o0, false)""",
)
def _sample_alerts(t: Tables) -> DataFrame:
    """Availability, moves and undercuts at their edges."""
    i = F.col("event_id")
    samples = _events(t).select(
        "event_id", "user_id", "event_type", "at", F.when(i % 3 == 0, "unavailable").otherwise("available").alias("availability"), F.col("value").alias("price"), (i % 5 > 0).alias("includes_tax"), F.when(i % 7 == 0, "no price").alias("gap"), (i % 11 == 0).alias("stock_conflict"),
        F.when(F.col("user_id") % 6 > 0, F.lit(20.0) + F.col("user_id") % 40).alias("own_price"), ((i % 4 > 0) & (i % 7 > 0)).alias("eligible"),
    )
    alerts = monitoring.sample_alerts(samples.withColumn("moment", F.struct("at", "event_id")), ["user_id", "event_type"], "moment")
    shown = lambda c: F.when(F.col("kind") == "availability", F.col(c)).otherwise("price").alias(c)
    return alerts.select("moment.event_id", "kind", shown("old_value"), shown("new_value"))


@query(
    "R9_window_counts",
    "SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS started, CAST(count(*) AS BIGINT) AS attempts FROM events WHERE event_type = 'error' GROUP BY ALL",
)
def _windows(t: Tables) -> DataFrame:
    rows = t.events.where("event_type = 'error'").groupBy("user_id", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("attempts"))
    return rows.select("user_id", F.col("w.start").alias("started"), "attempts")


@query(
    "A22_json_rollup",
    """WITH e AS (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events), n AS (SELECT event_type, count(*) AS errors FROM e WHERE k > 50 GROUP BY event_type)
SELECT e.event_type, CAST(count(*) AS BIGINT) AS attempts, CAST(sum(k) AS BIGINT) AS total, CAST(max(CASE WHEN value > 100 THEN k END) AS BIGINT) AS most, CAST(coalesce(min(n.errors), 0) AS BIGINT) AS high FROM e LEFT JOIN n ON e.event_type = n.event_type GROUP BY e.event_type""",
)
def _json(t: Tables) -> DataFrame:
    """A22, J11, N1, N6, C17."""
    rows = t.events.select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"), "value")
    high = rows.where("k > 50").groupBy("event_type").agg(F.count("*").alias("high"))
    return rows.groupBy("event_type").agg(F.count("*").alias("attempts"), F.sum("k").alias("total"), F.max(F.when(F.col("value") > 100, F.col("k"))).alias("most")).join(high, "event_type", "left").withColumn("high", F.coalesce("high", F.lit(0)))


@query(
    "J17_json_each",
    "SELECT event_type, key, CAST(sum(CAST(val AS BIGINT)) AS BIGINT) AS total FROM (SELECT event_type, unnest(json_keys(props)) AS key, json_extract_string(props, '$.k') AS val FROM events) GROUP BY ALL",
)
def _each(t: Tables) -> DataFrame:
    """An object's entries as rows."""
    entries = t.events.select("event_type", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "val"))
    return entries.groupBy("event_type", "key").agg(F.sum("val").alias("total"))


@query(
    "K6_upsert_states",
    """WITH old AS (SELECT user_id, max(value) AS best, min(event_type) AS kind FROM events WHERE event_id % 2 = 0 GROUP BY user_id), new AS (SELECT user_id, max(value) AS best, CASE WHEN user_id % 3 = 0 THEN ' ' ELSE max(event_type) END AS kind FROM events WHERE event_id % 2 = 1 AND user_id > 40 GROUP BY user_id)
SELECT coalesce(n.user_id, o.user_id) AS user_id, greatest(n.best, o.best) AS best, coalesce(nullif(trim(n.kind), ''), o.kind) AS kind FROM old o FULL JOIN new n ON o.user_id = n.user_id""",
)
def _upsert(t: Tables) -> DataFrame:
    old = t.events.where("event_id % 2 = 0").groupBy("user_id").agg(F.max("value").alias("best"), F.min("event_type").alias("kind"))
    new = t.events.where("event_id % 2 = 1 and user_id > 40").groupBy("user_id").agg(F.max("value").alias("best"), F.when(F.col("user_id") % 3 == 0, " ").otherwise(F.max("event_type")).alias("kind"))
    table = KeyedTable.create(t.spark, scratch(t.spark, "states"), old.schema, ["user_id"], 8)
    table.upsert(old, ["user_id"])
    table.upsert(new, ["user_id"], newest=["best"])
    return table.read()


@query(
    "K7_insert_or_ignore",
    "WITH f AS (SELECT event_id, event_id % 3 = 0 AS fresh, sha256(CAST(user_id AS VARCHAR) || ':' || event_type || ':' || CAST(floor(value / 50) AS BIGINT)) AS fp FROM events) SELECT fp, min(event_id) AS event_id FROM f WHERE fresh AND fp NOT IN (SELECT fp FROM f WHERE NOT fresh) GROUP BY fp",
)
def _ignore(t: Tables) -> DataFrame:
    """K7: every third event arrives after the others; fingerprints that these have are left out."""
    fp = F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), "event_type", F.floor(F.col("value") / 50).cast("string")), 256)
    rows = t.events.select("event_id", fp.alias("fp"))
    first = rows.where("event_id % 3 = 0").groupBy("fp").agg(F.min("event_id").alias("event_id"))
    return keyed.insert_or_ignore(rows.where("event_id % 3 > 0"), first, "fp")


@query(
    "R8_enqueue_missing",
    """WITH pairs AS (SELECT DISTINCT user_id, event_type FROM events), jobs AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('click', 'view'))
SELECT p.user_id, p.event_type, CASE WHEN j.user_id IS NULL THEN 'pending' WHEN p.event_type = 'view' THEN 'inactive' ELSE 'done' END AS state FROM pairs p LEFT JOIN jobs j ON p.user_id = j.user_id AND p.event_type = j.event_type""",
)
def _enqueue(t: Tables) -> DataFrame:
    """Missing pairs are added, others change state."""
    pairs = t.events.select("user_id", "event_type").distinct()
    jobs = pairs.where(F.col("event_type").isin("click", "view"))
    fresh = pairs.join(jobs, ["user_id", "event_type"], "left_anti").withColumn("state", F.lit("pending"))
    return fresh.unionByName(jobs.withColumn("state", F.when(F.col("event_type") == "view", "inactive").otherwise("done")))


@query(
    "T6_priority_queue",
    "SELECT event_id, user_id, value FROM events e WHERE event_type = 'error' ORDER BY CASE WHEN EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.value > 400) THEN 0 ELSE 1 END, ts, event_id LIMIT 100",
)
def _queue(t: Tables) -> DataFrame:
    """A batch of the queue, so its size stays."""
    first = t.events.where("value > 400").select("user_id").distinct().withColumn("urgent", F.lit(0))
    rows = t.events.where("event_type = 'error'").join(first, "user_id", "left")
    return rows.orderBy(F.coalesce("urgent", F.lit(1)), "ts", "event_id").limit(100).select("event_id", "user_id", "value")


@query(
    "X27_effective_interval",
    "SELECT c_custkey AS watched, coalesce(CASE WHEN c_acctbal > 8000 THEN 6 END, CASE WHEN n_regionkey = 2 THEN 12 END, 24) AS hours FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'",
)
def _interval(t: Tables) -> DataFrame:
    """The group's interval, else the competitor's, else a day."""
    rows = t.customer.where("c_mktsegment = 'BUILDING'").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_custkey").alias("watched"), F.coalesce(F.when(F.col("c_acctbal") > 8000, 6), F.when(F.col("n_regionkey") == 2, 12), F.lit(24)).alias("hours"))


@query(
    "X28_watch_additions",
    f"""WITH {PRODUCTS}, asked AS (SELECT lpad(CAST(l_partkey * 3 AS VARCHAR), 13, '0') AS ean, min(l_orderkey) AS first FROM lineitem GROUP BY 1)
SELECT a.ean, CASE WHEN p.ean IS NULL THEN 'rejected' WHEN p.category = 'PROMO' THEN 'already' WHEN p.category = 'LARGE' THEN 'reactivated' ELSE 'added' END AS outcome, CASE WHEN p.ean IS NULL THEN 'unknown_product' END AS reason FROM asked a LEFT JOIN products p ON a.ean = p.ean""",
)
def _additions(t: Tables) -> DataFrame:
    asked = t.lineitem.select(F.lpad((F.col("l_partkey") * 3).cast("string"), 13, "0").alias("ean")).distinct()
    rows = asked.join(products(t).select("ean", "category"), "ean", "left")
    outcome = F.when(F.col("category").isNull(), "rejected").when(F.col("category") == "PROMO", "already").when(F.col("category") == "LARGE", "reactivated").otherwise("added")
    return rows.select("ean", outcome.alias("outcome"), F.when(F.col("category").isNull(), "unknown_product").alias("reason"))


@query(
    "J18_routes",
    "SELECT p_partkey AS product, CASE WHEN n = 1 THEN 'Proveedor ' || CAST(one AS VARCHAR) WHEN n > 1 THEN 'Revisión' ELSE 'Sin ruta' END AS route FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey % 4) AS n, min(l_suppkey % 4) AS one FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'A' GROUP BY l_partkey) ON p_partkey = l_partkey",
)
def _routes(t: Tables) -> DataFrame:
    of = t.lineitem.where("l_quantity > 30 and l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_distinct(F.col("l_suppkey") % 4).alias("n"), F.min(F.col("l_suppkey") % 4).alias("one"))
    route = F.when(F.col("n") == 1, F.concat(F.lit("Proveedor "), F.col("one").cast("string"))).when(F.col("n") > 1, "Revisión").otherwise("Sin ruta")
    return t.part.join(of, "p_partkey", "left").select(F.col("p_partkey").alias("product"), route.alias("route"))


@query("P9_text_search", "SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name || ' ' || p_brand), 'red') OR lower(p_brand) LIKE '%#1\\_%' ESCAPE '\\' OR p_name ILIKE '%bolt'")
def _search(t: Tables) -> DataFrame:
    """Literal search over joined fields, LIKE with escapes, ILIKE."""
    named = text.search_any([F.col("p_name"), F.col("p_brand")], "red")
    return t.part.where(named | text.like_literal(F.col("p_brand"), "#1_") | F.col("p_name").ilike("%bolt")).select("p_partkey", "p_name", "p_brand")


@query("F17_canonical_urls", "SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', '') || CASE WHEN url LIKE '%?page=%' THEN regexp_extract(url, '\\?page=[0-9]+') ELSE '' END AS url FROM pages")
def _urls(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.canonical_url(F.col("url")).alias("url"))
