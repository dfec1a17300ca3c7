"""Reviews and previews: what would be done with each row, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import keyed, monitoring
from .catalog import IMAGES, images
from .registry import Tables, query
from .views import OFFERS, PRODUCTS, offers, products


@query(
    "J10_latest_verified",
    f"""WITH {OFFERS}, {PRODUCTS}, v AS (SELECT *, row_number() OVER (PARTITION BY ean ORDER BY captured_at DESC, id DESC) AS rn FROM offers WHERE exact AND available)
SELECT p.ean, v.id AS offer_id, v.competitor_id FROM products p LEFT JOIN v ON p.ean = v.ean AND v.rn = 1""",
)
def _verified(t: Tables) -> DataFrame:
    """The newest verified row of each product, or none."""
    last = keyed.latest_per_key(offers(t).where("exact and available"), ["ean"], "captured_at", "id")
    return products(t).select("ean").join(last.select("ean", F.col("id").alias("offer_id"), "competitor_id"), "ean", "left")


@query(
    "J19_guarded_offers",
    f"""WITH {OFFERS}, {PRODUCTS}, watched AS (SELECT ean FROM products WHERE stock > 40), monitored AS (SELECT s_suppkey AS competitor_id FROM supplier WHERE s_nationkey < 10)
SELECT id, ean, competitor_id FROM offers o WHERE NOT (o.ean IN (SELECT ean FROM watched) AND o.competitor_id IN (SELECT competitor_id FROM monitored)) OR (o.exact AND o.vat AND o.captured_at >= TIMESTAMP '2000-01-01')""",
)
def _guarded(t: Tables) -> DataFrame:
    """Watched and monitored offers pass only if verified and fresh, others always."""
    watched = products(t).where("stock > 40").select("ean").withColumn("watched", F.lit(True))
    monitored = t.supplier.where("s_nationkey < 10").select(F.col("s_suppkey").alias("competitor_id")).withColumn("monitored", F.lit(True))
    flags = offers(t).join(watched, "ean", "left").join(monitored, "competitor_id", "left")
    guarded = F.coalesce(F.col("watched") & F.col("monitored"), F.lit(False))
    fresh = F.col("exact") & F.coalesce("vat", F.lit(False)) & (F.col("captured_at") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    return flags.where(~guarded | fresh).select("id", "ean", "competitor_id")


@query(
    "X2_batch_preview",
    f"""WITH {OFFERS}, {PRODUCTS}, l AS (SELECT *, row_number() OVER (PARTITION BY ean, competitor_id ORDER BY captured_at DESC, id DESC) AS rn FROM offers)
SELECT l.ean, l.competitor_id, CASE WHEN l.exact AND l.available THEN 'monitor' WHEN l.exact THEN 'reuse' WHEN l.available THEN 'review' ELSE 'locate' END AS action, p.stock > 5 AND l.exact AS ready,
  CASE WHEN p.stock <= 5 THEN 'low_stock' WHEN NOT l.exact THEN 'identity' WHEN l.vat IS NULL THEN 'vat' END AS defer_reason FROM l JOIN products p ON l.ean = p.ean WHERE rn = 1""",
)
def _preview(t: Tables) -> DataFrame:
    return preview(offers(t), t)


def preview(rows: DataFrame, t: Tables) -> DataFrame:
    """Action, readiness and the first reason to wait."""
    last = keyed.latest_per_key(rows, ["ean", "competitor_id"], "captured_at", "id").join(products(t), "ean")
    action = F.when(F.col("exact") & F.col("available"), "monitor").when(F.col("exact"), "reuse").when(F.col("available"), "review").otherwise("locate")
    reason = F.when(F.col("stock") <= 5, "low_stock").when(~F.col("exact"), "identity").when(F.col("vat").isNull(), "vat")
    return last.select("ean", "competitor_id", action.alias("action"), ((F.col("stock") > 5) & F.col("exact")).alias("ready"), reason.alias("defer_reason"))


def registered_pages(pages: DataFrame, state: str | None = None) -> DataFrame:
    """An argument that is None asks for nothing."""
    return pages.where("state <> 'replaced'").where(F.lit(state).isNull() | (F.col("state") == F.lit(state)))


@query("X6_registered_pages", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'review' ELSE 'replaced' END AS state FROM pages WHERE page_id % 3 <> 2")
def _registered(t: Tables) -> DataFrame:
    n = F.col("page_id") % 3
    return registered_pages(t.pages.select("page_id", F.when(n == 0, "active").when(n == 1, "review").otherwise("replaced").alias("state")))


@query(
    "X12_attribute_overlay",
    """WITH e AS (SELECT l_partkey, min(l_linenumber) AS caliber, min(l_suppkey % 2) AS brand_ok FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey)
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size WHEN brand_ok = 1 THEN caliber END AS caliber, CASE WHEN p_size % 2 = 1 AND brand_ok = 0 THEN 'conflict' END AS message FROM part LEFT JOIN e ON p_partkey = l_partkey""",
)
def _overlay(t: Tables) -> DataFrame:
    """Evidence fills a gap only where the identity agrees."""
    evidence = t.lineitem.where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_linenumber").alias("found"), F.min(F.col("l_suppkey") % 2).alias("agrees"))
    rows = t.part.join(evidence, "p_partkey", "left")
    own = F.when(F.col("p_size") % 2 == 0, F.col("p_size"))
    return rows.select("p_partkey", F.coalesce(own, F.when(F.col("agrees") == 1, F.col("found"))).alias("caliber"), F.when(own.isNull() & (F.col("agrees") == 0), "conflict").alias("message"))


@query(
    "X17_order_evidence",
    f"""WITH {IMAGES}, p AS (SELECT ean, pixels, count(DISTINCT view) > 1 AS conflict FROM images GROUP BY ean, pixels), e AS (SELECT ean, count(*) AS photos, bool_or(conflict) AS conflict FROM p GROUP BY ean)
SELECT l_orderkey AS order_id, CAST(count(DISTINCT lpad(CAST(l_partkey AS VARCHAR), 13, '0')) AS BIGINT) AS eans, CAST(sum(photos) AS BIGINT) AS photos, bool_or(conflict) AS conflict FROM lineitem JOIN e ON e.ean = lpad(CAST(l_partkey AS VARCHAR), 13, '0') GROUP BY l_orderkey""",
)
def _evidence(t: Tables) -> DataFrame:
    """Photos by pixels, then by product, then by order.

    Rows are dealt by product or order before they are grouped: keys repeat too seldom for
    a task to gain by grouping what it reads, which takes memory by the size of its file.
    """
    view = F.col("view")
    place = F.when(view == "frontal", 0).when(view == "lateral", 1).when(view == "perspectiva", 2).otherwise(3)
    shots = images(t).select("ean", "pixels", place.alias("view")).repartition("ean")
    photos = shots.groupBy("ean", "pixels").agg((F.min("view") < F.max("view")).alias("conflict"))
    per = photos.groupBy("ean").agg(F.count("*").alias("photos"), F.bool_or("conflict").alias("conflict"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("order_id"), F.lpad(F.col("l_partkey").cast("string"), 13, "0").alias("ean"))
    by_ean = lines.join(per, "ean").repartition("order_id").groupBy("order_id", "ean").agg(F.sum("photos").alias("photos"), F.bool_or("conflict").alias("conflict"))
    return by_ean.groupBy("order_id").agg(F.count("ean").alias("eans"), F.sum("photos").alias("photos"), F.bool_or("conflict").alias("conflict"))


@query(
    "X29_library_filter",
    f"""WITH {IMAGES}, g AS (SELECT ean, list(DISTINCT provider) AS providers, list(DISTINCT view) AS views FROM images GROUP BY ean)
SELECT ean, CAST(len(views) AS INTEGER) AS views FROM g WHERE list_contains(providers, 'p2') AND NOT list_contains(views, 'lateral')""",
)
def _filter(t: Tables) -> DataFrame:
    groups = images(t).groupBy("ean").agg(F.collect_set("provider").alias("providers"), F.collect_set("view").alias("views"))
    return groups.where(F.array_contains("providers", "p2") & ~F.array_contains("views", "lateral")).select("ean", F.size("views").alias("views"))


@query(
    "X30_vat_policy",
    """WITH policy(host, vat) AS (VALUES ('example.com', 21), ('example.org', 10)), p AS (SELECT page_id, regexp_extract(url, '([a-z]+\\.[a-z]+)[/?#]', 1) AS host FROM pages)
SELECT page_id, p.host, CAST(coalesce(vat, 4) AS INTEGER) AS vat, vat IS NOT NULL AND page_id % 7 = 0 AS contradiction FROM p LEFT JOIN policy ON p.host = policy.host""",
)
def _policy(t: Tables) -> DataFrame:
    """A registered host's policy, else the page's own; a contradiction is flagged."""
    policy = t.spark.createDataFrame([("example.com", 21), ("example.org", 10)], "host string, rule int")
    rows = t.pages.select("page_id", F.regexp_extract("url", r"([a-z]+\.[a-z]+)[/?#]", 1).alias("host")).join(F.broadcast(policy), "host", "left")
    return rows.select("page_id", "host", F.coalesce("rule", F.lit(4)).alias("vat"), (F.col("rule").isNotNull() & (F.col("page_id") % 7 == 0)).alias("contradiction"))


@query(
    "X32_market_evidence",
    """WITH p AS (SELECT p_partkey AS page_id, CASE p_partkey % 3 WHEN 0 THEN 'ES' WHEN 1 THEN 'PT' ELSE '' END AS market, p_partkey % 13 = 0 AS clash, CASE WHEN p_size % 2 = 0 AND p_size % 5 > 0 AND p_size % 7 > 0 THEN CASE WHEN p_partkey % 4 < 2 THEN 'ES' ELSE 'FR' END ELSE '' END AS set FROM part),
q AS (SELECT *, clash OR (market <> '' AND set <> '' AND market <> set) AS review FROM p)
SELECT page_id, CASE WHEN market <> '' THEN market ELSE set END AS sales_market, CASE WHEN review THEN 'contradictorio' WHEN market <> '' THEN 'ficha' WHEN set <> '' THEN 'configuración' ELSE 'sin evidencia' END AS market_reason, review AS market_review FROM q""",
)
def _markets(t: Tables) -> DataFrame:
    """The market of a page's price by the page, by its shop's verified settings, or by nothing."""
    k, n = F.col("p_partkey"), F.col("p_size")
    pages = t.part.select(
        k.alias("page_id"), F.when(k % 3 == 0, "ES").when(k % 3 == 1, " PT").alias("market"), F.lit("ficha").alias("market_source"), F.when(k % 13 == 0, True).alias("market_conflict"), F.when(k % 4 < 2, "ES").otherwise("FR").alias("configured_market"),
        (n % 2 == 0).alias("market_verified"), F.when(n % 5 > 0, "https://s.example").otherwise(" ").alias("evidence_url"), F.when(n % 7 > 0, "note").alias("market_note"),
    )
    return monitoring.resolved_markets(pages).select("page_id", "sales_market", "market_reason", "market_review")


@query(
    "A30_catalog_audit",
    "SELECT p_type, p_size > 25 AS large, p_brand LIKE '%1%' AS ones, CAST(count(*) AS BIGINT) AS items, min(p_retailprice) AS least, max(p_retailprice) AS most FROM part GROUP BY ALL",
)
def _audit(t: Tables) -> DataFrame:
    return t.part.groupBy("p_type", (F.col("p_size") > 25).alias("large"), F.col("p_brand").contains("1").alias("ones")).agg(F.count("*").alias("items"), F.min("p_retailprice").alias("least"), F.max("p_retailprice").alias("most"))


@query(
    "A28_trial_continuity",
    "SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS receipts, CAST(count(DISTINCT CASE WHEN value > 50 THEN user_id END) AS BIGINT) AS with_http, CAST(count(*) - count(DISTINCT user_id) AS BIGINT) AS reused FROM events GROUP BY event_type",
)
def _continuity(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(
        F.count_distinct("user_id").alias("receipts"), F.count_distinct(F.when(F.col("value") > 50, F.col("user_id"))).alias("with_http"), (F.count("*") - F.count_distinct("user_id")).alias("reused")
    )


@query("S3_keyed_read", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 3 AND l_quantity > 40)")
def _keyed(t: Tables) -> DataFrame:
    """A semi-join in place of chunked IN lists."""
    keys = t.lineitem.where("l_suppkey = 3 and l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(keys, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")
