"""Prices: comparable offers, dashboard, rankings, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, money
from ..operators import keyed, series
from .registry import Tables, query
from .views import NOW, OFFERS, PRODUCTS, now, offers, products



def half_up(c: Column | str) -> Column:
    """Four decimals, a tie upwards."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * 10000 + 0.5) / 10000


def mean(c: str) -> Column:
    """The mean of the values to six decimals: their sum is exact, whatever its order."""
    return F.sum(F.floor(F.col(c) * 1000000 + 0.5)) / 1000000.0 / F.count(c)


def _half_up(sql: str) -> str:
    return f"floor(({sql}) * 10000 + 0.5) / 10000"


def _mean(sql: str) -> str:
    return f"(sum(CAST(floor(({sql}) * 1000000 + 0.5) AS BIGINT)) / 1000000.0::DOUBLE / count({sql}))"


SINCE = "2001-08-05 00:00:00"
LATEST = f"""{OFFERS}, {PRODUCTS}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ean, competitor_id ORDER BY captured_at DESC, id DESC) AS rn FROM offers WHERE exact) WHERE rn = 1),
comparable AS (SELECT l.ean, l.competitor_id, l.price, l.captured_at, p.brand, p.name, p.own_price, (l.price - p.own_price) / p.own_price * 100 AS difference_pct
  FROM latest l JOIN products p ON l.ean = p.ean WHERE l.available AND l.vat AND p.own_price > 0)"""


def comparable(t: Tables) -> DataFrame:
    """§2.10: the latest exact offer of each pair, and only then whether it can be compared."""
    # dealt by ean once, for the latest of each pair, the products and the groups by ean that follow
    latest = keyed.latest_per_key(offers(t).where("exact").repartition("ean"), ["ean", "competitor_id"], "captured_at", "id")
    usable = latest.where("available and vat").select("ean", "competitor_id", "price", "captured_at")
    joined = usable.join(products(t).where("own_price > 0").select("ean", "brand", "name", "own_price"), "ean")
    return joined.withColumn("difference_pct", (F.col("price") - F.col("own_price")) / F.col("own_price") * 100)


@query("A10_latest_offers", f"WITH {OFFERS} SELECT ean, competitor_id, id, price, available FROM (SELECT *, row_number() OVER (PARTITION BY ean, competitor_id ORDER BY captured_at DESC, id DESC) AS rn FROM offers) WHERE rn = 1")
def _latest(t: Tables) -> DataFrame:
    return keyed.latest_per_key(offers(t), ["ean", "competitor_id"], "captured_at", "id").select("ean", "competitor_id", "id", "price", "available")


@query("J4_comparable_pairs", f"WITH {LATEST} SELECT ean, competitor_id, price, own_price, {_half_up("difference_pct")} AS difference_pct FROM comparable")
def _pairs(t: Tables) -> DataFrame:
    return comparable(t).select("ean", "competitor_id", "price", "own_price", half_up("difference_pct").alias("difference_pct"))


BOARD = f"""{LATEST}, best AS (SELECT ean, min(price) AS least, {_mean("price")} AS mean, max(price) AS most, count(*) AS n, arg_min(competitor_id, struct_pack(a := price, b := competitor_id)) AS best_competitor, count(*) FILTER (WHERE price < own_price) AS cheaper FROM comparable GROUP BY ean),
board AS (SELECT p.ean, p.brand, p.category, p.own_price, b.least AS competitor_min, {_half_up("b.mean")} AS competitor_mean, b.most AS competitor_max, CAST(coalesce(b.n, 0) AS BIGINT) AS competitor_count, b.best_competitor,
  CAST(CASE WHEN b.n > 0 THEN 1 + b.cheaper END AS BIGINT) AS position, p.own_price - b.least AS difference_eur, (p.own_price - b.least) / p.own_price * 100 AS difference_pct, (p.own_price - b.least) / b.least * 100 AS difference_vs_competitor_pct
  FROM products p LEFT JOIN best b ON p.ean = b.ean)"""


def dashboard(t: Tables) -> DataFrame:
    """Every product beside its competitors' minimum, mean and maximum, the cheapest one, and its own place."""
    best = comparable(t).groupBy("ean").agg(
        F.min("price").alias("competitor_min"), half_up(mean("price")).alias("competitor_mean"), F.max("price").alias("competitor_max"), F.count("*").alias("n"),
        F.min_by("competitor_id", F.struct("price", "competitor_id")).alias("best_competitor"), F.count_if(F.col("price") < F.col("own_price")).alias("cheaper"),
    )
    gap = F.col("own_price") - F.col("competitor_min")
    return products(t).join(best, "ean", "left").select(
        "ean", "brand", "category", "own_price", "competitor_min", "competitor_mean", "competitor_max", F.coalesce("n", F.lit(0)).alias("competitor_count"), "best_competitor",
        (F.col("cheaper") + 1).alias("position"), gap.alias("difference_eur"), money.percent(gap, F.col("own_price")).alias("difference_pct"),
        money.percent(gap, F.col("competitor_min")).alias("difference_vs_competitor_pct"),
    )


@query("A17_price_dashboard", f"WITH {BOARD} SELECT * REPLACE ({_half_up("difference_eur")} AS difference_eur, {_half_up("difference_pct")} AS difference_pct, {_half_up("difference_vs_competitor_pct")} AS difference_vs_competitor_pct) FROM board")
def _board(t: Tables) -> DataFrame:
    return dashboard(t).withColumns({c: half_up(c) for c in ("difference_eur", "difference_pct", "difference_vs_competitor_pct")})


@query(
    "A4_dashboard_kpis",
    f"""WITH {BOARD} SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(competitor_min) AS BIGINT) AS compared, CAST(count(*) FILTER (WHERE difference_eur > 0) AS BIGINT) AS dearer,
  CAST(count(*) FILTER (WHERE difference_eur < 0) AS BIGINT) AS cheaper, CAST(count(*) FILTER (WHERE difference_eur IS NULL) AS BIGINT) AS without, {_half_up(_mean("difference_pct"))} AS mean_gap,
  {_half_up("count(competitor_min) * 100.0 / nullif(count(*), 0)")} AS coverage_pct, CAST(count(DISTINCT brand) AS BIGINT) AS brands FROM board""",
)
def _kpis(t: Tables) -> DataFrame:
    """A4, A5, A14, A29."""
    gap = F.col("difference_eur")
    return dashboard(t).agg(
        F.count("*").alias("total"), F.count("competitor_min").alias("compared"), F.count_if(gap > 0).alias("dearer"), F.count_if(gap < 0).alias("cheaper"), F.count_if(gap.isNull()).alias("without"),
        half_up(mean("difference_pct")).alias("mean_gap"), half_up(F.try_divide(F.count("competitor_min") * 100.0, F.count("*"))).alias("coverage_pct"), F.count_distinct("brand").alias("brands"),
    )


BINS = ("<-15", "[-15,-5)", "[-5,0)", "=0", "(0,5]", "(5,15]", ">15")


@query(
    "A15_gap_histogram",
    f"""WITH {BOARD}, b AS (SELECT CASE WHEN difference_pct < -15 THEN '<-15' WHEN difference_pct < -5 THEN '[-15,-5)' WHEN difference_pct < 0 THEN '[-5,0)' WHEN difference_pct = 0 THEN '=0' WHEN difference_pct <= 5 THEN '(0,5]' WHEN difference_pct <= 15 THEN '(5,15]' WHEN difference_pct > 15 THEN '>15' END AS bin FROM board),
bins(bin) AS (VALUES {', '.join(f"('{b}')" for b in BINS)})
SELECT bins.bin, CAST(count(b.bin) AS BIGINT) AS products, {_half_up("count(b.bin) * 100.0 / (SELECT count(*) FROM b WHERE bin IS NOT NULL)")} AS share FROM bins LEFT JOIN b ON bins.bin = b.bin GROUP BY bins.bin""",
)
def _histogram(t: Tables) -> DataFrame:
    """Fixed bins, empty ones too."""
    d = F.col("difference_pct")
    of = F.when(d < -15, "<-15").when(d < -5, "[-15,-5)").when(d < 0, "[-5,0)").when(d == 0, "=0").when(d <= 5, "(0,5]").when(d <= 15, "(5,15]").when(d > 15, ">15")
    counts = dashboard(t).select(of.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    bins = t.spark.createDataFrame([(b,) for b in BINS], "bin string")
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("products"), half_up(F.coalesce("n", F.lit(0)) * 100.0 / F.sum("n").over(Window.partitionBy())).alias("share"))


@query(
    "A16_position_counts",
    f"""WITH {BOARD} SELECT coalesce(CAST(least(position, 4) AS VARCHAR), 'none') AS place, CAST(count(*) AS BIGINT) AS products, {_half_up("count(*) * 100.0 / (SELECT count(*) FROM board)")} AS share_all,
  {_half_up("CASE WHEN min(position) IS NOT NULL THEN count(*) * 100.0 / (SELECT count(position) FROM board) END")} AS share_valid FROM board GROUP BY 1""",
)
def _positions(t: Tables) -> DataFrame:
    rows = dashboard(t).groupBy(F.coalesce(F.least("position", F.lit(4)).cast("string"), F.lit("none")).alias("place")).agg(F.count("*").alias("products"), F.count("position").alias("valid"))
    whole = Window.partitionBy()  # over five groups at most
    return rows.select(
        "place", "products", half_up(F.col("products") * 100.0 / F.sum("products").over(whole)).alias("share_all"),
        F.when(F.col("valid") > 0, half_up(F.col("products") * 100.0 / F.sum("valid").over(whole))).alias("share_valid"),
    )


@query(
    "A13_brand_ranking",
    f"""WITH {BOARD} SELECT coalesce(brand, 'Sin marca') AS brand, CAST(count(*) AS BIGINT) AS catalog, CAST(count(competitor_min) AS BIGINT) AS compared, CAST(count(*) FILTER (WHERE difference_eur < 0) AS BIGINT) AS cheaper,
  CAST(count(*) FILTER (WHERE difference_eur = 0) AS BIGINT) AS equal, CAST(count(*) FILTER (WHERE difference_eur > 0) AS BIGINT) AS higher, {_half_up("count(*) FILTER (WHERE difference_eur <= 0) * 100.0 / nullif(count(competitor_min), 0)")} AS competitive_pct,
  {_half_up(_mean("difference_pct"))} AS mean_gap FROM board GROUP BY 1 ORDER BY compared DESC, brand""",
)
def _brands(t: Tables) -> DataFrame:
    gap = F.col("difference_eur")
    out = dashboard(t).groupBy(F.coalesce("brand", F.lit("Sin marca")).alias("brand")).agg(
        F.count("*").alias("catalog"), F.count("competitor_min").alias("compared"), F.count_if(gap < 0).alias("cheaper"), F.count_if(gap == 0).alias("equal"), F.count_if(gap > 0).alias("higher"),
        half_up(F.try_divide(F.count_if(gap <= 0) * 100.0, F.count("competitor_min"))).alias("competitive_pct"), half_up(mean("difference_pct")).alias("mean_gap"),
    )
    return out.orderBy(F.desc("compared"), "brand")


@query(
    "A12_competitor_positioning",
    f"""WITH {LATEST} SELECT competitor_id, CAST(count(DISTINCT ean) AS BIGINT) AS eans, {_half_up(_mean("own_price"))} AS mean_own, {_half_up(_mean("price"))} AS mean_price, {_half_up(_mean("difference_pct"))} AS mean_gap,
  {_half_up("count(*) FILTER (WHERE price < own_price) * 100.0 / count(*)")} AS cheaper_pct, max(captured_at) AS last_update, CASE WHEN {_mean("difference_pct")} <= -5 THEN 'below' WHEN {_mean("difference_pct")} >= 5 THEN 'above' ELSE 'level' END AS signal FROM comparable GROUP BY competitor_id""",
)
def _competitors(t: Tables) -> DataFrame:
    gap = mean("difference_pct")
    return comparable(t).groupBy("competitor_id").agg(
        F.count_distinct("ean").alias("eans"), half_up(mean("own_price")).alias("mean_own"), half_up(mean("price")).alias("mean_price"), half_up(gap).alias("mean_gap"),
        half_up(F.count_if(F.col("price") < F.col("own_price")) * 100.0 / F.count("*")).alias("cheaper_pct"), F.max("captured_at").alias("last_update"),
        F.when(gap <= -5, "below").when(gap >= 5, "above").otherwise("level").alias("signal"),
    )


@query("T3_top_differences", f"WITH {BOARD} SELECT ean, {_half_up("difference_eur")} AS difference_eur FROM board WHERE difference_eur IS NOT NULL ORDER BY abs(difference_eur) DESC, ean LIMIT 25")
def _top(t: Tables) -> DataFrame:
    """A report of the 25 largest gaps."""
    return dashboard(t).where("difference_eur is not null").orderBy(F.abs("difference_eur").desc(), "ean").limit(25).select("ean", half_up("difference_eur").alias("difference_eur"))


@query(
    "W6_recent_changes",
    f"""WITH {OFFERS}, c AS (SELECT id, ean, competitor_id, captured_at, price, lag(price) OVER (PARTITION BY ean, competitor_id ORDER BY captured_at, id) AS previous FROM offers WHERE exact AND vat AND captured_at <= TIMESTAMP '{NOW}')
SELECT id, ean, competitor_id, captured_at, price, previous, {_half_up("(price - previous) / previous * 100")} AS change_pct FROM c WHERE captured_at >= TIMESTAMP '{SINCE}' AND previous <> 0 AND abs((price - previous) / previous * 100) >= 5""",
)
def _changes(t: Tables) -> DataFrame:
    rows = offers(t).where("exact and vat").where(F.col("captured_at") <= now()).select("id", "ean", "competitor_id", "captured_at", "price")
    out = series.changes(rows, ["ean", "competitor_id"], "price", "captured_at", "id")
    return out.where((F.col("captured_at") >= F.lit(SINCE).cast("timestamp_ntz")) & (F.abs("change_pct") >= 5)).withColumn("change_pct", half_up("change_pct"))


@query(
    "W7_series_with_anchor",
    f"""WITH {OFFERS}, a AS (SELECT *, max(CASE WHEN captured_at < TIMESTAMP '{SINCE}' THEN captured_at END) OVER (PARTITION BY ean, competitor_id) AS anchor FROM offers WHERE exact)
SELECT id, ean, competitor_id, captured_at, price FROM a WHERE captured_at >= TIMESTAMP '{SINCE}' OR captured_at = anchor""",
)
def _anchored(t: Tables) -> DataFrame:
    rows = offers(t).where("exact").select("id", "ean", "competitor_id", "captured_at", "price")
    return series.with_anchor(rows, ["ean", "competitor_id"], "captured_at", F.lit(SINCE).cast("timestamp_ntz"))


COMPETITIVE = f"""WITH {OFFERS}, {PRODUCTS}, days AS (SELECT CAST(range AS TIMESTAMP) AS cutoff FROM range(TIMESTAMP '2001-09-01', TIMESTAMP '2001-10-01', INTERVAL 1 DAY)),
o AS (SELECT ean, competitor_id, captured_at, id, price, available AND coalesce(vat, false) AS usable FROM offers WHERE exact),
g AS (SELECT d.cutoff, o.ean, o.price, o.usable, o.captured_at, row_number() OVER (PARTITION BY d.cutoff, o.ean, o.competitor_id ORDER BY o.captured_at DESC, o.id DESC) AS rn FROM days d JOIN o ON o.captured_at <= d.cutoff AND o.captured_at > d.cutoff - INTERVAL 60 DAY),
m AS (SELECT cutoff, ean, min(price) AS least FROM g WHERE rn = 1 AND usable GROUP BY cutoff, ean)
SELECT cutoff, {_half_up("count(*) FILTER (WHERE own_price <= least) * 100.0 / count(*)")} AS competitive_pct, CAST(count(*) AS BIGINT) AS pairs FROM m JOIN products USING (ean) GROUP BY cutoff"""


@query("J12_competitiveness_series", COMPETITIVE)
def _competitive(t: Tables) -> DataFrame:
    """For each day the last offer of a pair, if no older than 60 days; days without pairs are left out.

    An offer holds from its capture to the next one or its expiry, so it is spread over
    the days of that interval: no join of days and offers, and the work is bounded by
    the expiry, not by the history.
    """
    rows = offers(t).where("exact")
    w = Window.partitionBy("ean", "competitor_id").orderBy("captured_at", "id")
    first, last = F.lit("2001-09-01").cast("timestamp_ntz"), F.lit("2001-09-30").cast("timestamp_ntz")
    after = F.lead("captured_at").over(w)
    held = rows.withColumn("until", F.least(F.coalesce(after, F.lit("9999-12-31").cast("timestamp_ntz")), F.col("captured_at") + F.expr("INTERVAL 60 DAYS")) - F.expr("INTERVAL 1 DAYS"))
    held = held.where("available and vat").select("ean", "price", F.greatest(F.date_trunc("day", "captured_at").cast("timestamp_ntz"), first).alias("a"), F.least("until", last).alias("b")).where("a <= b")
    days = held.select("ean", "price", F.explode(F.sequence(F.col("a").cast("date"), F.col("b").cast("date"))).alias("day")).withColumn("cutoff", F.col("day").cast("timestamp_ntz"))
    least = days.groupBy("cutoff", "ean").agg(F.min("price").alias("least")).join(products(t).select("ean", "own_price"), "ean")
    return least.groupBy("cutoff").agg(half_up(F.count_if(F.col("own_price") <= F.col("least")) * 100.0 / F.count("*")).alias("competitive_pct"), F.count("*").alias("pairs"))


@query(
    "R6_change_only_history",
    f"""WITH {OFFERS}, c AS (SELECT *, CASE WHEN lag(available) OVER w IS NOT DISTINCT FROM available AND lag(exact) OVER w IS NOT DISTINCT FROM exact AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM offers WINDOW w AS (PARTITION BY ean, competitor_id ORDER BY captured_at, id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY ean, competitor_id ORDER BY captured_at, id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT ean, competitor_id, available, exact, min(captured_at) AS first_at, max(captured_at) AS last_ok_at, CAST(count(*) AS BIGINT) AS checks FROM r GROUP BY ean, competitor_id, run, available, exact""",
)
def _history(t: Tables) -> DataFrame:
    return series.change_points(offers(t), ["ean", "competitor_id"], ["available", "exact"], "captured_at", "id")


@query(
    "D7_price_states",
    f"""WITH {OFFERS} SELECT CASE WHEN age <= INTERVAL 30 DAY THEN 'current' WHEN age <= INTERVAL 60 DAY THEN 'last_known' ELSE 'expired' END AS state, CAST(count(*) AS BIGINT) AS offers FROM (SELECT TIMESTAMP '{NOW}' - captured_at AS age FROM offers) GROUP BY 1""",
)
def _states(t: Tables) -> DataFrame:
    return offers(t).groupBy(dates.price_state(F.col("captured_at"), now(), 30).alias("state")).agg(F.count("*").alias("offers"))


@query(
    "J9_retention",
    f"""WITH {OFFERS}, k AS (SELECT *, row_number() OVER (PARTITION BY ean, competitor_id ORDER BY captured_at DESC, id DESC) AS rn FROM offers)
SELECT id, ean, competitor_id, captured_at FROM k WHERE captured_at >= TIMESTAMP '{SINCE}' OR rn = 1 OR id IN (SELECT id FROM offers WHERE discount = 0.1)""",
)
def _retention(t: Tables) -> DataFrame:
    rows = offers(t)
    kept = keyed.retained(rows, ["ean", "competitor_id"], "captured_at", "id", F.lit(SINCE).cast("timestamp_ntz"), rows.where("discount = 0.1"))
    return kept.select("id", "ean", "competitor_id", "captured_at")


@query(
    "A19_pivot_states",
    f"WITH {OFFERS} SELECT competitor_id, CAST(count(*) FILTER (WHERE exact AND available) AS BIGINT) AS exact_available, CAST(count(*) FILTER (WHERE exact AND NOT available) AS BIGINT) AS exact_gone, CAST(count(*) FILTER (WHERE NOT exact) AS BIGINT) AS review FROM offers GROUP BY competitor_id",
)
def _pivot(t: Tables) -> DataFrame:
    """A19-A21."""
    state = F.when(~F.col("exact"), "review").when(F.col("available"), "exact_available").otherwise("exact_gone")
    return offers(t).withColumn("state", state).groupBy("competitor_id").pivot("state", ["exact_available", "exact_gone", "review"]).count().na.fill(0)


@query(
    "P20_summary_segments",
    f"WITH {BOARD} SELECT CASE WHEN difference_eur < 0 THEN 'cheaper' WHEN difference_eur = 0 THEN 'equal' WHEN difference_eur > 0 THEN 'higher' ELSE 'none' END AS segment, category, CAST(count(*) AS BIGINT) AS products FROM board WHERE brand IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY ALL",
)
def _segments(t: Tables) -> DataFrame:
    """P8, P20."""
    gap = F.col("difference_eur")
    segment = F.when(gap < 0, "cheaper").when(gap == 0, "equal").when(gap > 0, "higher").otherwise("none")
    return dashboard(t).where(F.col("brand").isin("Brand#1", "Brand#2", "Brand#3")).groupBy(segment.alias("segment"), "category").agg(F.count("*").alias("products"))


@query(
    "P22_products_with_offers",
    f"WITH {OFFERS}, {PRODUCTS} SELECT ean, brand FROM products p WHERE EXISTS (SELECT 1 FROM offers o WHERE o.ean = p.ean AND o.exact AND o.price < p.own_price) AND NOT EXISTS (SELECT 1 FROM offers o WHERE o.ean = p.ean AND o.vat IS NULL)",
)
def _with_offers(t: Tables) -> DataFrame:
    """Kept by aggregates of another table."""
    rows = offers(t)
    cheap = rows.where("exact").join(products(t).select("ean", "own_price"), "ean").where("price < own_price")
    return products(t).join(cheap.select("ean"), "ean", "left_semi").join(rows.where("vat is null").select("ean"), "ean", "left_anti").select("ean", "brand")
