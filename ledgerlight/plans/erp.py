"""Orders, settlements, supplier masterdata, imports and tariffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes, money, text
from ..operators import keyed
from .registry import Tables, query

# --- settlement ---------------------------------------------------------------


@query(
    "A18_settlement_totals",
    """SELECT o_orderpriority AS account, o_orderstatus AS batch, CAST(count(*) AS BIGINT) AS rows, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS net, coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) END), 0) AS payout FROM orders GROUP BY ALL""",
)
def _totals(t: Tables) -> DataFrame:
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    return t.orders.groupBy(F.col("o_orderpriority").alias("account"), F.col("o_orderstatus").alias("batch")).agg(
        F.count("*").alias("rows"), F.sum(amount).alias("net"), F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "P", amount)), F.lit(0)).alias("payout")
    )


# --- masterdata --------------------------------------------------------------

#: Ordered rules: pattern, value.
COLOURS = (("red", "ROJO"), ("blue", "AZUL"), ("green", "VERDE"), ("large", "GRANDE"), ("small", "PEQUEÑO"))
SHAPES = (("ring", "REDONDA"), ("bolt|screw", "RECTANGULAR"), ("widget|gear", "AVIADOR"))
VALID_CATEGORIES = ("ECONOMY", "STANDARD", "PROMO", "LARGE")


def clean_masterdata(raw: DataFrame) -> DataFrame:
    """Normalised columns and the reasons a row is discarded for (joined by ``;``), blank codes and repeats included.

    ``raw``: row, upc, brand, name, category. The first row of a code is kept.
    """
    name = text.normalize_text(F.col("name"))
    out = raw.select(
        "row", text.safe_text(F.col("upc")).alias("upc"), F.upper(F.replace(text.safe_text(F.col("brand")), F.lit("#"), F.lit(" "))).alias("brand"), name.alias("name"),
        text.rule_chain(name, COLOURS, F.lit("OTRO")).alias("colour"), text.rule_chain(name, SHAPES, F.lit(None).cast("string")).alias("shape"), F.upper(text.safe_text(F.col("category"))).alias("category"),
    )
    flagged = keyed.flag_duplicates(out, ["upc"], "row")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("upc") == "", "sin_upc"), F.when((F.col("upc") != "") & F.col("is_repeat"), "upc_repetido"), F.when(~F.col("category").isin(*VALID_CATEGORIES), "categoria"), F.when(F.col("shape").isNull(), "forma")
        )
    )
    return flagged.withColumn("reasons", F.array_join(reasons, ";")).drop("is_repeat", "is_shared")


def _raw(t: Tables) -> DataFrame:
    upc = F.when(F.col("p_partkey") % 97 == 0, " ").otherwise(F.lpad((F.col("p_partkey") % 1900).cast("string"), 12, "0"))
    return t.part.select(F.col("p_partkey").alias("row"), upc.alias("upc"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_type").alias("category"))


MASTER = """WITH raw AS (SELECT p_partkey AS row, CASE WHEN p_partkey % 97 = 0 THEN '' ELSE lpad(CAST(p_partkey % 1900 AS VARCHAR), 12, '0') END AS upc, upper(replace(trim(p_brand), '#', ' ')) AS brand, lower(p_name) AS name, upper(p_type) AS category FROM part),
c AS (SELECT *, CASE WHEN name LIKE '%red%' THEN 'ROJO' WHEN name LIKE '%blue%' THEN 'AZUL' WHEN name LIKE '%green%' THEN 'VERDE' WHEN name LIKE '%large%' THEN 'GRANDE' WHEN name LIKE '%small%' THEN 'PEQUEÑO' ELSE 'OTRO' END AS colour,
  CASE WHEN name LIKE '%ring%' THEN 'REDONDA' WHEN regexp_matches(name, 'bolt|screw') THEN 'RECTANGULAR' WHEN regexp_matches(name, 'widget|gear') THEN 'AVIADOR' END AS shape,
  row_number() OVER (PARTITION BY upc ORDER BY row) > 1 AS rep FROM raw),
clean AS (SELECT row, upc, brand, name, colour, shape, category, concat_ws(';', CASE WHEN upc = '' THEN 'sin_upc' END, CASE WHEN upc <> '' AND rep THEN 'upc_repetido' END, CASE WHEN category NOT IN ('ECONOMY', 'STANDARD', 'PROMO', 'LARGE') THEN 'categoria' END, CASE WHEN shape IS NULL THEN 'forma' END) AS reasons FROM c)"""


@query("C6_masterdata_clean", f"{MASTER} SELECT * FROM clean")
def _clean(t: Tables) -> DataFrame:
    """C6, F1, F2, F9-F11, P21, W9."""
    return clean_masterdata(_raw(t))


@query(
    "A24_brand_audit",
    f"{MASTER} SELECT brand, CAST(count(*) AS BIGINT) AS rows, count(*) FILTER (WHERE reasons = '') > 0 AS known, CAST(count(*) FILTER (WHERE upc LIKE '0%') AS BIGINT) AS leading_zero, string_agg(DISTINCT shape, ',' ORDER BY shape) AS shapes FROM clean GROUP BY brand HAVING count(*) > 10 ORDER BY known, rows DESC, brand",
)
def _audit(t: Tables) -> DataFrame:
    """A7, A8, A23, A24."""
    shapes = F.array_join(F.array_sort(F.collect_set("shape")), ",")
    out = clean_masterdata(_raw(t)).groupBy("brand").agg(
        F.count("*").alias("rows"), (F.count_if(F.col("reasons") == "") > 0).alias("known"), F.count_if(F.col("upc").startswith("0")).alias("leading_zero"), shapes.alias("shapes")
    )
    return out.where("rows > 10").orderBy("known", F.desc("rows"), "brand")


@query(
    "U4_discarded_codes",
    f"{MASTER} SELECT DISTINCT upc FROM clean WHERE upc NOT IN (SELECT upc FROM clean WHERE reasons = '')",
)
def _discarded(t: Tables) -> DataFrame:
    rows = clean_masterdata(_raw(t))
    return rows.select("upc").subtract(rows.where("reasons = ''").select("upc"))


@query(
    "F20_dictionary_rules",
    """WITH rules(col, value, target) AS (VALUES ('category', 'economy', 'ECO'), ('category', 'promo', 'PRO'), ('category', 'luxury', 'LUX'))
SELECT r.col, r.value, r.target, CAST(count(p.p_partkey) AS BIGINT) AS hits, count(p.p_partkey) = 0 AS unresolved FROM rules r LEFT JOIN part p ON lower(trim(p.p_type)) = r.value GROUP BY ALL""",
)
def _dictionary(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([("category", "economy", "ECO"), ("category", "promo", "PRO"), ("category", "luxury", "LUX")], "col string, value string, target string")
    parts = t.part.select(text.normalize_text(F.col("p_type")).alias("value"), "p_partkey")
    return rules.join(parts, "value", "left").groupBy("col", "value", "target").agg(F.count("p_partkey").alias("hits")).withColumn("unresolved", F.col("hits") == 0)


@query(
    "C7_import_dry_run",
    """WITH f AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 13, '0') AS upc, lower(p_brand) AS brand FROM part), erp AS (SELECT lpad(CAST(l_partkey * 2 AS VARCHAR), 13, '0') AS barcode, l_orderkey AS id FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 5 = 0),
n AS (SELECT barcode, count(*) AS matches, min(id) AS product FROM erp GROUP BY barcode), b AS (SELECT DISTINCT lower(p_brand) AS brand FROM part WHERE p_size > 49)
SELECT f.upc, f.brand, CAST(coalesce(n.matches, 0) AS BIGINT) AS matches, CASE WHEN n.matches IS NULL THEN 'create' WHEN n.matches = 1 THEN 'update' ELSE 'conflict' END AS action, CASE WHEN n.matches = 1 THEN n.product END AS product, b.brand IS NOT NULL AS brand_found FROM f LEFT JOIN n ON f.upc = n.barcode LEFT JOIN b ON f.brand = b.brand""",
)
def _dry_run(t: Tables) -> DataFrame:
    rows = t.part.select(F.lpad(F.col("p_partkey").cast("string"), 13, "0").alias("upc"), text.normalize_text(F.col("p_brand")).alias("brand"))
    erp = t.lineitem.where("l_linenumber = 1 and l_orderkey % 5 = 0").select(F.lpad((F.col("l_partkey") * 2).cast("string"), 13, "0").alias("barcode"), F.col("l_orderkey").alias("id"))
    return dry_run(rows, erp, t.part.where("p_size > 49").select(text.normalize_text(F.col("p_brand")).alias("brand")))


def dry_run(rows: DataFrame, erp: DataFrame, brands: DataFrame) -> DataFrame:
    """No match creates, one updates, more are a conflict."""
    matches = erp.groupBy("barcode").agg(F.count("*").alias("matches"), F.min("id").alias("product"))
    known = brands.distinct().withColumn("brand_found", F.lit(True))
    action = F.when(F.col("matches").isNull(), "create").when(F.col("matches") == 1, "update").otherwise("conflict")
    out = rows.join(matches, F.col("upc") == F.col("barcode"), "left").join(known, "brand", "left")
    return out.select("upc", "brand", F.coalesce("matches", F.lit(0)).alias("matches"), action.alias("action"), F.when(F.col("matches") == 1, F.col("product")).alias("product"), F.coalesce("brand_found", F.lit(False)).alias("brand_found"))


# --- tariffs -----------------------------------------------------------------


@query(
    "C10_tariff_validation",
    """WITH r AS (SELECT l_partkey, l_suppkey, CAST(l_discount * 100 AS DECIMAL(18,4)) AS disc FROM lineitem WHERE l_quantity > 45), n AS (SELECT l_partkey, count(DISTINCT disc) AS maps, min(disc) AS disc FROM r GROUP BY l_partkey),
p AS (SELECT p_partkey AS product, CAST(p_retailprice AS DECIMAL(18,4)) AS list, CAST(floor(p_retailprice * (1 - (p_partkey % 11) / 100.0) * 100 + 0.5) / 100 AS DECIMAL(18,4)) AS tariff, p_size, maps, disc, CASE WHEN maps = 1 THEN CAST(CAST(p_retailprice AS DECIMAL(18,4)) * (CAST(100 AS DECIMAL(18,4)) - disc) AS DECIMAL(28,8)) END AS raw FROM part LEFT JOIN n ON p_partkey = l_partkey),
e AS (SELECT *, CAST(CAST(floor(raw + 0.5) AS DECIMAL(18,4)) / 100 AS DECIMAL(18,4)) AS expected FROM p)
SELECT product, list, tariff, expected, CASE WHEN p_size = 50 THEN 'discontinued' WHEN maps IS NULL THEN 'no_map' WHEN maps > 1 THEN 'multiple_maps' WHEN abs(tariff - expected) > 0.01 THEN 'mismatch' ELSE 'validated' END AS status FROM e""",
)
def _tariffs(t: Tables) -> DataFrame:
    """Expected price in exact decimals, and the status of the first test that speaks."""
    rules = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("product"), (F.col("l_discount") * 100).cast("decimal(18,4)").alias("disc"))
    maps = rules.groupBy("product").agg(F.count_distinct("disc").alias("maps"), keyed.unique_or_null("disc").alias("disc"))
    price = F.col("p_retailprice")
    tariff = (F.floor(price * (1 - (F.col("p_partkey") % 11) / 100.0) * 100 + 0.5) / 100).cast("decimal(18,4)")
    parts = t.part.select(F.col("p_partkey").alias("product"), price.cast("decimal(18,4)").alias("list"), tariff.alias("tariff"), "p_size").join(maps, "product", "left")
    expected = money.half_up(F.col("list") * (F.lit(100).cast("decimal(18,4)") - F.col("disc")) / 100)
    status = (
        F.when(F.col("p_size") == 50, "discontinued").when(F.col("maps").isNull(), "no_map").when(F.col("maps") > 1, "multiple_maps").when(F.abs(F.col("tariff") - F.col("expected")) > 0.01, "mismatch").otherwise("validated")
    )
    return parts.withColumn("expected", expected).select("product", "list", "tariff", "expected", status.alias("status"))


# --- orders ------------------------------------------------------------------


@query(
    "C14_watched_orders",
    """SELECT o_orderkey AS order_id, o_orderdate AS ordered_at, c_name AS customer FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = ANY(['BUILDING', 'MACHINERY']) AND o_orderdate >= TIMESTAMP '2001-02-01' AND o_orderdate < TIMESTAMP '2001-08-01'
  AND (EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') OR o_orderstatus = 'P')""",
)
def _watched(t: Tables) -> DataFrame:
    """EXISTS inside an OR as a flag from a distinct key set."""
    undelivered = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("open_line", F.lit(True))
    rows = t.orders.where((F.col("o_orderdate") >= F.lit("2001-02-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("2001-08-01").cast("timestamp_ntz")))
    people = t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    out = rows.join(people, F.col("o_custkey") == F.col("c_custkey")).join(undelivered, "o_orderkey", "left")
    return out.where(F.col("open_line") | (F.col("o_orderstatus") == "P")).select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("ordered_at"), F.col("c_name").alias("customer"))


def purchase_page(orders: DataFrame, lines: DataFrame, before: tuple[str, int] | None, take: int) -> DataFrame:
    """The page of ``take`` orders after a (date, id) key, newest first, with their lines numbered; one order more tells whether more follow."""
    rows = orders
    if before:
        at, key = F.lit(before[0]).cast("timestamp_ntz"), F.lit(before[1])
        rows = rows.where((F.col("o_orderdate") < at) | ((F.col("o_orderdate") == at) & (F.col("o_orderkey") < key)))
    page = rows.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(take + 1)
    w = Window.partitionBy("l_orderkey")
    numbered = lines.withColumn("line_no", F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey"))).withColumn("lines", F.count("*").over(w))
    return page.join(numbered, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderdate", "line_no", "lines", "l_partkey")


@query(
    "T5_purchase_page",
    """WITH p AS (SELECT * FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '2001-01-01', 5000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51)
SELECT o_orderkey, o_orderdate, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS line_no, CAST(count(*) OVER (PARTITION BY l_orderkey) AS BIGINT) AS lines, l_partkey FROM p JOIN lineitem ON o_orderkey = l_orderkey""",
)
def _page(t: Tables) -> DataFrame:
    """A page is the feature, so its size stays."""
    return purchase_page(t.orders, t.lineitem, ("2001-01-01 00:00:00", 5000), 50)


@query(
    "J7_conflicting_orders",
    "SELECT o_orderkey AS order_id, o_custkey AS customer, o_orderdate AS ordered_at, CAST(n AS BIGINT) AS twins FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderpriority, date_trunc('month', o_orderdate)) AS n FROM orders) WHERE n > 1",
)
def _conflicts(t: Tables) -> DataFrame:
    """A count over the shared key, in place of a self-join."""
    w = Window.partitionBy("o_custkey", "o_orderpriority", F.date_trunc("month", "o_orderdate"))
    return t.orders.withColumn("twins", F.count("*").over(w)).where("twins > 1").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer"), F.col("o_orderdate").alias("ordered_at"), "twins")


@query(
    "J8_or_join",
    "SELECT DISTINCT o_orderkey AS order_id, n_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey OR (o_orderstatus = 'P' AND n_nationkey = o_orderkey % 25)",
)
def _or_join(t: Tables) -> DataFrame:
    """Two equi-joins and a distinct union."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    own = rows.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "n_nationkey")
    other = rows.where("o_orderstatus = 'P'").join(t.nation, F.col("o_orderkey") % 25 == F.col("n_nationkey")).select("o_orderkey", "n_nationkey")
    return own.union(other).distinct().select(F.col("o_orderkey").alias("order_id"), F.col("n_nationkey").alias("nation"))


@query(
    "X13_import_preview",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, lpad(CAST(l_partkey % 500 AS VARCHAR), 14, '0') AS code, o_orderdate, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber, l_partkey) AS rn FROM l)
SELECT l_orderkey, l_linenumber, code, CASE WHEN rn > 1 THEN 'Duplicado' WHEN l_quantity > 45 THEN 'Requiere revisión' WHEN l_quantity < 5 THEN 'Ya completa' ELSE 'Elegible' END AS state FROM n""",
)
def _preview(t: Tables) -> DataFrame:
    """The newest line of a code counts, whatever its leading zeros."""
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    code = text.zero_padded((F.col("l_partkey") % 500).cast("string"))
    rn = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("o_orderdate"), F.desc("l_orderkey"), "l_linenumber", "l_partkey"))
    state = F.when(F.col("rn") > 1, "Duplicado").when(F.col("l_quantity") > 45, "Requiere revisión").when(F.col("l_quantity") < 5, "Ya completa").otherwise("Elegible")
    return lines.withColumn("code", code).withColumn("rn", rn).select("l_orderkey", "l_linenumber", "code", state.alias("state"))


@query(
    "X18_line_signatures",
    "SELECT l_orderkey AS order_id, CAST(count(*) AS BIGINT) AS lines, sha256(string_agg(CAST(l_partkey AS VARCHAR) || 'x' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), ',' ORDER BY l_partkey, l_linenumber, l_quantity)) AS signature FROM lineitem GROUP BY l_orderkey",
)
def _signatures(t: Tables) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))))
    spelled = F.array_join(F.transform(listed, lambda x: F.concat_ws("x", x["l_partkey"].cast("string"), x["q"].cast("string"))), ",")
    return t.lineitem.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.count("*").alias("lines"), F.sha2(spelled, 256).alias("signature"))


@query(
    "X14_unique_suppliers",
    """SELECT l_partkey AS product, CASE WHEN count(DISTINCT l_suppkey) FILTER (WHERE l_quantity > 40) = 1 THEN 'confirmed' WHEN count(DISTINCT l_suppkey) FILTER (WHERE l_quantity > 40) = 0 THEN 'pending' ELSE 'review' END AS state,
  CASE WHEN count(DISTINCT l_suppkey) FILTER (WHERE l_quantity > 40) = 1 THEN min(l_suppkey) FILTER (WHERE l_quantity > 40) END AS supplier FROM lineitem GROUP BY l_partkey""",
)
def _unique(t: Tables) -> DataFrame:
    """A9, X14-X16."""
    big = F.when(F.col("l_quantity") > 40, F.col("l_suppkey"))
    n = F.count_distinct("big")
    state = F.when(n == 1, "confirmed").when(n == 0, "pending").otherwise("review")
    return t.lineitem.withColumn("big", big).groupBy(F.col("l_partkey").alias("product")).agg(state.alias("state"), keyed.unique_or_null("big").alias("supplier"))


@query(
    "F_GTIN_codes",
    """WITH c AS (SELECT p_partkey, lpad(CAST(p_partkey * 7919 + 36000291452 AS VARCHAR), CASE WHEN p_partkey % 2 = 0 THEN 12 ELSE 13 END, '0') AS code FROM part),
s AS (SELECT *, (SELECT sum(CAST(substr(reverse(code), i + 1, 1) AS INTEGER) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END) FROM range(length(code)) r(i)) AS total FROM c)
SELECT p_partkey, code, CASE WHEN total % 10 = 0 THEN lpad(code, 13, '0') END AS gtin FROM s""",
)
def _gtin(t: Tables) -> DataFrame:
    width = F.when(F.col("p_partkey") % 2 == 0, 12).otherwise(13)
    code = F.lpad((F.col("p_partkey") * 7919 + 36000291452).cast("string"), width, F.lit("0"))
    return t.part.select("p_partkey", code.alias("code")).withColumn("gtin", codes.normalize_gtin(F.col("code")))
