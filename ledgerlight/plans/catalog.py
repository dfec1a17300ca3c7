"""The image catalogue: groups, coverage, selection, publication plans. A line is an image, a part its product."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import keyed
from ..operators.ranks import numbered
from ..operators.exports import export_names
from .registry import Tables, query

VIEWS = ("frontal", "lateral", "perspectiva")
IMAGES = """images AS (SELECT l_orderkey * 10 + l_linenumber AS id, lpad(CAST(l_partkey AS VARCHAR), 13, '0') AS ean, CASE l_linenumber % 4 WHEN 0 THEN 'frontal' WHEN 1 THEN 'lateral' WHEN 2 THEN 'perspectiva' ELSE 'detalle' END AS view,
  'x' || CAST(CAST(floor(l_extendedprice) AS BIGINT) % 5000 AS VARCHAR) AS pixels, 'p' || CAST(l_suppkey % 5 AS VARCHAR) AS provider, l_shipdate AS date, l_returnflag = 'A' AS verified FROM lineitem)"""


def images(t: Tables) -> DataFrame:
    n = F.col("l_linenumber") % 4
    view = F.when(n == 0, "frontal").when(n == 1, "lateral").when(n == 2, "perspectiva").otherwise("detalle")
    return t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lpad(F.col("l_partkey").cast("string"), 13, "0").alias("ean"), view.alias("view"),
        F.concat(F.lit("x"), (F.col("l_extendedprice").cast("bigint") % 5000).cast("string")).alias("pixels"), F.concat(F.lit("p"), (F.col("l_suppkey") % 5).cast("string")).alias("provider"),
        F.col("l_shipdate").alias("date"), (F.col("l_returnflag") == "A").alias("verified"),
    )


@query(
    "A25_catalog_groups",
    f"""WITH {IMAGES} SELECT ean, CAST(count(*) AS BIGINT) AS images, arg_min(id, struct_pack(a := CASE view WHEN 'frontal' THEN 0 WHEN 'perspectiva' THEN 1 WHEN 'lateral' THEN 2 ELSE 3 END, b := id)) AS cover, max(date) AS latest FROM images GROUP BY ean""",
)
def _groups(t: Tables) -> DataFrame:
    """The cover is the first by view order."""
    order = F.when(F.col("view") == "frontal", 0).when(F.col("view") == "perspectiva", 1).when(F.col("view") == "lateral", 2).otherwise(3)
    return images(t).groupBy("ean").agg(F.count("*").alias("images"), F.min_by("id", F.struct(order, "id")).alias("cover"), F.max("date").alias("latest"))


@query(
    "A26_metadata_coverage",
    f"WITH {IMAGES} SELECT provider, CAST(count(*) AS BIGINT) AS images, CAST(count(DISTINCT ean) AS BIGINT) AS eans, CAST(count(*) FILTER (WHERE verified) AS BIGINT) AS verified FROM images GROUP BY provider",
)
def _coverage(t: Tables) -> DataFrame:
    return images(t).groupBy("provider").agg(F.count("*").alias("images"), F.count_distinct("ean").alias("eans"), F.count_if("verified").alias("verified"))


@query(
    "A27_view_coverage",
    f"""WITH {IMAGES}, v AS (SELECT ean, list_distinct(list(view) FILTER (WHERE view <> 'detalle')) AS views FROM images WHERE verified GROUP BY ean)
SELECT lpad(CAST(p_partkey AS VARCHAR), 13, '0') AS ean, CASE WHEN views IS NULL THEN CASE WHEN n IS NULL THEN 'sin_registros' ELSE 'sin_vistas_validas' END WHEN len(views) = 3 THEN 'completas' ELSE 'parciales' END AS state, array_to_string(list_filter(['frontal', 'lateral', 'perspectiva'], lambda x: NOT list_contains(coalesce(views, []), x)), ',') AS missing
FROM part LEFT JOIN v ON v.ean = lpad(CAST(p_partkey AS VARCHAR), 13, '0') LEFT JOIN (SELECT ean, count(*) AS n FROM images GROUP BY ean) c ON c.ean = lpad(CAST(p_partkey AS VARCHAR), 13, '0')""",
)
def _views(t: Tables) -> DataFrame:
    """Required views that are missing."""
    required = F.array(*[F.lit(v) for v in VIEWS])
    seen = images(t).groupBy("ean").agg(F.collect_set(F.when(F.col("verified") & F.col("view").isin(*VIEWS), F.col("view"))).alias("views"))
    rows = t.part.select(F.lpad(F.col("p_partkey").cast("string"), 13, "0").alias("ean")).join(seen, "ean", "left")
    state = F.when(F.col("views").isNull(), "sin_registros").when(F.size("views") == 0, "sin_vistas_validas").when(F.size("views") == 3, "completas").otherwise("parciales")
    return rows.select("ean", state.alias("state"), F.array_join(F.array_except(required, F.coalesce("views", F.array().cast("array<string>"))), ",").alias("missing"))


@query(
    "X24_same_pixels",
    f"WITH {IMAGES} SELECT pixels, CAST(count(*) AS BIGINT) AS images, CAST(count(DISTINCT ean) AS BIGINT) AS eans, count(DISTINCT view) > 1 AS conflict FROM images GROUP BY pixels HAVING count(*) > 1",
)
def _pixels(t: Tables) -> DataFrame:
    """X24, X17."""
    return images(t).groupBy("pixels").agg(F.count("*").alias("images"), F.count_distinct("ean").alias("eans"), (F.count_distinct("view") > 1).alias("conflict")).where("images > 1")


@query(
    "X20_accredited_views",
    f"""WITH {IMAGES}, a AS (SELECT *, row_number() OVER (PARTITION BY ean, view ORDER BY date, id) AS by_view FROM images WHERE verified AND view <> 'detalle'), b AS (SELECT *, row_number() OVER (PARTITION BY ean, pixels ORDER BY date, id) AS by_pixels FROM a WHERE by_view = 1)
SELECT ean, id, view, CASE WHEN by_pixels > 1 THEN 'same_pixels' ELSE 'selected' END AS state FROM b""",
)
def _accredited(t: Tables) -> DataFrame:
    """One image a view, none with the pixels of another."""
    rows = keyed.distinct_on(images(t).where(F.col("verified") & F.col("view").isin(*VIEWS)), ["ean", "view"], "date", "id")
    place = F.row_number().over(Window.partitionBy("ean", "pixels").orderBy("date", "id"))
    return rows.select("ean", "id", "view", F.when(place > 1, "same_pixels").otherwise("selected").alias("state"))


@query(
    "X21_plan_diff",
    f"""WITH {IMAGES}, plan AS (SELECT ean || '/' || view AS path, min(pixels) AS pixels FROM images WHERE provider = 'p1' GROUP BY 1), there AS (SELECT ean || '/' || view AS path, min(pixels) AS pixels FROM images WHERE provider IN ('p2', 'p1') GROUP BY 1)
SELECT p.path, CASE WHEN t.path IS NULL THEN 'create' WHEN t.pixels = p.pixels THEN 'unchanged' ELSE 'collision' END AS action FROM plan p LEFT JOIN there t ON p.path = t.path""",
)
def _plan(t: Tables) -> DataFrame:
    rows = images(t).withColumn("path", F.concat_ws("/", "ean", "view"))
    plan = rows.where("provider = 'p1'").groupBy("path").agg(F.min("pixels").alias("pixels"))
    there = rows.where("provider in ('p1', 'p2')").groupBy("path").agg(F.min("pixels").alias("held"))
    action = F.when(F.col("held").isNull(), "create").when(F.col("held") == F.col("pixels"), "unchanged").otherwise("collision")
    return plan.join(there, "path", "left").select("path", action.alias("action"))


#: Of an export: bytes of one file and of all files of an order.
FILE_BYTES, ORDER_BYTES = 900, 200_000


@query(
    "X22_export_names",
    f"""WITH {IMAGES}, d AS (SELECT view, pixels, min(id) AS id FROM images GROUP BY view, pixels), n AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY id) AS k, sum(CASE WHEN id % 1000 <= {FILE_BYTES} THEN id % 1000 ELSE 0 END) OVER (PARTITION BY view ORDER BY id ROWS UNBOUNDED PRECEDING) AS running FROM d),
s AS (SELECT id, view, view || CASE WHEN k > 1 THEN '_' || CAST(k AS VARCHAR) ELSE '' END AS name, CAST(running AS BIGINT) AS running, CASE WHEN id % 1000 > {FILE_BYTES} THEN 'file_too_large' WHEN running > {ORDER_BYTES} THEN 'over_limit' ELSE 'exported' END AS state FROM n)
SELECT id, name, running, state, bool_or(state <> 'exported') OVER (PARTITION BY view) AS partial FROM s""",
)
def _names(t: Tables) -> DataFrame:
    """Equal files once, a suffix on a shared name, sizes within a file's and an order's limit, and whether an order is partial."""
    once = images(t).groupBy("view", "pixels").agg(F.min("id").alias("id"))
    size = F.col("id") % 1000
    rows = numbered(once, ["view"], "id", weight=F.when(size <= FILE_BYTES, size).otherwise(0))
    name = F.concat(F.col("view"), F.when(F.col("place") > 1, F.concat(F.lit("_"), F.col("place").cast("string"))).otherwise(F.lit("")))
    state = F.when(size > FILE_BYTES, "file_too_large").when(F.col("running") > ORDER_BYTES, "over_limit").otherwise("exported")
    named = rows.select("id", "view", name.alias("name"), "running", state.alias("state"))
    partial = named.groupBy("view").agg(F.bool_or(F.col("state") != "exported").alias("partial"))
    return named.join(partial, "view").drop("view")


@query(
    "X15_inverse_mapping",
    "SELECT p_name || '|' || p_type || '|' || CAST(p_size AS VARCHAR) AS image_key, CASE WHEN count(DISTINCT p_partkey) = 1 THEN min(p_partkey) END AS product, CAST(count(*) AS BIGINT) AS candidates FROM part GROUP BY ALL",
)
def _inverse(t: Tables) -> DataFrame:
    key = F.concat_ws("|", "p_name", "p_type", F.col("p_size").cast("string"))
    return t.part.groupBy(key.alias("image_key")).agg(keyed.unique_or_null("p_partkey").alias("product"), F.count("*").alias("candidates"))


EXPORT = """WITH RECURSIVE f AS (SELECT l_partkey % 97 AS order_id, lpad(CAST(l_partkey AS VARCHAR), 13, '0') AS ean, CASE l_linenumber % 3 WHEN 0 THEN 'a.jpg' WHEN 1 THEN 'a__c1.jpg' ELSE 'b' END AS name, 'c' || CAST(l_suppkey % 3 AS VARCHAR) AS checksum, l_orderkey * 10 + l_linenumber AS place FROM lineitem),
o AS (SELECT order_id, ean, name, checksum, min(place) AS place FROM f GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY ean ORDER BY place) AS k FROM o),
w AS (SELECT ean, 0 AS k, CAST(MAP {} AS MAP(VARCHAR, VARCHAR)) AS given, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS checksum, CAST(NULL AS VARCHAR) AS path FROM (SELECT DISTINCT ean FROM n)
UNION ALL SELECT ean, k, map_concat(given, MAP {path: checksum}), name, checksum, path FROM (SELECT n.ean, n.k, w.given, n.name, n.checksum, list_filter([n.name, replace(n.name, '.jpg', '') || '__' || n.checksum || CASE WHEN n.name LIKE '%.jpg' THEN '.jpg' ELSE '' END, replace(n.name, '.jpg', '') || '__' || n.checksum || '-1' || CASE WHEN n.name LIKE '%.jpg' THEN '.jpg' ELSE '' END],
  lambda p: coalesce(w.given[p], n.checksum) = n.checksum)[1] AS path FROM w JOIN n ON n.ean = w.ean AND n.k = w.k + 1))
SELECT ean, name, checksum, ean || '/' || path AS path FROM w WHERE k > 0"""


@query("X22_collision_free", EXPORT)
def _collisions(t: Tables) -> DataFrame:
    """Names that several images of a product have, and one that another's name with its checksum runs into."""
    n = F.col("l_linenumber") % 3
    name = F.when(n == 0, "a.jpg").when(n == 1, "a__c1.jpg").otherwise("b")
    checksum = F.concat(F.lit("c"), (F.col("l_suppkey") % 3).cast("string"))
    files = t.lineitem.select(
        (F.col("l_partkey") % 97).alias("order_id"), F.lpad(F.col("l_partkey").cast("string"), 13, "0").alias("ean"), name.alias("name"), checksum.alias("checksum"), F.lit(1).cast("long").alias("size"), F.lit("frontal").alias("view"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place")
    )
    return export_names(files, most_files=1 << 40, most_bytes=1 << 60).select("ean", "name", "checksum", "path")


@query(
    "T4_catalog_page",
    f"WITH {IMAGES} SELECT ean, count(*) AS images FROM images GROUP BY ean ORDER BY images DESC, ean LIMIT 25 OFFSET 50",
)
def _page(t: Tables) -> DataFrame:
    """T4, A3: the third page of a sorted listing, so its size stays."""
    return images(t).groupBy("ean").agg(F.count("*").alias("images")).orderBy(F.desc("images"), "ean").offset(50).limit(25)


@query(
    "U1_union_codes",
    f"WITH {IMAGES} SELECT ean FROM images WHERE provider = 'p1' AND verified UNION SELECT lpad(CAST(p_partkey AS VARCHAR), 13, '0') FROM part WHERE p_size > 45",
)
def _union(t: Tables) -> DataFrame:
    """U1-U3, U5."""
    return images(t).where("provider = 'p1' and verified").select("ean").union(t.part.where("p_size > 45").select(F.lpad(F.col("p_partkey").cast("string"), 13, "0"))).distinct()


@query(
    "W2_newest_images",
    f"WITH {IMAGES} SELECT ean, id, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY ean ORDER BY date DESC, id DESC) AS rn FROM images) WHERE rn <= 3",
)
def _newest(t: Tables) -> DataFrame:
    return keyed.top_per_group(images(t), ["ean"], 3, F.desc("date"), F.desc("id")).select("ean", "id", "rn")


@query(
    "F8_view_names",
    "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'V1' WHEN 1 THEN 'V3' END AS view FROM part",
)
def _file_views(t: Tables) -> DataFrame:
    """File names made and read back."""
    tail = F.when(F.col("p_size") % 3 == 0, "__V1").when(F.col("p_size") % 3 == 1, "__v3__front").otherwise("__detail")
    name = F.concat(text.slug(F.col("p_name")), tail, F.lit(".jpg"))
    return t.part.select("p_partkey", text.view_of_file(name).alias("view"))


@query(
    "X26_natural_order",
    "SELECT p_brand, CAST(row_number() OVER (ORDER BY CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER)) AS INTEGER) AS place FROM (SELECT DISTINCT p_brand FROM part)",
)
def _natural(t: Tables) -> DataFrame:
    brands = t.part.select("p_brand").distinct()
    # a list of brands: few rows
    return brands.select("p_brand", F.row_number().over(Window.orderBy(text.natural_key(F.col("p_brand")))).alias("place"))
