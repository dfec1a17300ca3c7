"""Product facts of web pages, tables as text, identity: queries over pages, parts and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, identity, money
from ..operators.grid import dealt
from ..operators.references import references, search_plan
from .registry import Tables, query


def meta_content(html, name: str):
    """The content of a meta element by name or property."""
    return F.nullif(F.regexp_extract(html, rf'<meta\s+(?:name|property)="{name}"\s+content="([^"]*)"', 1), F.lit(""))


def json_ld(html):
    """The first JSON-LD block of a page."""
    return F.nullif(F.regexp_extract(html, r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>', 1), F.lit(""))


def heading(html):
    """The text of the first h1, or NULL."""
    return F.nullif(F.trim(F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1)), F.lit(""))


def _elements(json):
    """The elements of a JSON array as texts; one text as the only one."""
    return F.when(json.startswith("["), F.from_json(json, "array<string>")).otherwise(F.array(json))


def product_nodes(pages: DataFrame) -> DataFrame:
    """``page_id, variant, name, price, currency, ean, vat, availability, conflict``, a row for each product of a page (at least one).

    Nodes stand alone, in a list or in ``@graph``; variants have what they lack from
    their group, and the first offer counts. Without nodes the meta elements speak.
    VAT is told by the ratio to a price before tax (M7); stock phrases that contradict
    each other are a conflict (X31).
    """
    ld = json_ld(F.col("html"))
    nodes = F.filter(_elements(F.coalesce(F.get_json_object(ld, "$.@graph"), ld)), lambda n: F.get_json_object(n, "$.@type").rlike('(^|")Product(Group)?("|$)'))
    rows = pages.select("page_id", "html", F.explode_outer(nodes).alias("parent"))
    variants = F.get_json_object("parent", "$.hasVariant")
    rows = rows.select("page_id", "html", "parent", F.posexplode_outer(_elements(F.coalesce(variants, F.col("parent")))).alias("variant", "node"))
    rows = rows.withColumn("variant", F.coalesce("variant", F.lit(0)))
    offer = F.coalesce(F.get_json_object("node", "$.offers.offers[0]"), F.get_json_object("node", "$.offers[0]"), F.get_json_object("node", "$.offers"))
    own = lambda path: F.coalesce(F.get_json_object("node", path), F.get_json_object("parent", path))
    html = F.col("html")
    alone = F.col("parent").isNull()  # meta elements speak for pages without nodes
    price = F.coalesce(money.parse_price(F.get_json_object(offer, "$.price")), F.when(alone, money.parse_price(meta_content(html, "product:price:amount"))))
    pretax = F.when(alone, money.parse_price(meta_content(html, "product:pretax_price:amount")))
    phrases = F.concat(html, F.coalesce(F.get_json_object(offer, "$.availability"), F.lit("")))
    yes, no = phrases.rlike(r"(?i)en stock|in stock|InStock"), phrases.rlike(r"(?i)agotado|sold out|OutOfStock")
    stock = F.when(yes & no, "unknown").when(yes, "available").when(no, "unavailable").otherwise("unknown")
    return rows.select(
        "page_id", "variant", F.coalesce(own("$.name"), F.when(alone, heading(html))).alias("name"), price.alias("price"),
        F.coalesce(F.get_json_object(offer, "$.priceCurrency"), F.when(alone, meta_content(html, "product:price:currency"))).alias("currency"),
        codes.normalize_gtin(F.coalesce(F.get_json_object("node", "$.gtin13"), F.get_json_object("node", "$.gtin"))).alias("ean"), money.infer_vat(price, pretax).alias("vat"), stock.alias("availability"), (yes & no).alias("conflict"),
    )


@query("S11_page_facts", "SELECT page_id, nullif(trim(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)), '') AS name, CAST(len(regexp_extract_all(html, '<a href=')) AS INTEGER) AS links FROM pages")
def _facts(t: Tables) -> DataFrame:
    links = F.size(F.regexp_extract_all("html", F.lit("<a href="), 0))
    return t.pages.select("page_id", heading(F.col("html")).alias("name"), links.alias("links"))


@query(
    "M1_parsed_prices",
    "SELECT p_partkey, p_retailprice AS eu, p_retailprice + 1000 AS us, CAST(NULL AS DOUBLE) AS none FROM part",
)
def _prices(t: Tables) -> DataFrame:
    """M1: prices spelt in both ways read back to the number."""
    eu = F.concat(F.replace(F.format_number("p_retailprice", 2), F.lit("."), F.lit(",")), F.lit(" €"))
    us = F.format_number(F.col("p_retailprice") + 1000, 2)
    return t.part.select("p_partkey", money.parse_price(eu).alias("eu"), money.parse_price(us).alias("us"), money.parse_price(F.lit("sin precio")).alias("none"))


@query(
    "F12_calibers",
    "SELECT p_partkey, CAST(38 + p_size % 40 AS VARCHAR) || '-' || CAST(10 + p_size % 20 AS VARCHAR) AS caliber, (38 + p_size % 40) <= 66 AND (10 + p_size % 20) <= 26 AS plausible FROM part",
)
def _calibers(t: Tables) -> DataFrame:
    sign = F.when(F.col("p_partkey") % 3 == 0, "□").when(F.col("p_partkey") % 3 == 1, "/").otherwise(" ")
    told = F.concat(F.lit("Modelo "), (38 + F.col("p_size") % 40).cast("string"), sign, (10 + F.col("p_size") % 20).cast("string"), F.lit(" negro"))
    caliber = codes.normalize_caliber(told)
    return t.part.select("p_partkey", caliber.alias("caliber"), codes.plausible_caliber(caliber).isNotNull().alias("plausible"))


def own_and_foreign_code(part):
    """A part's model code of five digits, and the code of another model whatever its own is."""
    code = F.concat(F.lit("BV"), F.lpad(part.cast("string"), 5, "0"), F.lit("S"))
    return code, F.when(code == "BV99999S", "BV99998S").otherwise("BV99999S")


@query(
    "F14_identity",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 'rejected' WHEN p_partkey % 4 = 2 THEN 'probable' ELSE 'exact' END AS match FROM part""",
)
def _identity(t: Tables) -> DataFrame:
    """references told in two ways."""
    code, foreign = own_and_foreign_code(F.col("p_partkey"))
    ours = F.concat(F.lit("Acme "), code, F.lit(" 005"))
    other = F.when(F.col("p_partkey") % 4 == 3, F.concat(F.lit("ACME "), foreign, F.lit("/005"))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("acme "), F.lower(code))).otherwise(F.concat(F.lit("acme "), F.lower(code), F.lit("-005")))
    read = lambda c: identity.parse_reference(c, ["Acme"])
    return t.part.select("p_partkey", identity.classify(read(ours), read(other))["match"].alias("match"))


CODES = "SELECT p_partkey AS id, p_partkey % 6 AS k, p_brand AS brand, 'M' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || 'X' AS model FROM part"


@query(
    "F13_references",
    f"""WITH c AS ({CODES}) SELECT id, CASE WHEN k < 3 THEN brand END AS brand, CASE WHEN k < 4 THEN model WHEN k = 4 THEN 'UNKNOWN WORDS' END AS model, CASE WHEN k IN (0, 1, 3) THEN '005' WHEN k = 4 THEN '12' END AS colour, CASE k WHEN 0 THEN '54-21' WHEN 3 THEN '55' END AS caliber, k = 5 AS ambiguous FROM c""",
)
def _references(t: Tables) -> DataFrame:
    """as many models as there are parts; brands with signs, models spelt apart, said twice, or beside another code."""
    k, code = F.col("p_partkey") % 6, F.concat(F.lit("M"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"))
    model, number = F.concat(code, F.lit("X")), F.regexp_extract("p_brand", "[0-9]+", 0)
    name = (
        F.when(k == 0, F.concat(F.lit("Brand "), number, F.lit(" "), model, F.lit(" 005 54-21")))
        .when(k == 1, F.concat(F.lit("brând-"), number, F.lit(" "), F.lower(code), F.lit("-x/005 negro")))
        .when(k == 2, F.concat("p_brand", F.lit(" Colección "), model, F.lit(" rojo")))
        .when(k == 3, F.concat(model, F.lit(" "), model, F.lit(" 005 55")))
        .when(k == 4, F.lit("unknown words 12")).otherwise(F.concat(model, F.lit(" M999999X 005")))
    )
    names = dealt(t.part, "p_partkey").select(F.col("p_partkey").alias("id"), name.alias("name"))
    return references(names, t.part.select(F.col("p_brand").alias("brand")), t.part.select(model.alias("model")))


PLAN = f"""WITH c AS ({CODES}), s AS (SELECT id, upper(brand) AS b, model AS m, upper(replace(brand, '#', '')) AS colour FROM c)
SELECT id, CAST(n AS INTEGER) AS step, level, query FROM (SELECT id, 0 AS n, 'ean' AS level, lpad(CAST(id AS VARCHAR), 13, '0') AS query FROM s UNION ALL SELECT id, 1, 'ean', CAST(id AS VARCHAR) FROM s WHERE id % 2 = 0
UNION ALL SELECT id, 1 + CAST(id % 2 = 0 AS INTEGER), 'brand_model_color', b || ' ' || m || ' ' || colour FROM s UNION ALL SELECT id, 2 + CAST(id % 2 = 0 AS INTEGER), 'model_color', m || ' ' || colour FROM s
UNION ALL SELECT id, 4 + CAST(id % 2 = 0 AS INTEGER), 'normalized_variants', m || colour FROM s UNION ALL SELECT id, 5 + CAST(id % 2 = 0 AS INTEGER), 'normalized_variants', m || '-' || colour FROM s)"""


@query("F13_search_plan", PLAN)
def _search_plan(t: Tables) -> DataFrame:
    """the searches for each product, in order."""
    model = F.concat(F.lit("M"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit("x"))
    other = F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string"))
    return search_plan(t.part.select(F.col("p_partkey").alias("id"), F.lpad(F.col("p_partkey").cast("string"), 13, "0").alias("ean"), other.alias("original_ean"), F.col("p_brand").alias("brand"), model.alias("model"), F.replace("p_brand", F.lit("#"), F.lit("")).alias("color")))


def lookup_of_all(parts: DataFrame) -> DataFrame:
    """every part against all others; a level counts only if another part has its keys.

    A level's parts are told by the least and the greatest id of its keys, so the pairs are
    made once, as they are given. Only ids with several rows can find one entry twice.
    """
    levels = [["p_name", "p_brand", "p_size"], ["p_name", "p_brand"]]
    rows = parts.select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_size").distinct()
    several = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    asked = rows
    found = None
    for rank, keys in enumerate(levels):
        entries = rows.select(F.col("id").alias("entry"), *keys).distinct()
        shared = entries.groupBy(*keys).agg(F.min("entry").alias("low"), F.max("entry").alias("high")).where("low < high").select(*keys)
        askers = asked.select("id", *keys).distinct().join(shared, keys, "left_semi")
        pairs = lambda some: some.join(entries, keys).where("id <> entry").select("id", "entry", F.lit(rank).alias("level"))  # noqa: B023, E731
        hit = pairs(askers.join(several, "id", "left_anti")).unionByName(pairs(askers.join(several, "id", "left_semi")).distinct())
        found = hit if found is None else found.unionByName(hit)
        asked = asked.join(askers.select("id"), "id", "left_anti")
    return found


@query(
    "F15_reference_lookup",
    """WITH hit AS (SELECT a.p_partkey AS id, b.p_partkey AS entry, 0 AS level FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_size = b.p_size WHERE a.p_partkey <> b.p_partkey
 UNION ALL SELECT a.p_partkey, b.p_partkey, 1 FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand WHERE a.p_partkey <> b.p_partkey)
SELECT DISTINCT id, entry, CAST(level AS INTEGER) AS level FROM hit JOIN (SELECT id AS of, min(level) AS least FROM hit GROUP BY id) ON id = of AND level = least""",
)
def _lookup(t: Tables) -> DataFrame:
    return lookup_of_all(t.part)
