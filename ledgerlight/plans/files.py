"""Files, feeds and documents: written, read back and held against the tables they came from."""

from __future__ import annotations

import os
import sqlite3
import time
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity, money
from ..operators import keyed
from ..operators.grid import dealt
from ..operators.product_pages import page_products
from ..sources import sheets, tables
from ..sources.commits import CommitLog
from ..sources.keyed_table import KeyedTable
from ..sources.sqlite import read_sqlite
from ..streaming.alerts import Heartbeats, last_beats, poll
from . import web
from .registry import Tables, query
from .views import OFFERS, offers, products


@query("S1_stock_scan", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 0")
def _scan(t: Tables) -> DataFrame:
    """The columns that must be there, and products in stock."""
    return tables.scan(t.part, ["p_partkey", "p_size"], F.col("p_size") > 0).select("p_partkey", "p_name", "p_size")


@query("S1_sqlite_scan", "SELECT p_partkey AS id, p_name AS name, p_retailprice AS price FROM part WHERE p_size > 0 AND p_retailprice >= 1000 AND p_name IS NOT NULL")
def _sqlite(t: Tables) -> DataFrame:
    """Tables of SQLite files, written by the tasks that hold the rows; filters and columns go into SQLite."""
    folder = tables.scratch(t.spark, "sqlite")
    local = folder.removeprefix("file://").removeprefix("file:")
    if "://" in local:
        raise ValueError("SQLite files need a folder that is mounted everywhere")

    def write(batches):
        os.makedirs(local, exist_ok=True)
        con = sqlite3.connect(f"{local}/.{uuid.uuid4().hex}")
        con.execute("CREATE TABLE product (id INTEGER PRIMARY KEY, name TEXT, price REAL, size INTEGER)")
        n = 0
        for batch in batches:
            con.executemany("INSERT INTO product VALUES (?, ?, ?, ?)", zip(*(c.to_pylist() for c in batch.columns), strict=True))
            n += batch.num_rows
        con.commit()
        name = con.execute("PRAGMA database_list").fetchone()[2]
        con.close()
        os.rename(name, f"{local}/part-{TaskContext.get().partitionId()}.db")  # a repeated task puts its own in place
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    rows = t.part.select("p_partkey", "p_name", "p_retailprice", "p_size").repartition(4, "p_partkey")
    rows.mapInArrow(write, "n long").agg(F.sum("n")).first()
    found = read_sqlite(t.spark, local, "product", "id long, name string, price double, size long", partitions=2)
    return found.where("size > 0 AND price >= 1000 AND name IS NOT NULL").select("id", "name", "price")


@query(
    "K1_text_round_trip",
    "SELECT CAST(p_partkey AS VARCHAR) AS codigo, p_name || '; \"' || p_brand || '\"' AS nombre, CASE WHEN p_size % 3 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS stock FROM part",
)
def _round_trip(t: Tables) -> DataFrame:
    """Separators and quotes inside cells survive, every column is trimmed text and NULL is empty."""
    rows = t.part.select(F.col("p_partkey").alias("codigo"), F.concat("p_name", F.lit('; "'), "p_brand", F.lit('"')).alias("nombre"), F.when(F.col("p_size") % 3 != 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).alias("stock"))
    path = tables.scratch(t.spark, "csv")
    tables.write_csv(rows, path)
    return tables.read_text_table(t.spark, path)


@query("K2_partitioned_export", "SELECT p_type AS kind, CAST(count(*) AS BIGINT) AS rows, CAST(sum(p_partkey) AS BIGINT) AS keys FROM part GROUP BY p_type")
def _partitioned(t: Tables) -> DataFrame:
    """K2: a folder for each kind, read back by folder."""
    path = tables.scratch(t.spark, "parts")
    tables.write_csv(t.part.select("p_partkey", "p_name", F.col("p_type").alias("kind")), path, "kind")
    back = t.spark.read.csv(path, sep=";", header=True, inferSchema=False)
    return back.groupBy("kind").agg(F.count("*").alias("rows"), F.sum(F.col("p_partkey").cast("long")).alias("keys"))


@query(
    "K8_retention_rewrite",
    f"""WITH {OFFERS}, k AS (SELECT *, row_number() OVER (PARTITION BY ean, competitor_id ORDER BY captured_at DESC, id DESC) AS rn FROM offers)
SELECT competitor_id, CAST(count(*) AS BIGINT) AS kept, CAST(sum(id) AS BIGINT) AS ids FROM k WHERE captured_at >= TIMESTAMP '2000-06-01' OR rn = 1 OR id IN (SELECT id FROM offers WHERE discount = 0.05) GROUP BY competitor_id""",
)
def _rewrite(t: Tables) -> DataFrame:
    """K8: what a purge keeps, as the table's next version."""
    rows = offers(t)
    table = KeyedTable.create(t.spark, tables.scratch(t.spark, "offers"), rows.select("id", "competitor_id").schema, ["id"], 8)
    table.replace(rows)
    kept = keyed.retained(rows, ["ean", "competitor_id"], "captured_at", "id", F.lit("2000-06-01").cast("timestamp_ntz"), rows.where("discount = 0.05"))
    table.replace(kept)
    return table.read().groupBy("competitor_id").agg(F.count("*").alias("kept"), F.sum("id").alias("ids"))


@query("K9_backup", "SELECT * FROM supplier")
def _backup(t: Tables) -> DataFrame:
    """K9: the copy holds the table."""
    path = tables.scratch(t.spark, "supplier")
    tables.back_up(t.supplier, path)
    return t.spark.read.parquet(path)


@query("S7_feed_first_rows", "SELECT p_partkey % 50 AS ean, CAST(arg_min(p_size, p_partkey) AS VARCHAR) AS price, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY 1".replace("p_partkey % 50 AS ean", "CAST(p_partkey % 50 AS VARCHAR) AS ean"))
def _feed(t: Tables) -> DataFrame:
    """A feed with the header's other spellings; the first row of a code counts."""
    path = tables.scratch(t.spark, "feed")
    rows = t.part.select("p_partkey", (F.col("p_partkey") % 50).cast("string").alias("Código EAN"), F.col("p_size").cast("string").alias("PVP"), "p_name")
    tables.write_csv(rows.coalesce(1).sortWithinPartitions("p_partkey").drop("p_partkey"), path)  # a feed is one file
    return tables.read_feed(t.spark, path, {"ean": ["código ean"], "price": ["pvp"]}, "ean")


@query(
    "S8_code_lists",
    """WITH c AS (SELECT c_custkey AS list, unnest(['036000291452', CAST(c_custkey % 10 AS VARCHAR), CAST(c_custkey % 7 AS VARCHAR), '036000291452', 'A' || CAST(c_custkey % 3 AS VARCHAR)]) AS code, unnest([0, 1, 2, 3, 4]) AS position FROM customer)
SELECT list, CAST(min(position) AS INTEGER) AS position, code, CASE WHEN code = '036000291452' THEN '0036000291452' END AS gtin FROM c GROUP BY list, code""",
)
def _codes(t: Tables) -> DataFrame:
    """A pasted list for each customer; the first of equal codes keeps its place."""
    own = lambda n: (F.col("c_custkey") % n).cast("string")
    pasted = F.concat(F.lit("036000291452, "), own(10), F.lit(";"), own(7), F.lit("\n036000291452 A"), own(3))
    return tables.parse_codes(t.customer.select(F.col("c_custkey").alias("list"), pasted.alias("pasted")), "pasted", "list")


@query("S10_watch_groups", "SELECT p_brand AS name, CASE WHEN p_brand LIKE '%1%' THEN 12 ELSE 24 END AS interval_hours, lpad(CAST(p_partkey AS VARCHAR), 13, '0') AS ean FROM part WHERE p_size > 30")
def _groups(t: Tables) -> DataFrame:
    """A configuration of watch groups as JSON, written and read back; a group without an interval has a day."""
    rows = products(t).where("stock > 30").groupBy(F.col("brand").alias("name")).agg(F.collect_list("ean").alias("eans")).withColumn("interval_hours", F.when(F.col("name").contains("1"), 12))
    path = tables.scratch(t.spark, "groups")
    rows.write.json(path)
    return tables.read_groups(t.spark, path)


@query(
    "S9_observed_offers",
    """SELECT l_orderkey AS document, CASE WHEN l_partkey % 2 = 0 THEN '0036000291452' END AS ean, 's' || CAST(l_suppkey AS VARCHAR) AS competidor, l_quantity AS precio_venta, l_tax <= 0.04 AS iva_incluido, CASE WHEN l_linenumber % 3 > 0 THEN date_trunc('second', l_shipdate) END AS captured_at FROM lineitem WHERE l_orderkey % 4 > 0""",
)
def _observed(t: Tables) -> DataFrame:
    """A document for each order; every fourth has another version and gives nothing, unreadable dates and codes are NULL."""
    one = F.struct(
        F.when(F.col("l_partkey") % 2 == 0, "036000291452").otherwise("no code").alias("ean_consultado"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("competidor"), F.col("l_quantity").alias("precio_venta"),
        (F.col("l_tax") <= 0.04).alias("iva_incluido"), F.when(F.col("l_linenumber") % 3 > 0, F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("hoy").alias("fecha_observacion"),
    )
    version = F.when(F.col("document") % 4 > 0, "price-observations/1").otherwise("price-observations/2")
    made = t.lineitem.groupBy(F.col("l_orderkey").alias("document")).agg(F.collect_list(one).alias("observaciones"))
    text = made.select("document", F.to_json(F.struct(version.alias("schema"), "observaciones")).alias("json"))
    docs = text.select("document", F.from_json("json", tables.OBSERVATIONS).alias("d")).select("document", "d.*")
    return tables.observations(docs, "document").select("document", "ean", "competidor", "precio_venta", "iva_incluido", F.col("captured_at").cast("timestamp_ntz").alias("captured_at"))


@query(
    "S12_feed_links",
    "SELECT p_brand AS feed, 'https://shop.example/' || CAST(p_partkey AS VARCHAR) AS link FROM part",
)
def _links(t: Tables) -> DataFrame:
    """An RSS feed for each brand; items without a link have none."""
    item = F.concat(F.lit("<item><title>"), F.col("p_name"), F.lit("</title>\n<link> https://shop.example/"), F.col("p_partkey").cast("string"), F.lit(" </link></item>"))
    feeds = t.part.groupBy(F.col("p_brand").alias("feed")).agg(F.concat(F.lit("<rss><channel><link>https://shop.example</link>"), F.array_join(F.collect_list(item), "\n"), F.lit("</channel></rss>")).alias("xml"))
    return feeds.select("feed", F.explode(tables.feed_items(F.col("xml"))).alias("link"))


@query(
    "S13_robots_rules",
    """SELECT n_nationkey AS site, false AS allow, '/private/' || n_name AS path FROM nation WHERE n_nationkey % 3 <> 1 UNION ALL SELECT n_nationkey, true, '/private/' || n_name || '/open' FROM nation WHERE n_nationkey % 3 <> 1
UNION ALL SELECT n_nationkey, false, '/bots' FROM nation WHERE n_nationkey % 3 = 1""",
)
def _robots(t: Tables) -> DataFrame:
    """A text for each site; agents in a row share rules, and a group of our own stands before that of all."""
    shared = F.concat(F.lit("# site\nUser-agent: *\nUser-Agent: Other\nDisallow: /private/"), F.col("n_name"), F.lit(" # no\nAllow: /private/"), F.col("n_name"), F.lit("/open\nDisallow:\n\nUser-agent: third\nDisallow: /"))
    own = F.concat(shared, F.lit("\nuser-agent: Ledger\nDisallow: /bots"))
    sites = t.nation.select(F.col("n_nationkey").alias("site"), F.when(F.col("n_nationkey") % 3 == 1, own).otherwise(shared).alias("robots"))
    return tables.robots_rules(sites, "robots", "ledger", "site").select("site", "allow", "path")


@query(
    "K3_sheets",
    """SELECT p_brand, CAST((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 30 AS INTEGER) AS sheet, lpad(CAST(p_partkey AS VARCHAR), 13, '0') AS ean, p_name || ' <&> "ñ"' AS nombre, CASE WHEN p_size % 4 > 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS stock FROM part""",
)
def _sheets(t: Tables) -> DataFrame:
    """Workbooks of at most 30 products for each brand, read back by their header; zeros, signs and empty cells survive."""
    stock = F.when(F.col("p_size") % 4 > 0, F.col("p_size"))
    rows = t.part.select("p_brand", "p_partkey", F.lpad(F.col("p_partkey").cast("string"), 13, "0").alias("EAN"), F.concat("p_name", F.lit(' <&> "ñ"')).alias("Nombre"), stock.alias("Stock"))
    back = sheets.read_sheets(sheets.as_sheets(rows, "p_brand", "p_partkey", 31), ["ean", "stock"], "p_brand", "sheet")
    return back.select("p_brand", "sheet", F.col("cells")["EAN"].alias("ean"), F.col("cells")["Nombre"].alias("nombre"), F.col("cells")["Stock"].alias("stock"))


@query(
    "K4_archives",
    "SELECT n_regionkey, n_name || '.csv' AS name, CAST(length(n_name || ';' || CAST(n_nationkey AS VARCHAR)) AS INTEGER) AS size, sha256(n_name || ';' || CAST(n_nationkey AS VARCHAR)) AS digest FROM nation",
)
def _archives(t: Tables) -> DataFrame:
    """K4: an archive for each region, read back."""
    text = F.concat_ws(";", "n_name", F.col("n_nationkey").cast("string"))
    made = sheets.as_zip(t.nation.select("n_regionkey", F.concat("n_name", F.lit(".csv")).alias("name"), text.cast("binary").alias("content")), "n_regionkey")
    return sheets.read_zip(made, "n_regionkey").select("n_regionkey", "name", F.length("content").alias("size"), F.sha2("content", 256).alias("digest"))


@query("R1_polled_batches", "SELECT event_type, CAST(count(*) AS BIGINT) AS handled, true AS beaten FROM events GROUP BY event_type")
def _polled(t: Tables) -> DataFrame:
    """A polled source, asked twice; each batch is handled once, and the session's listener hears of it."""
    source, done = tables.scratch(t.spark, "events"), tables.scratch(t.spark, "handled")
    progress, name = tables.scratch(t.spark, "progress"), f"polled-{uuid.uuid4().hex[:8]}"
    log = CommitLog(t.spark, tables.scratch(t.spark, "beats"))
    listener = Heartbeats(log)
    t.spark.streams.addListener(listener)
    handle = lambda batch, _: batch.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("append").parquet(done)
    try:
        for part in (0, 1):
            t.events.where(F.col("event_id") % 2 == part).select("event_id", "event_type").repartition(3).write.mode("append").parquet(source)
            stream = t.spark.readStream.schema("event_id long, event_type string").parquet(source)
            poll(stream, name, handle, progress, once=True).awaitTermination(600)
        t.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        deadline = time.monotonic() + 30
        while last_beats(log).get(name, {}).get("rows") != t.events.count() and time.monotonic() < deadline:
            time.sleep(0.2)  # beats come from another thread
    finally:
        t.spark.streams.removeListener(listener)
    beat = last_beats(log).get(name, {})
    handled = t.spark.read.parquet(done).groupBy("event_type").agg(F.sum("n").alias("handled"))
    return handled.withColumn("beaten", F.lit(beat.get("rows") == t.events.count() and beat.get("error") is None))


# --- product pages -----------------------------------------------------------


def _pages(t: Tables) -> DataFrame:
    """A page for each part, in one of six shapes."""
    name, price = F.col("p_name"), F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    flat = F.concat(F.lit('{"@type":"Product","name":"'), name, F.lit('","gtin13":"0036000291452","offers":{"@type":"Offer","price":"'), price, F.lit('","priceCurrency":"EUR","availability":"https://schema.org/InStock"}}'))
    graph = F.concat(F.lit('{"@context":"x","@graph":[{"@type":"WebPage","name":"no"},'), flat, F.lit("]}"))
    group = F.concat(F.lit('{"@type":"ProductGroup","name":"'), name, F.lit('","brand":"B","hasVariant":[{"@type":"Product","gtin13":"036000291452","offers":[{"price":'), price, F.lit(',"priceCurrency":"USD"}]},{"@type":"Product","name":"other"}]}'))
    many = F.concat(F.lit('[{"@type":["Product","Thing"],"name":"'), name, F.lit('","gtin13":"12","offers":{"@type":"AggregateOffer","lowPrice":5,"offers":[{"price":"'), price, F.lit('","priceCurrency":"EUR"}]}}]'))
    script = lambda ld: F.concat(F.lit('<html><script type="application/ld+json">'), ld, F.lit("</script>"))
    meta = F.concat(
        F.lit("<html><h1> "), name, F.lit(' </h1><meta property="product:price:amount" content="'), (F.col("p_retailprice") * 1.21).cast("decimal(18,2)").cast("string"), F.lit('"><meta property="product:price:currency" content="EUR"><meta property="product:pretax_price:amount" content="'), price, F.lit('">Agotado. In stock</html>'),
    )
    k = F.col("p_partkey") % 6
    html = F.when(k == 0, F.concat(script(flat), F.lit("<p>En stock"))).when(k == 1, script(graph)).when(k == 2, F.concat(script(group), F.lit("<p>Sold out"))).when(k == 3, script(many)).when(k == 4, meta).otherwise(F.concat(F.lit("<html><h1>"), name, F.lit("</h1>{not json")))
    return dealt(t.part, "p_partkey").select(F.col("p_partkey").alias("page_id"), html.alias("html"))


@query(
    "N5_product_pages",
    """WITH p AS (SELECT p_partkey AS page_id, p_partkey % 6 AS k, p_name, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS price, CAST(CAST(p_retailprice * 1.21 AS DECIMAL(18,2)) AS DOUBLE) AS taxed FROM part)
SELECT page_id, 0 AS variant, p_name AS name, CASE WHEN k < 4 THEN price WHEN k = 4 THEN taxed END AS price, CASE WHEN k = 2 THEN 'USD' WHEN k < 5 THEN 'EUR' END AS currency, CASE WHEN k < 3 THEN '0036000291452' END AS ean, CAST(CASE WHEN k = 4 THEN 21 END AS INTEGER) AS vat,
  CASE WHEN k IN (0, 1) THEN 'available' WHEN k = 2 THEN 'unavailable' ELSE 'unknown' END AS availability, k = 4 AS conflict FROM p
UNION ALL SELECT page_id, 1, 'other', NULL, NULL, NULL, NULL, 'unavailable', false FROM p WHERE k = 2""",
)
def _products(t: Tables) -> DataFrame:
    """Nodes of a graph, of a list, variants that inherit, offers within an offer, meta elements, stock phrases that contradict each other."""
    return web.product_nodes(_pages(t)).withColumn("variant", F.col("variant").cast("int"))


@query(
    "N5_page_facts",
    """WITH p AS (SELECT p_partkey AS page_id, p_partkey % 9 AS k, p_name AS name, p_brand AS brand, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS price, CAST(CAST(p_retailprice + 10 AS DECIMAL(18,2)) AS DOUBLE) AS more FROM part)
SELECT page_id, CAST(CASE WHEN k IN (3, 4) THEN 2 WHEN k = 8 THEN 0 ELSE 1 END AS INTEGER) AS products, CASE WHEN k < 8 THEN name END AS title, CASE WHEN k = 4 THEN brand END AS brand, CASE WHEN k < 8 AND k <> 2 THEN price END AS price, CASE WHEN k < 8 THEN 'EUR' END AS currency,
  CASE WHEN k = 7 THEN more END AS previous_price, CASE WHEN k = 7 THEN true END AS includes_tax, CASE WHEN k IN (2, 4, 7, 8) THEN 'unknown' WHEN k = 6 THEN 'unavailable' ELSE 'available' END AS availability, CASE WHEN k = 0 THEN 'ES' END AS market, k = 5 AS ambiguous FROM p""",
)
def _page_facts(t: Tables) -> DataFrame:
    """Graphs in lists, blocks beside others, variants of the page's address, offers with conditions, list prices."""
    k, price = F.col("p_partkey") % 9, F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    more = (F.col("p_retailprice") + 10).cast("decimal(18,2)").cast("string")
    url = F.concat(F.lit("https://s.example/p/"), F.col("p_partkey").cast("string"))
    join = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    offer = lambda p, rest="": join('{"@type":"Offer","price":"', p, '","priceCurrency":"eur"', rest, "}")
    product = lambda offers, rest="": join('{"@type":"Product","name":"', F.col("p_name"), '"', rest, ',"offers":', offers, "}")
    stock = ',"availability":"https://schema.org/InStock"'
    plain = product(offer(price, stock))
    script = lambda ld, quote='"': join(f"<script type={quote}application/ld+json{quote}>", ld, "</script>")
    html = (
        F.when(k == 0, join(script(F.lit('{"@type":"BreadcrumbList"}'), "'"), script(product(offer(price, stock + ',"eligibleRegion":"ES"')), "'")))
        .when(k == 1, script(join('[{"@graph":[{"@type":"WebPage"},{"@graph":', plain, "}]}]")))
        .when(k == 2, script(product(join('{"@type":"AggregateOffer","priceCurrency":"EUR","lowPrice":"', price, '"}'))))
        .when(k == 3, script(join("[", product(offer(more), ',"url":"/p/0"'), ",", product(offer(price, stock), join(',"url":"', url, '"')), "]")))
        .when(k == 4, script(join('{"@type":"ProductGroup","brand":{"name":"', F.col("p_brand"), '"},"name":"', F.col("p_name"), '","offers":', offer(price), ',"hasVariant":[{"url":"', url, '"},{"url":"/p/0"}]}')))
        .when(k == 5, script(product(join("[", offer(price, stock), ",", offer(more), "]"))))
        .when(k == 6, script(product(join("[", offer(more, ',"eligibleQuantity":2'), ",", offer(price, ',"availability":"SoldOut"'), "]"))))
        .when(k == 7, script(product(join('{"priceCurrency":"EUR","priceSpecification":[{"priceType":"https://schema.org/ListPrice","price":', more, '},{"price":"', price, '","valueAddedTaxIncluded":true}]}'))))
        .otherwise(F.lit("<script type='application/ld+json'>{not json</script>"))
    )
    found = page_products(dealt(t.part, "p_partkey").select(F.col("p_partkey").alias("page_id"), url.alias("url"), html.alias("html")))
    return found.select("page_id", F.col("products").cast("int").alias("products"), "title", "brand", "price", "currency", "previous_price", "includes_tax", "availability", "market", "ambiguous")


@query(
    "X33_identified_offers",
    """SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_partkey % 4 = 3 THEN 'rejected' WHEN l_partkey % 4 = 2 THEN 'probable' ELSE 'exact' END AS match, CASE WHEN l_partkey % 4 < 2 THEN l_quantity * 1.5 END AS price_eur FROM lineitem""",
)
def _identified(t: Tables) -> DataFrame:
    """A feed's rows become offers only as far as their identity holds; others keep no price."""
    code, foreign = web.own_and_foreign_code(F.col("l_partkey"))
    told = F.when(F.col("l_partkey") % 4 == 3, F.concat(F.lit("ACME "), foreign, F.lit("/005"))).when(F.col("l_partkey") % 4 == 2, F.concat(F.lit("acme "), F.lower(code))).otherwise(F.concat(F.lit("acme "), F.lower(code), F.lit("-005")))
    read = lambda c: identity.parse_reference(c, ["Acme"])
    match = identity.classify(read(F.concat(F.lit("Acme "), code, F.lit(" 005"))), read(told))["match"]
    rows = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), match.alias("match"), "l_quantity")
    return rows.select("id", "match", F.when(F.col("match") == "exact", money.effective_eur(F.col("l_quantity"), F.lit(None).cast("double"), F.lit(1.5))).alias("price_eur"))
