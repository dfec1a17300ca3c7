"""Product facts of pages from their JSON-LD blocks: nodes walked to the end, variants by address, offers by what they are worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import normalize_gtin
from ..functions.money import parse_price
from ..functions.text import bound
from ..sources.tables import scratch

#: Fixed values of schema.org and of shops' addresses.
GTIN_KEYS = ("gtin13", "gtin12", "gtin14", "gtin8", "gtin", "ean")
INHERITED = ("name", "brand", "model", "color", "mpn", "sku", "url", "productGroupID")
AVAILABLE, UNAVAILABLE = ("instock", "limitedavailability"), ("outofstock", "soldout", "discontinued")
RESTRICTIONS = ("eligibleQuantity", "eligibleCustomerType", "validForMemberTier", "eligibleTransactionVolume")
LIST_PRICES, SALE_PRICES = ("listprice", "strikethroughprice", "srp", "msrp"), ("", "saleprice")
VARIANT_KEYS = "(variant|selectedSize)="
_NONE = "array<string>"


def at(node: Column, *keys: str) -> Column:
    """A value of a JSON object: text as it is, others as JSON."""
    return F.get_json_object(node, "$" + "".join(f"['{k}']" for k in keys))


def as_list(json: Column) -> Column:
    """A JSON array's elements, a single value as the only one, nothing for NULL."""
    return F.when(json.isNull(), F.array().cast(_NONE)).when(json.startswith("["), F.coalesce(F.from_json(json, _NONE), F.array().cast(_NONE))).otherwise(F.array(json))


def objects(values: Column) -> Column:
    return F.filter(values, lambda v: F.ltrim(v).startswith("{"))


def is_type(node: Column, name: str) -> Column:
    return F.exists(as_list(at(node, "@type")), lambda t: F.substring_index(t, "/", -1) == name)


def name_of(value: Column) -> Column:
    return F.nullif(F.trim(F.when(value.startswith("{"), at(value, "name")).otherwise(value)), F.lit(""))


def walk(pages: DataFrame) -> DataFrame:
    """``page_id, place, node``: every object of every JSON-LD block of ``pages`` (page_id, html), and of ``@graph`` at any depth.

    ``place`` puts them in the order of the document. A block that is no JSON is left
    out; raw line ends in texts are read as spaces. Each round takes the graphs of the
    nodes that the last one found, until none has any; rounds are written.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    blocks = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), 1), lambda b: F.trim(F.regexp_replace(b, r"[\x00-\x1F]", " ")))
    read = pages.select("page_id", F.posexplode(blocks).alias("block", "json")).where(F.try_parse_json("json").isNotNull())
    level = read.select("page_id", F.array("block").alias("above"), F.posexplode(as_list(F.col("json"))).alias("i", "node"))
    found, spark = None, pages.sparkSession
    while True:
        path = scratch(spark, "nodes")
        level.where(F.ltrim("node").startswith("{")).select("page_id", F.concat("above", F.array("i")).alias("place"), "node").write.parquet(path)
        level = spark.read.parquet(path)
        found = level if found is None else found.unionByName(level)
        graph = at(F.col("node"), "@graph")
        level = level.where(graph.isNotNull()).select("page_id", F.col("place").alias("above"), F.posexplode(as_list(graph)).alias("i", "node"))
        if level.isEmpty():
            return found


def resolved(address: Column, page: Column) -> Column:
    """An address as seen from a page."""
    site, scheme = F.regexp_extract(page, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(page, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    path = F.regexp_extract(page, "^([^?#]*)", 1)
    folder = F.when(path == site, F.concat(site, F.lit("/"))).otherwise(F.regexp_extract(path, "^(.*/)", 1))
    return F.when(address.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), address).when(address.startswith("//"), F.concat(scheme, address)).when(address.startswith("/"), F.concat(site, address)).when(address.startswith("?"), F.concat(path, address)).otherwise(F.concat(folder, address))


def address_key(address: Column) -> Column:
    """Scheme and host in lower case, path without slashes at its end, query in order; without the fragment."""
    bare = F.substring_index(address, "#", 1)
    head, query = F.substring_index(bare, "?", 1), F.regexp_extract(bare, r"\?(.*)$", 1)
    site = F.lower(F.regexp_extract(head, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)", 1))
    path = F.regexp_replace(F.substring(head, F.length(site) + 1, F.length(head)), "/+$", "")
    return F.concat(site, path, F.lit("?"), F.array_join(F.array_sort(F.array_remove(F.split(query, "&"), "")), "&"))


def _path(address: Column) -> Column:
    return F.regexp_extract(address, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def truth(value: Column) -> Column:
    text = F.lower(F.trim(value))
    return F.when(text.isin("true", "1", "yes", "sí", "si"), True).when(text.isin("false", "0", "no"), False)


def availability(value: Column) -> Column:
    token = F.regexp_replace(F.lower(F.substring_index(F.coalesce(value, F.lit("")), "/", -1)), "[^a-z]", "")
    return F.when(token.isin(*AVAILABLE), "available").when(token.isin(*UNAVAILABLE), "unavailable").otherwise("unknown")


def restricted(offer: Column) -> Column:
    """Whether a price holds for some customers or quantities alone."""
    out = F.coalesce(name_of(at(offer, "name")).rlike("(?i)cup[oó]n|coupon|promo(tional)? code"), F.lit(False))
    for field in RESTRICTIONS:
        out |= at(offer, field).isNotNull()
    return out


def _leaves(offers: Column) -> Column:
    """Offers, those inside an aggregate in its place: ``offer, held`` (a restriction of it or above it)."""
    def opened(o: Column) -> Column:
        inner = objects(as_list(at(o, "offers")))
        return bound(inner, lambda items: F.when(F.size(items) > 0, F.transform(items, lambda i: F.struct(i.alias("offer"), (restricted(o) | restricted(i)).alias("held")))).otherwise(F.array(F.struct(o.alias("offer"), restricted(o).alias("held")))))

    return F.flatten(F.transform(objects(offers), opened))


def _fact(offer: Column) -> Column:
    """``price, currency, stock, tax, previous, clash`` (of tax statements)``, raw, countries`` of an offer."""
    kind = lambda s: F.lower(F.substring_index(F.coalesce(at(s, "priceType"), F.lit("")), "/", -1))
    specs = objects(as_list(at(offer, "priceSpecification")))
    sale = F.filter(specs, lambda s: kind(s).isin(*SALE_PRICES) & ~restricted(s))
    first = lambda xs: F.try_element_at(F.filter(xs, lambda x: x.isNotNull()), F.lit(1))
    stated = F.concat(F.array(truth(at(offer, "valueAddedTaxIncluded"))), F.transform(sale, lambda s: truth(at(s, "valueAddedTaxIncluded"))))
    regions = F.transform(as_list(at(offer, "eligibleRegion")), lambda r: F.coalesce(name_of(at(r, "addressCountry")), name_of(r)))
    goals = F.flatten(F.transform(objects(as_list(at(offer, "shippingDetails"))), lambda s: F.transform(objects(as_list(at(s, "shippingDestination"))), lambda d: name_of(at(d, "addressCountry")))))
    price = F.when(at(offer, "price").isNotNull(), parse_price(at(offer, "price"))).otherwise(first(F.transform(sale, lambda s: parse_price(at(s, "price")))))
    return F.struct(
        price.alias("price"), F.upper(F.coalesce(at(offer, "priceCurrency"), F.lit(""))).alias("currency"), availability(at(offer, "availability")).alias("stock"), first(stated).alias("tax"),
        first(F.transform(F.filter(specs, lambda s: kind(s).isin(*LIST_PRICES)), lambda s: parse_price(at(s, "price")))).alias("previous"), (F.size(F.array_distinct(F.array_compact(stated))) > 1).alias("clash"), F.coalesce(at(offer, "availability"), F.lit("")).alias("raw"),
        F.transform(F.filter(F.array_compact(F.concat(regions, goals)), lambda c: c.rlike("^[A-Za-z]{2}$")), F.upper).alias("countries"),
    )


def _shared(group: Column) -> Column:
    """The one plain offer of a group, which all its variants have: a price that no condition limits."""
    offers = objects(as_list(at(group, "offers")))
    one = F.try_element_at(offers, F.lit(1))
    plain = (F.size(offers) == 1) & ~is_type(one, "AggregateOffer") & (F.size(as_list(at(one, "offers"))) == 0) & ~restricted(one) & parse_price(at(one, "price")).isNotNull() & (F.trim(F.coalesce(at(one, "priceCurrency"), F.lit(""))) != "")
    only = lambda k: at(one, k).alias(k)
    return F.when(plain, F.to_json(F.struct(only("price"), only("priceCurrency"), only("valueAddedTaxIncluded"))))


def products(nodes: DataFrame) -> DataFrame:
    """``page_id, place, product, parent, shared`` of :func:`walk`'s nodes: products, and variants of groups with their group."""
    node = F.col("node")
    alone = nodes.where(is_type(node, "Product")).select("page_id", "place", F.col("node").alias("product"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("shared"))
    groups = nodes.where(is_type(node, "ProductGroup") & ~is_type(node, "Product"))
    variants = groups.select("page_id", "place", "node", _shared(node).alias("shared"), F.posexplode(objects(as_list(at(node, "hasVariant")))).alias("i", "product"))
    return alone.unionByName(variants.select("page_id", F.concat("place", F.array("i")).alias("place"), "product", F.col("node").alias("parent"), "shared"))


def _own(r: Column, key: str) -> Column:
    value = at(r["product"], key)
    return F.coalesce(value, at(r["parent"], key)) if key in INHERITED else value


def _addresses(r: Column, page: Column) -> Column:
    offers = objects(as_list(at(r["product"], "offers")))
    inner = F.flatten(F.transform(offers, lambda o: objects(as_list(at(o, "offers")))))
    told = F.concat(F.array(_own(r, "url")), F.transform(F.concat(offers, inner), lambda o: at(o, "url")))
    return F.transform(F.filter(told, lambda u: u.isNotNull() & (u != "") & ~u.startswith("{") & ~u.startswith("[")), lambda u: resolved(u, page))


def _matches(r: Column, page: Column) -> Column:
    """Whether a product says that the page is its own; another variant's address in its ``url`` says it isn't."""
    own = resolved(_own(r, "url"), page)
    other = F.coalesce(own.rlike(rf"[?&]{VARIANT_KEYS}") & (address_key(own) != address_key(page)), F.lit(False))
    return ~other & F.exists(_addresses(r, page), lambda u: address_key(u) == address_key(page))


def page_products(pages: DataFrame) -> DataFrame:
    """A row for each row of ``pages`` (page_id, url, html): the one product that the page is about, and what its offers say.

    ``products`` counts what the blocks have. The product is the only one whose address
    is the page's, or the only one there is if no address tells variants apart; else
    ``ambiguous`` is true and nothing is taken. ``title, brand, model, colour`` (a code)``, ean``
    are the product's, with what a variant lacks from its group;
    ``price, currency, includes_tax, previous_price, availability, market`` come from offers
    without conditions, a group's offer only if all variants share it. Different prices,
    currencies or tax statements are ``ambiguous``; contradicting stock is
    ``stock_conflict`` and unknown, more than one market ``market_conflict`` and none. An
    aggregate's lowest price is no price. Offers of other variants' addresses don't count;
    if none is this one's, the page is ambiguous.

    A NULL or empty page has no products. Page ids must not repeat.
    """
    record = F.struct("place", "product", "parent", "shared")
    held = products(walk(pages)).groupBy("page_id").agg(F.array_sort(F.collect_list(record)).alias("records"))  # of one page
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("page")).join(held, "page_id", "left")
    page = F.col("page")
    key = lambda r: F.struct(r["product"], r["parent"])
    matching = F.filter(F.coalesce("records", F.array().cast("array<struct<place:array<int>,product:string,parent:string,shared:string>>")), lambda r: _matches(r, page))
    # a product said twice is one
    matching = F.filter(matching, lambda r, i: F.array_position(F.transform(matching, key), key(r)) == i + 1)
    rows = rows.withColumns({"matching": matching, "n": F.coalesce(F.size("records"), F.lit(0))}).withColumn("n", F.greatest("n", F.lit(0)))
    named = F.array_distinct(F.regexp_extract_all(page, F.lit(r"[?&](?:variant|selectedSize)=([^&#]+)"), 1))
    scoped = (F.col("n") > 1) | (F.size(named) > 0) | F.coalesce(F.exists("records", lambda r: F.exists(_addresses(r, page), lambda u: u.rlike(rf"[?&]{VARIANT_KEYS}"))), F.lit(False))
    single = F.when(F.size(named) > 1, None).when(F.size("matching") == 1, F.element_at("matching", 1))
    alone = (F.size(named) <= 1) & (F.size("matching") == 0) & (F.col("n") == 1) & ~scoped
    bare = F.transform("records", lambda r: F.struct(r["place"], r["product"], r["parent"], F.lit(None).cast("string").alias("shared")))
    rows = rows.withColumn("r", F.coalesce(single, F.when(alone, F.try_element_at(bare, F.lit(1)))))
    r = F.col("r")
    leaves = _leaves(F.concat(F.array_compact(F.array(r["shared"])), as_list(at(r["product"], "offers"))))
    rows = rows.withColumn("leaves", F.when(r.isNotNull(), leaves).otherwise(F.array().cast("array<struct<offer:string,held:boolean>>")))
    own = lambda x: resolved(at(x["offer"], "url"), page)
    of_variant = lambda x: F.coalesce((_path(own(x)) == _path(page)) & own(x).contains("?"), F.lit(False))
    rows = rows.withColumn("by_variant", F.filter("leaves", of_variant))
    told = (F.size("by_variant") > 1) | F.exists("by_variant", lambda x: own(x).rlike(rf"[?&]{VARIANT_KEYS}"))
    mine = F.filter("by_variant", lambda x: address_key(own(x)) == address_key(page))
    rows = rows.withColumns({"lost": told & (F.size(mine) == 0), "used": F.when(~told, F.col("leaves")).when(F.size(mine) == 0, F.filter("leaves", lambda x: F.lit(False))).otherwise(F.concat(F.filter("leaves", lambda x: ~of_variant(x)), mine))})
    rows = rows.withColumn("facts", F.transform(F.filter("used", lambda x: ~x["held"]), lambda x: _fact(x["offer"])))
    priced = F.filter("facts", lambda f: f["price"].isNotNull())
    kinds = F.size(F.array_distinct(F.transform(priced, lambda f: F.struct(f["price"], f["currency"], f["tax"]))))
    chosen = F.coalesce(F.try_element_at(priced, F.lit(1)), F.try_element_at("facts", F.lit(1)))
    stocks = F.array_distinct(F.transform(F.filter("facts", lambda f: f["stock"] != "unknown"), lambda f: f["stock"]))
    ordered = F.exists("facts", lambda f: (f["stock"] == "unknown") & f["raw"].rlike(r"(?i)backorder|preorder|preventa|pedido\s+anticipado"))
    conflict = (F.size(stocks) > 1) | (F.array_contains(stocks, "available") & ordered)
    markets = F.array_distinct(F.flatten(F.transform("facts", lambda f: f["countries"])))
    rows = rows.withColumns({"c": chosen, "stocks": stocks, "stock_conflict": conflict, "markets": markets})
    codes = F.flatten(F.array(*[F.transform(as_list(at(r["product"], k)), lambda c: normalize_gtin(c)) for k in GTIN_KEYS]))
    rows = rows.withColumn("codes", F.array_distinct(F.array_compact(codes)))
    colour = name_of(_own(r, "color"))
    ambiguous = ((F.col("n") > 0) & r.isNull()) | F.col("lost") | (kinds > 1) | F.exists("facts", lambda f: f["clash"]) | (F.size("codes") > 1)
    return rows.select(
        "page_id", F.col("n").alias("products"), name_of(_own(r, "name")).alias("title"), name_of(_own(r, "brand")).alias("brand"), name_of(_own(r, "model")).alias("model"), F.when(colour.rlike("[0-9]"), colour).alias("colour"), F.when(~F.col("lost"), F.try_element_at("codes", F.lit(1))).alias("ean"),
        F.col("c.price").alias("price"), F.nullif("c.currency", F.lit("")).alias("currency"), F.col("c.tax").alias("includes_tax"), F.col("c.previous").alias("previous_price"),
        F.when(F.col("stock_conflict"), "unknown").otherwise(F.coalesce(F.try_element_at("stocks", F.lit(1)), F.lit("unknown"))).alias("availability"), F.when(F.size("markets") == 1, F.element_at("markets", 1)).alias("market"),
        (F.size("markets") > 1).alias("market_conflict"), "stock_conflict", ambiguous.alias("ambiguous"),
    )
