"""Products of pages by their JSON-LD, each rule by a page that it decides."""

import json

import pytest

from ledgerlight.operators.product_pages import page_products, walk

URL = "https://shop.example/p/frame"
EAN, OTHER = "0036000291452", "0012345678905"


def offer(price="99,50", **more):
    return {"@type": "Offer", "price": price, "priceCurrency": "eur", "availability": "https://schema.org/InStock", **more}


def product(**more):
    return {"@type": "Product", "name": " Frame ", "gtin13": "036000291452", "offers": offer(), **more}


def page(*blocks, quote='"'):
    return "<html>" + "".join(f"<script id=x type={quote}application/ld+json{quote}>{b if isinstance(b, str) else json.dumps(b)}</script>" for b in blocks) + "<p>x</html>"


def group(**more):
    return {"@type": "ProductGroup", "name": "Group", "brand": {"name": "B"}, "productGroupID": "G", **more}


CRUMBS = {"@type": "BreadcrumbList", "itemListElement": []}
CASES = {
    "plain": (page(product()), {"products": 1, "title": "Frame", "ean": EAN, "price": 99.5, "currency": "EUR", "availability": "available", "ambiguous": False}),
    "a breadcrumb first": (page(CRUMBS, product()), {"products": 1, "price": 99.5}),
    "single quotes": (page(product(), quote="'"), {"price": 99.5}),
    "a graph in a list": (page([{"@graph": [CRUMBS, product()]}]), {"price": 99.5}),
    "graphs in graphs": (page({"@graph": [{"@graph": [{"@type": "Thing", "@graph": [product(offers=offer("1.234,56"))]}]}]}), {"price": 1234.56}),
    "no JSON beside JSON": (page("{broken", product()), {"price": 99.5}),
    "line ends in texts": (page('{"@type":"Product","name":"a\nb","offers":{"price":5}}'), {"title": "a b", "price": 5.0, "currency": None}),
    "types by address": (page(product(**{"@type": ["http://schema.org/Product", "Thing"]})), {"price": 99.5}),
    "no product": (page(CRUMBS), {"products": 0, "title": None, "price": None, "ambiguous": False, "availability": "unknown"}),
    "no script": ("<html>", {"products": 0}),
    "null": (None, {"products": 0, "ambiguous": False}),
    "lowest price": (page(product(offers={"@type": "AggregateOffer", "lowPrice": 5, "priceCurrency": "EUR"})), {"price": None, "currency": "EUR"}),
    "offers in an aggregate": (page(product(offers={"@type": "AggregateOffer", "lowPrice": 5, "offers": [offer(), offer()]})), {"price": 99.5, "ambiguous": False}),
    "different prices": (page(product(offers=[offer(), offer("98")])), {"price": 99.5, "ambiguous": True}),
    "a condition": (page(product(offers=[offer("50", eligibleCustomerType="member"), offer("60", name="Cupón 10"), offer()])), {"price": 99.5, "ambiguous": False}),
    "a condition above": (page(product(offers={"@type": "AggregateOffer", "validForMemberTier": "x", "offers": [offer()]})), {"price": None, "availability": "unknown"}),
    "two products": (page([product(), product(name="Other", gtin13=OTHER[1:])]), {"products": 2, "ambiguous": True, "price": None, "title": None}),
    "two products, one of the page": (page([product(url="/p/other"), product(name="Mine", url="/p/frame/")]), {"products": 2, "ambiguous": False, "title": "Mine", "price": 99.5}),
    "said twice": (page(product(url=URL), product(url=URL)), {"products": 2, "ambiguous": False, "price": 99.5}),
    "an offer's address": (page([product(), product(name="Mine", offers=offer(url="HTTPS://Shop.Example/p/frame#x"))]), {"title": "Mine"}),
    "a variant inherits": (page(group(url=URL, hasVariant=[{"@type": "Product", "color": "005", "gtin13": "036000291452", "offers": offer()}])), {"title": "Group", "brand": "B", "colour": "005", "ean": EAN, "price": 99.5}),
    "a shared offer": (page(group(offers=offer("70"), hasVariant=[{"name": "V", "url": URL}, {"name": "W", "url": URL + "2"}])), {"title": "V", "price": 70.0, "ambiguous": False}),
    "an aggregate isn't shared": (page(group(offers={"@type": "AggregateOffer", "price": 5, "priceCurrency": "EUR"}, hasVariant=[{"name": "V", "url": URL}])), {"title": "V", "price": None}),
    "a variant elsewhere": (page(product(url=URL + "?variant=7")), {"ambiguous": True, "price": None}),
    "sale and list price": (page(product(offers={"priceCurrency": "EUR", "priceSpecification": [{"priceType": "https://schema.org/ListPrice", "price": "150"}, {"price": 120, "valueAddedTaxIncluded": True}]})), {"price": 120.0, "previous_price": 150.0, "includes_tax": True}),
    "tax statements": (page(product(offers=offer(valueAddedTaxIncluded="no", priceSpecification={"price": 1, "valueAddedTaxIncluded": "true"}))), {"includes_tax": False, "ambiguous": True, "price": 99.5}),
    "stock contradicts": (page(product(offers=[offer(), offer(availability="SoldOut")])), {"stock_conflict": True, "availability": "unknown", "ambiguous": False}),
    "orders ahead": (page(product(offers=[offer(), offer(availability="https://schema.org/PreOrder")])), {"stock_conflict": True}),
    "a market": (page(product(offers=offer(eligibleRegion="es", shippingDetails={"shippingDestination": {"addressCountry": "ES"}}))), {"market": "ES", "market_conflict": False}),
    "markets": (page(product(offers=offer(eligibleRegion=["ES", {"addressCountry": "PT"}]))), {"market": None, "market_conflict": True}),
    "codes contradict": (page(product(gtin12=OTHER[1:])), {"ambiguous": True}),
    "offers of variants": (page(product(url=URL, offers=[offer("1", url=URL + "?variant=1"), offer("2", url=URL + "?variant=2")])), {"ambiguous": True, "price": None, "ean": None}),
    "a name for a colour": (page(product(color="black")), {"colour": None}),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, URL, html) for i, (html, _) in enumerate(CASES.values())]
    got = {r.page_id: r.asDict() for r in page_products(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(CASES)
    return {name: got[i] for i, name in enumerate(CASES)}


@pytest.mark.parametrize("name", CASES)
def test_each_rule(found, name):
    want = CASES[name][1]
    assert {k: found[name][k] for k in want} == want


def test_the_page_of_a_variant(spark):
    both = [product(name=f"V{i}", url=f"{URL}?variant={i}", offers=offer(str(i), url=f"{URL}?variant={i}")) for i in (1, 2)]
    rows = [(1, f"{URL}?variant=2", page(both)), (2, f"{URL}?variant=3", page(both)), (3, f"{URL}?variant=1&selectedSize=2", page(both)), (4, None, page(product()))]
    got = {r.page_id: (r.title, r.price, r.ambiguous) for r in page_products(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("V2", 2.0, False), 2: (None, None, True), 3: (None, None, True), 4: ("Frame", 99.5, False)}


def test_nodes_stand_in_the_order_of_the_document(spark):
    deep = {"@type": "A", "@graph": [{"@type": "B", "@graph": {"@type": "C"}}, "text", {"@type": "D"}]}
    nodes = walk(spark.createDataFrame([(1, page([deep, {"@type": "E"}], {"@type": "F"})), (2, "")], "page_id long, html string")).orderBy("page_id", "place")
    assert [json.loads(r.node)["@type"] for r in nodes.collect()] == ["A", "B", "C", "D", "E", "F"]
