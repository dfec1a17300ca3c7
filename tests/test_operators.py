import datetime as dt
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import keyed, ledger, ranks, series
from ledgerlight.plans import stock
from ledgerlight.sources import sheets, tables
from ledgerlight.streaming import alerts

DAY = dt.datetime(2025, 1, 1)


def stockouts_by_loop(rows):
    """The row-by-row state machine that the windows replace."""
    out, level, opened = [], 0.0, None
    for moved_at, _, kind, qty in sorted(rows):
        if kind == "entry":
            level += qty
            if opened is not None:
                out.append((opened, moved_at))
                opened = None
        elif kind == "exit":
            level -= qty
        if level <= 0 and opened is None:
            opened = moved_at
    return out + ([(opened, None)] if opened is not None else [])


def test_stockout_periods_against_the_loop(spark):
    rng, rows = random.Random(5), []
    for product in range(60):
        for i in range(rng.randint(1, 12)):
            rows.append((product, DAY + dt.timedelta(days=rng.randint(0, 6)), i, rng.choice(["entry", "exit", "other"]), float(rng.randint(1, 4))))
    df = spark.createDataFrame(rows, "product long, moved_at timestamp_ntz, move_id long, kind string, qty double")
    got = {}
    for r in ledger.stockout_periods(ledger.running_stock(df)).collect():
        got.setdefault(r.product, []).append((r.started_at, r.ended_at))
    for product in range(60):
        want = stockouts_by_loop([x[1:] for x in rows if x[0] == product])
        assert sorted(got.get(product, []), key=str) == sorted(want, key=str)


@pytest.mark.parametrize(
    ("sale", "threshold", "want"),
    [(-200, 180, "D"), (-200, 250, "A"), (-179, 180, "A"), (-180, 180, "D"), (None, 180, "D")],
)
def test_abcd_boundaries(spark, sale, threshold, want):
    at = dt.datetime(2025, 1, 1)
    row = (1, 100.0, 4.0, at - dt.timedelta(days=365), None, None if sale is None else at + dt.timedelta(days=sale), 0)
    df = spark.createDataFrame([row], "product long, pvo double, stock double, first_purchase timestamp_ntz, last_restock timestamp_ntz, last_sale timestamp_ntz, sales_180 long")
    assert stock.classify(df, F.lit("2025-01-01").cast("timestamp_ntz"), threshold).first().abcd == want


def test_abcd_without_any_date_is_c(spark):
    df = spark.createDataFrame([(1, None, 4.0, None, None, None, None)], "product long, pvo double, stock double, first_purchase timestamp_ntz, last_restock timestamp_ntz, last_sale timestamp_ntz, sales_180 long")
    row = stock.classify(df, F.lit("2025-01-01").cast("timestamp_ntz")).first()
    assert (row.abcd, row.alert) == ("C", "BAJO IMPACTO")


def test_as_of_takes_the_last_row_at_or_before(spark):
    left = spark.createDataFrame([("a", 1, 10), ("a", 5, 11), ("b", 5, 12), ("a", 0, 13)], "k string, t int, x int")
    right = spark.createDataFrame([("a", 1, 7.0), ("a", 4, 8.0), ("a", 6, 9.0)], "k string, t int, v double")
    got = {r.x: r.v for r in series.as_of(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {10: 7.0, 11: 8.0, 12: None, 13: None}


def test_latest_then_filter(spark):
    rows = spark.createDataFrame([("e", 1, True), ("e", 2, False)], "ean string, at int, available boolean")
    assert keyed.latest_per_key(rows, ["ean"], "at").where("available").count() == 0


def test_newest_is_the_latest_per_key(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(3), rng.randrange(4), i, rng.choice([None, 1.5])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, j int, at int, id int, v double").repartition(3)
    by = lambda found: sorted(map(tuple, found.select(*df.columns).collect()), key=str)
    assert by(keyed.newest(df, ["k", "j"], "at", "id")) == by(keyed.latest_per_key(df, ["k", "j"], "at", "id"))
    assert keyed.newest(df.limit(0), ["k"], "at").columns == ["k", "j", "at", "id", "v"]


def test_upsert_keeps_what_a_blank_would_erase(spark):
    old = spark.createDataFrame([(1, "x", 5), (2, "y", 1)], "id int, name string, seen int")
    new = spark.createDataFrame([(1, " ", 3), (3, "z", 9)], "id int, name string, seen int")
    got = sorted(tuple(r) for r in keyed.upsert(old, new, ["id"], newest=["seen"]).collect())
    assert got == [(1, "x", 5), (2, "y", 1), (3, "z", 9)]


def test_text_table_roundtrip(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("Código;Precio\n0012; 9,50 \n0012;8\n7;\n", encoding="utf-8")
    rows = tables.read_feed(spark, str(path), {"ean": ["Código"], "price": ["Precio"]}, "ean")
    assert sorted(tuple(r) for r in rows.collect()) == [("0012", "9,50"), ("7", "")]
    with pytest.raises(ValueError, match="missing columns: brand"):
        tables.canonicalize(rows, {"brand": []}, ["brand"])
    tables.write_csv(rows, str(tmp_path / "out"), "ean")
    assert (tmp_path / "out" / "ean=7").exists()


def test_cells_with_line_ends_quotes_and_separators(spark, tmp_path):
    cells = ["a\nb", "c\r\nd", 'say "x"; y', "plain", "back\\slash", '"', ""]
    rows = spark.createDataFrame([(str(i), c) for i, c in enumerate(cells)], "codigo string, texto string").repartition(3)
    tables.write_csv(rows, str(tmp_path / "out"))
    got = {r.codigo: r.texto for r in tables.read_text_table(spark, str(tmp_path / "out")).collect()}
    assert {k: v.replace("\r\n", "\n") for k, v in got.items()} == {str(i): c.replace("\r\n", "\n") for i, c in enumerate(cells)}


def test_parse_codes_and_observations(spark, tmp_path):
    df = spark.createDataFrame([("036000291452, 036000291452; abc\n12",)], "t string")
    got = sorted(tuple(r) for r in tables.parse_codes(df, "t").collect())
    assert got == [(0, "036000291452", "0036000291452"), (2, "abc", None), (3, "12", None)]
    (tmp_path / "o.json").write_text('{"schema": "price-observations/1", "observaciones": [{"ean_consultado": "036000291452", "precio_venta": 9.5, "iva_incluido": true, "fecha_observacion": "2025-01-02T10:00:00Z"}]}')
    row = tables.read_observations(spark, str(tmp_path / "o.json")).first()
    assert (row.ean, row.precio_venta) == ("0036000291452", 9.5)


def test_robots_and_feed(spark):
    df = spark.createDataFrame([("User-agent: *\nDisallow: /a\nAllow: /a/b\nUser-agent: x\nDisallow: /",)], "t string")
    assert [tuple(r) for r in tables.robots_rules(df, "t").collect()] == [(True, "/a/b"), (False, "/a")]
    xml = spark.createDataFrame([("<rss><item><title>t</title><link> http://a </link></item><item><link>http://b</link></item></rss>",)], "x string")
    assert xml.select(tables.feed_items(F.col("x"))).first()[0] == ["http://a", "http://b"]


def test_robots_groups_of_several_agents_and_texts(spark):
    texts = [(1, "User-agent: *\nUser-agent: Bot\nDisallow: /private # all\nDisallow:\n\nUser-agent: x\nDisallow: /"), (2, "user-agent: bot\nallow: /only"), (3, None), (4, "User-agent: *\r\nDisallow: /z")]
    df = spark.createDataFrame(texts, "id int, t string")
    assert [tuple(r) for r in tables.robots_rules(df, "t", "*", "id").collect()] == [(1, False, "/private"), (4, False, "/z")]
    assert [tuple(r) for r in tables.robots_rules(df, "t", "bot", "id").collect()] == [(1, False, "/private"), (2, True, "/only"), (4, False, "/z")]


def test_code_lists_stay_apart(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "c a")], "list int, t string")
    assert sorted(tuple(r)[:3] for r in tables.parse_codes(df, "t", "list").collect()) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (2, 1, "a")]


def test_changes_of_a_key_in_many_arrow_batches(spark, tmp_path):
    """A key's samples in no order and more of them than an Arrow batch holds: none counts as late."""
    rng = random.Random(4)
    rows = [(DAY + dt.timedelta(minutes=i), "k", 100.0 if i % 2 else 110.0) for i in range(900)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "at timestamp, key string, value double").write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    source = spark.readStream.schema("at timestamp, key string, value double").parquet(str(tmp_path / "in"))
    q = alerts.changes(source, "key", "value", "at").writeStream.format("memory").queryName("many").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert spark.table("many").count() == 899


@pytest.mark.parametrize("seed", range(4))
def test_exact_percentile_and_numbers(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([1.5, rng.random() * 1000, float(rng.randint(0, 20))]) for _ in range(3000)] if seed else [2.0]
    df = spark.createDataFrame([(i, i % 3, v) for i, v in enumerate(values)], "id long, k int, v double")
    assert ranks.exact_percentile(df, "v", 0.8) == df.agg(F.percentile("v", F.lit(0.8))).first()[0]
    want, place, running = {}, {}, {}
    for i, v in sorted(enumerate(values), key=lambda x: (x[1], x[0])):
        place[i % 3], running[i % 3] = place.get(i % 3, 0) + 1, running.get(i % 3, 0) + i
        want[i] = (place[i % 3], running[i % 3])
    assert {r.id: (r.place, r.running) for r in ranks.numbered(df, ["k"], "v", "id", weight=F.col("id")).collect()} == want
    assert ranks.exact_percentile(df.limit(0), "v", 0.8) is None and ranks.numbered(df.limit(0), [], "v", "id").count() == 0


def test_streams_give_alerts_and_changes_once(spark, tmp_path):
    rows = [(DAY + dt.timedelta(minutes=i), "k" if i % 2 else "m", v) for i, v in enumerate([10.0, 5.0, 10.2, 5.5, 12.0, 5.5, 12.1, 2.0])]
    spark.createDataFrame(rows, "at timestamp, key string, value double").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("at timestamp, key string, value double").parquet(str(tmp_path / "in"))
    q = alerts.changes(source, "key", "value", "at").writeStream.format("memory").queryName("moves").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.key, r.previous, r.value, r.kind) for r in spark.table("moves").collect())
    assert got == [("k", 5.0, 5.5, "price_up"), ("k", 5.5, 2.0, "price_down"), ("m", 10.2, 12.0, "price_up")]
    q = alerts.alerts_once(source, "at", "key").writeStream.format("memory").queryName("once").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 2


def test_abcd_takes_the_moves_of_all_products(spark, tmp_path):
    """Products 3 and 10 (3 modulo 7) move, 4 doesn't."""
    from ledgerlight import plans

    lines = [(3, "R", "1999-01-01"), (3, "A", "2001-11-01"), (10, "R", "1999-01-01"), (10, "A", "1999-02-01")]
    spark.createDataFrame([(p, 100.0, 5) for p in (3, 4, 10)], "p_partkey long, p_retailprice double, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    moved = spark.createDataFrame([(p, 1, i, 1, kind, day, 1.0) for i, (p, kind, day) in enumerate(lines)], "l_partkey long, l_suppkey long, l_orderkey long, l_linenumber int, l_returnflag string, day string, l_quantity double")
    moved.withColumn("l_shipdate", moved.day.cast("timestamp_ntz")).drop("day").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["product"]: (r.abcd, r.idle_days) for r in plans.QUERIES["abcd_classification"](spark, str(tmp_path)).collect()}
    assert got[3] == ("A", 4) and got[10][0] == "D" and got[4] == ("C", 9999)
    assert {r.abcd: r.products for r in plans.QUERIES["abcd_summary"](spark, str(tmp_path)).collect()} == {"A": 1, "C": 1, "D": 1}


def test_queries_over_all_ids(spark, data, tmp_path):
    """Part 1 has part 2's keys; of 3 and 4 only the size differs."""
    from ledgerlight import plans

    rows = [(1, "n", "b", 5), (2, "n", "b", 5), (3, "m", "b", 5), (4, "m", "b", 6), (5, "x", "b", 5), (6, None, "b", 5)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = plans.QUERIES["F15_reference_lookup"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 0), (2, 1, 0), (3, 4, 1), (4, 3, 1)]
    lines = spark.read.parquet(f"{data}/lineitem.parquet")
    assert plans.QUERIES["X3_all_checks"](spark, data).count() == lines.count()
    assert plans.QUERIES["X2_batch_preview"](spark, data).count() == lines.select("l_partkey", "l_suppkey").distinct().count()


def test_rules_without_a_brand_all_count(spark):
    from ledgerlight.plans import watch

    catalog = spark.createDataFrame([("1", "b", "Cat", "a ring")], "ean string, brand string, category string, name string")
    rules = spark.createDataFrame([(i, None, "cat" if i % 2 else None, "RING" if i % 3 else None) for i in range(1500)], "rule int, brand string, category string, part string")
    assert sorted(r.rule for r in watch.matching_rules(catalog, rules).collect()) == list(range(1500))


def test_sheets_of_other_programs(spark):
    """Shared strings, numbers, gaps, a title above the header, blank headers and rows."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>EAN</t></si><si><r><t>Sto</t></r><r><t>ck</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Informe</t></is></c></row><row r="2"><c r="B2" t="s"><v>0</v></c><c r="AA2" t="s"><v>1</v></c></row><row r="3"><c r="B3"><v>12</v></c><c r="C3"><v>9</v></c></row><row r="4"/><row r="5"><c r="AA5"><v>3.5</v></c></row></sheetData></worksheet>')
    files = spark.createDataFrame([(7, out.getvalue())], "id int, content binary")
    got = [(r.id, r.row, r.cells) for r in sheets.read_sheets(files, ["stock", "ean"], "id").collect()]
    assert got == [(7, 3, {"EAN": "12", "Stock": ""}), (7, 5, {"EAN": "", "Stock": "3.5"})]
    with pytest.raises(Exception, match="no header with precio"):
        sheets.read_sheets(files, ["precio"]).collect()
    assert list(sheets.cells(sheets.workbook(["a", "b"], iter([["1", None], ["", "x\x07y"]])))) == [["a", "b"], ["1"], ["", "xy"]]
