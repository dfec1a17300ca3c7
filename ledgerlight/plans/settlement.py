"""Settlement movements against invoice documents: rows with their errors, statuses of both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, money
from ..operators.matching import sole_partners
from .registry import Tables, query

#: Kinds of movements (fixed values); the first two have a document.
KINDS = ("Settled", "Refunded", "Fee", "InvoiceDeduction", "MerchantPayout")
MATCHED_KINDS = KINDS[:2]
AMOUNT, REFERENCES = ("gross", "currency"), ("psp", "order_ref")


def reconcile(movements: DataFrame, documents: DataFrame) -> DataFrame:
    """``side, id, status, document, related`` for every movement and every document.

    ``movements``: id, kind, gross (decimal), currency, psp, order_ref; ``documents``: the
    same without kind. A movement of a matched kind and a document are related where
    amount and currency agree, and refer to each other where besides one of the
    references does (empty ones don't). One reference alone on both sides confirms;
    else nothing related is ``sin_coincidencia``, one alone on both sides ``candidata``,
    anything more ``ambigua``. ``related`` counts related rows of the other side;
    ``document`` is the confirmed one.
    """
    matched = F.col("kind").isin(*MATCHED_KINDS)
    names = ("id", *AMOUNT, *REFERENCES)
    m = movements.select(F.lit(True).alias("movement"), F.coalesce(matched, F.lit(False)).alias("matched"), *names)
    rows = m.unionByName(documents.select(F.lit(False).alias("movement"), F.lit(True).alias("matched"), *names))
    # how many rows of each side an amount has; the pairs would be their product
    sizes = rows.where("matched").groupBy(*AMOUNT).agg(F.count_if("movement").alias("n_movements"), F.count_if(~F.col("movement")).alias("n_documents"))
    related = F.when(F.col("matched"), F.coalesce(F.when(F.col("movement"), F.col("n_documents")).otherwise(F.col("n_movements")), F.lit(0))).otherwise(0)
    single = F.coalesce((F.col("n_movements") == 1) & (F.col("n_documents") == 1), F.lit(False))
    references = [F.when(F.col("matched"), F.col(c)).alias(c) for c in REFERENCES]
    sized = rows.join(sizes, list(AMOUNT), "left").select("movement", "id", *AMOUNT, *references, related.alias("related"), single.alias("single"))
    found = sole_partners(sized, AMOUNT, REFERENCES, "movement", "id", "related", "single")
    status = F.when(F.col("partner").isNotNull(), "confirmada").when(F.col("related") == 0, "sin_coincidencia").when(F.col("single"), "candidata").otherwise("ambigua")
    document = F.when(F.col("movement") | F.col("partner").isNull(), F.col("partner")).otherwise(F.col("id"))
    return found.select(F.when(F.col("movement"), "movement").otherwise("document").alias("side"), "id", status.alias("status"), document.alias("document"), F.col("related").cast("long").alias("related"))


def _amount(credit: str, debit: str) -> tuple[Column, Column]:
    """Credit less debit, blank for zero, and whether one of them is no amount."""
    parts = [F.when(F.col(c) == "", F.lit(0).cast("decimal(38,6)")).otherwise(money.money(F.col(c))) for c in (credit, debit)]
    return parts[0] - parts[1], parts[0].isNull() | parts[1].isNull()


def _currency(c: Column) -> Column:
    return F.regexp_extract(F.upper(c), "^[A-Z]{3}$", 0)


def movement_rows(raw: DataFrame) -> DataFrame:
    """Settlement rows as text with their values and ``error``, the first fault in the order of checks; NULL where there is none.

    ``raw``: row, account, batch, date, kind, currency, original_currency, net_credit,
    net_debit, gross_credit, gross_debit, psp, order_ref, all but row text; NULL is empty.
    A row with an error keeps its text and has no values, so that nothing is exported
    while errors are left.
    """
    names = ["account", "batch", "date", "kind", "currency", "original_currency", "net_credit", "net_debit", "gross_credit", "gross_debit", "psp", "order_ref"]
    t = raw.select("row", *[F.coalesce(F.trim(F.col(c)), F.lit("")).alias(c) for c in names])
    net, bad_net = _amount("net_credit", "net_debit")
    gross, bad_gross = _amount("gross_credit", "gross_debit")
    has_gross = (F.col("gross_credit") != "") | (F.col("gross_debit") != "")
    error = (
        F.when((F.col("account") == "") | (F.col("batch") == ""), "cuenta_o_lote")
        .when(~F.col("kind").isin(*KINDS), "tipo")
        .when((F.col("net_credit") == "") & (F.col("net_debit") == ""), "neto_vacio")
        .when(bad_net, "neto")
        .when(has_gross & bad_gross, "bruto")
        .when(has_gross & (_currency(F.col("original_currency")) == ""), "moneda_original")
        .when(~has_gross & F.col("kind").isin(*MATCHED_KINDS), "bruto_vacio")
        .when(_currency(F.col("currency")) == "", "moneda")
        .when(dates.written_date(F.col("date")).isNull(), "fecha")
    )
    t = t.withColumn("error", error)
    good = lambda c: F.when(F.col("error").isNull(), c)
    return t.select(
        "row", "account", "batch", "kind", "psp", "order_ref", "error", good(_currency(F.col("currency"))).alias("currency"), good(dates.written_date(F.col("date"))).alias("booked"),
        good(net).alias("net"), good(F.when(has_gross, gross)).alias("gross"), good(F.when(has_gross, _currency(F.col("original_currency"))).otherwise("")).alias("original_currency"),
    )


def document_rows(raw: DataFrame) -> DataFrame:
    """Invoice rows (row, number, partner, date, amount, currency, psp, order_ref as text) likewise."""
    t = raw.select("row", *[F.coalesce(F.trim(F.col(c)), F.lit("")).alias(c) for c in ("number", "partner", "date", "amount", "currency", "psp", "order_ref")])
    amount, day = money.money(F.col("amount")), dates.written_date(F.col("date"))
    error = F.when(F.col("number") == "", "numero").when(day.isNull(), "fecha").when(amount.isNull(), "importe").when(_currency(F.col("currency")) == "", "moneda")
    t = t.withColumn("error", error)
    good = lambda c: F.when(F.col("error").isNull(), c)
    return t.select("row", "number", "partner", "psp", "order_ref", "error", good(day).alias("booked"), good(amount).alias("gross"), good(_currency(F.col("currency"))).alias("currency"))


# --- queries -----------------------------------------------------------------

RECONCILE = """WITH m AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'Settled' WHEN 'O' THEN 'Refunded' ELSE 'Fee' END AS kind, CAST(round(o_totalprice, -3) AS DECIMAL(38,6)) AS gross, o_orderpriority AS currency,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'p' || CAST(o_orderkey // 3 AS VARCHAR) END AS psp, CASE WHEN o_orderkey % 4 > 0 THEN 'c' || CAST(o_custkey AS VARCHAR) END AS ref FROM orders),
d AS (SELECT o_orderkey AS id, CAST(round(CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 5000 ELSE o_totalprice END, -3) AS DECIMAL(38,6)) AS gross, o_orderpriority AS currency,
  CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'p' || CAST((o_orderkey + o_orderkey % 2) // 3 AS VARCHAR) END AS psp, CASE WHEN o_orderkey % 3 > 0 THEN 'c' || CAST(o_custkey AS VARCHAR) ELSE '' END AS ref FROM orders WHERE o_orderkey % 8 <> 3),
e AS (SELECT m.id AS mid, d.id AS did, (m.psp <> '' AND m.psp = d.psp) OR (m.ref <> '' AND m.ref = d.ref) AS refers FROM m JOIN d ON m.gross = d.gross AND m.currency = d.currency WHERE m.kind <> 'Fee'),
em AS (SELECT mid, count(*) AS n, count(*) FILTER (WHERE refers) AS refs, min(did) AS did, min(did) FILTER (WHERE refers) AS ref_did FROM e GROUP BY mid), ed AS (SELECT did, count(*) AS n, count(*) FILTER (WHERE refers) AS refs, min(mid) AS mid FROM e GROUP BY did),
ok AS (SELECT em.mid, em.ref_did AS did FROM em JOIN ed ON ed.did = em.ref_did WHERE em.refs = 1 AND ed.refs = 1)"""


def _movements(t: Tables) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "Settled").when(F.col("o_orderstatus") == "O", "Refunded").otherwise("Fee")
    psp = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.concat(F.lit("p"), F.expr("o_orderkey div 3").cast("string")))
    ref = F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    return t.orders.select(F.col("o_orderkey").alias("id"), kind.alias("kind"), F.round("o_totalprice", -3).cast("decimal(38,6)").alias("gross"), F.col("o_orderpriority").alias("currency"), psp.alias("psp"), ref.alias("order_ref"))


def _documents(t: Tables) -> DataFrame:
    gross = F.round(F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 5000).otherwise(F.col("o_totalprice")), -3).cast("decimal(38,6)")
    psp = F.when(F.col("o_orderkey") % 6 == 0, "").otherwise(F.concat(F.lit("p"), F.expr("(o_orderkey + o_orderkey % 2) div 3").cast("string")))
    ref = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).otherwise("")
    return t.orders.where("o_orderkey % 8 <> 3").select(F.col("o_orderkey").alias("id"), gross.alias("gross"), F.col("o_orderpriority").alias("currency"), psp.alias("psp"), ref.alias("order_ref"))


@query(
    "J15_reconciliation",
    f"""{RECONCILE} SELECT 'movement' AS side, m.id, CASE WHEN ok.did IS NOT NULL THEN 'confirmada' WHEN em.n IS NULL THEN 'sin_coincidencia' WHEN em.n = 1 AND ed.n = 1 THEN 'candidata' ELSE 'ambigua' END AS status, ok.did AS document, coalesce(em.n, 0) AS related
FROM m LEFT JOIN em ON em.mid = m.id LEFT JOIN ed ON ed.did = em.did LEFT JOIN ok ON ok.mid = m.id
UNION ALL SELECT 'document', d.id, CASE WHEN ok.mid IS NOT NULL THEN 'confirmada' WHEN ed.n IS NULL THEN 'sin_coincidencia' WHEN ed.n = 1 AND em.n = 1 THEN 'candidata' ELSE 'ambigua' END, ok.did, coalesce(ed.n, 0)
FROM d LEFT JOIN ed ON ed.did = d.id LEFT JOIN em ON em.mid = ed.mid LEFT JOIN ok ON ok.did = d.id""",
)
def _reconciliation(t: Tables) -> DataFrame:
    return reconcile(_movements(t), _documents(t))


ROWS = """WITH r AS (SELECT o_orderkey AS id, o_orderkey % 13 AS k, o_totalprice AS price, o_orderdate AS day FROM orders)"""


@query(
    "J15_row_errors",
    f"""{ROWS} SELECT CASE k WHEN 0 THEN 'cuenta_o_lote' WHEN 1 THEN 'tipo' WHEN 2 THEN 'neto_vacio' WHEN 3 THEN 'neto' WHEN 4 THEN 'bruto' WHEN 5 THEN 'moneda_original' WHEN 6 THEN 'bruto_vacio' WHEN 7 THEN 'moneda' WHEN 8 THEN 'fecha' END AS error,
  CAST(count(*) AS BIGINT) AS rows, sum(CASE WHEN k >= 9 THEN -CAST(price AS DECIMAL(18,2)) END) AS net, sum(CASE WHEN k >= 10 THEN CAST(price AS DECIMAL(18,2)) END) AS gross, min(CASE WHEN k >= 9 THEN CAST(day AS DATE) END) AS first FROM r GROUP BY 1""",
)
def _row_errors(t: Tables) -> DataFrame:
    """Rows that can't be read are told, each with its first fault."""
    k = F.col("o_orderkey") % 13
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    value = lambda bad, wrong, right: F.when(k == bad, wrong).otherwise(right)
    raw = t.orders.select(
        F.col("o_orderkey").alias("row"), value(0, " ", F.lit("A")).alias("account"), F.lit("1").alias("batch"), value(8, F.lit("soon"), F.date_format("o_orderdate", "dd/MM/yyyy")).alias("date"),
        value(1, F.lit("Settlement"), value(9, F.lit("Fee"), F.lit("Settled"))).alias("kind"), value(7, F.lit("EURO"), F.lit("eur")).alias("currency"), value(5, F.lit(""), F.lit("usd")).alias("original_currency"), F.lit("").alias("net_credit"),
        F.when(k == 2, F.lit(None)).when(k == 3, F.lit("1.000,00")).otherwise(F.replace(price, F.lit("."), F.lit(","))).alias("net_debit"), F.when(k == 4, F.lit("x")).when(k.isin(6, 9), F.lit(None)).otherwise(price).alias("gross_credit"),
        F.lit(None).cast("string").alias("gross_debit"), F.lit("p").alias("psp"), F.lit("").alias("order_ref"),
    )
    rows = movement_rows(raw)
    return rows.groupBy("error").agg(F.count("*").alias("rows"), F.sum("net").alias("net"), F.sum("gross").alias("gross"), F.min("booked").alias("first"))
