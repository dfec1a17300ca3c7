"""Found pages against the catalogue: identity, the automatic rule, and the rule over stored candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import with_check_digit
from ..operators import evidence
from ..operators.grid import tasks
from .registry import Tables, query

# Every line is a candidate page of its part at its supplier; eleven kinds of pages, competitors and answers by the line's own numbers.
GTIN = "{0} || CAST((10 - list_sum(list_transform(range(1, 13), lambda i: CAST({0}[i] AS BIGINT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10 AS VARCHAR)"
FOUND = f"""codes AS (SELECT p_partkey AS part, upper(replace(p_brand, '#', '')) AS brand, p_brand || ' M' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || 'X' AS told, {GTIN.format("lpad(CAST(p_partkey AS VARCHAR), 12, '0')")} AS ean, {GTIN.format("lpad(CAST(p_partkey + 1 AS VARCHAR), 12, '0')")} AS other FROM part),
base AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_orderkey AS run, l_partkey AS part, l_suppkey AS s, l_linenumber % 3 AS m, (l_orderkey + l_linenumber) % 11 AS k, CAST(l_quantity AS INTEGER) AS q, CASE WHEN l_returnflag = 'A' THEN 'candidate_found' WHEN l_returnflag = 'N' THEN 'pending_validation' WHEN l_linestatus = 'F' AND l_discount < 0.02 THEN 'discarded' WHEN l_discount > 0.08 THEN 'rejected' ELSE 'confirmed' END AS state, l_tax > 0.07 AND l_discount = 0 AS bad FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY l_returnflag, l_linestatus, l_quantity, l_discount, l_tax) = 1),
addressed AS (SELECT *, CASE WHEN q = 7 THEN 'x' ELSE '' END AS away FROM base),
facts AS (SELECT *, bool_or(q > 10) OVER (PARTITION BY run, part, s, m, away) AS fetched, bool_or(state = 'discarded') OVER u AS gone, count(*) FILTER (WHERE state = 'rejected') OVER u > CASE WHEN state = 'rejected' THEN 1 ELSE 0 END OR bool_or(bad) OVER u AS rejected FROM addressed WINDOW u AS (PARTITION BY part, s, m, away)),
found AS (SELECT f.*, c.*,
 CASE WHEN s % 7 = 0 OR s % 5 = 0 THEN 'Sin autorización comercial y robots.txt verificado' WHEN s % 11 = 1 THEN 'Competidor configurado solo para URLs conocidas' WHEN m = 0 AND s % 4 = 0 THEN 'Localización por sitemap no autorizada' WHEN m = 0 THEN NULL WHEN s % 3 = 0 THEN 'Búsqueda GET no verificada o no autorizada' WHEN m = 2 THEN 'Método «other» no autorizado' END AS refused,
 CASE WHEN k IN (2, 3, 4, 6, 7, 8) THEN 'probable' WHEN k IN (5, 9) THEN 'rejected' WHEN k < 10 THEN 'exact' END AS status, CASE k WHEN 0 THEN 'reference' WHEN 1 THEN 'ean' WHEN 10 THEN NULL ELSE '' END AS basis,
 CASE k WHEN 0 THEN 'Marca, modelo y código de color coinciden' WHEN 1 THEN 'EAN publicado idéntico; marca, modelo y código de color confirmados' WHEN 2 THEN 'EAN publicado distinto: ' || other || '; revisión manual obligatoria' WHEN 3 THEN 'EAN publicado no válido: no se aplica la excepción de calibre' WHEN 4 THEN 'Color no confirmado: catálogo 005, ficha desconocido'
  WHEN 5 THEN 'Distinto color: catálogo 005, ficha 005, 777' WHEN 6 THEN 'Identificación ambigua: requiere revisión; Varias referencias en título: ' || told || ' M999999X 005' WHEN 7 THEN 'Distinto color: catálogo 005, ficha 005, 006' WHEN 8 THEN 'Identificación ambigua: requiere revisión' WHEN 9 THEN 'Distinto marca: catálogo ' || brand || ', ficha ' || brand || ', OTHER' END AS why
 FROM facts f JOIN codes c USING (part)),
decided AS (SELECT *, refused IS NULL AND q <> 7 AND k < 2 AND q NOT IN (8, 9) AND fetched AND NOT gone AND NOT rejected AS confirm,
 concat_ws('; ', refused, CASE WHEN q = 7 THEN 'La URL no pertenece al dominio del competidor' END,
  CASE WHEN k = 10 THEN 'No hay evidencia analizada de la ficha' WHEN q = 8 THEN 'La ficha no se consultó directamente (solo una tarjeta de resultados de búsqueda)' WHEN NOT fetched THEN 'No consta una respuesta HTTP 2xx de la ficha en la ejecución registrada' END,
  CASE k WHEN 4 THEN 'La ficha no publica el código de color' WHEN 5 THEN 'Código de color distinto: catálogo 005, ficha 005, 777' WHEN 6 THEN 'Modelo no publicado en la ficha; La ficha no publica el código de color' WHEN 7 THEN 'Código de color distinto: catálogo 005, ficha 005, 006' WHEN 9 THEN 'Marca distinto: catálogo ' || brand || ', ficha ' || brand || ', OTHER' WHEN 2 THEN 'EAN publicado contradictorio: ficha ' || other || ', catálogo ' || ean END,
  CASE WHEN k < 10 AND (k = 8 OR q = 9) THEN 'Coincidencia ambigua o no exacta: requiere revisión manual' END, CASE WHEN k BETWEEN 2 AND 9 THEN why END, CASE WHEN gone THEN 'La URL fue descartada anteriormente' END, CASE WHEN rejected THEN 'La URL fue rechazada anteriormente por identidad' END) AS reasons FROM found)"""


def _lines(t: Tables) -> DataFrame:
    """Lines by order, number, part and supplier; of repeated ones the smallest.

    They are dealt and sorted by part, so a task reads alike pages of a part one after the
    other, and in as many tasks as asked for: reading makes more work than their few MB tell.
    """
    key = ("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")
    rows = t.lineitem.repartition(tasks(t.spark), "l_partkey").groupBy(*key).agg(F.min(F.struct("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax")).alias("line"))
    return rows.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), *key, "line.*")


def _found(t: Tables) -> DataFrame:
    line, part = _lines(t), t.part
    s, k, q, m = F.col("l_suppkey"), F.col("k"), F.col("l_quantity").cast("int"), F.col("m")
    code = lambda c: with_check_digit(F.lpad(c.cast("string"), 12, "0"))
    model = F.concat(F.lit("M"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit("X"))
    product = F.struct(code(F.col("p_partkey")).alias("ean"), F.col("p_brand").alias("brand"), model.alias("model"), F.lit("005").alias("color"), F.lit(None).cast("string").alias("caliber"))
    catalogue = part.select(F.col("p_partkey").alias("l_partkey"), product.alias("product"), code(F.col("p_partkey") + 1).alias("other"))
    rows = line.withColumns({"k": (F.col("l_orderkey") + F.col("l_linenumber")) % 11, "m": F.col("l_linenumber") % 3}).join(catalogue, "l_partkey")
    site = F.concat(F.lit("s"), s.cast("string"), F.lit(".example"))
    url = F.concat(F.lit("https://"), F.when(q == 7, F.lit("other.example/")).otherwise(F.concat(F.lit("www."), site, F.lit("/"))), s.cast("string"), F.lit("/"), F.col("l_partkey").cast("string"), F.lit("-"), m.cast("string"))
    told = F.concat("product.brand", F.lit(" "), "product.model")
    title = F.when(k == 4, told).when(k == 6, F.concat(told, F.lit(" M999999X 005"))).otherwise(F.concat(told, F.lit(" 005")))
    null = F.lit(None).cast("string")
    page = F.struct(
        F.when(k < 10, F.col("url")).alias("url"), null.alias("source_url"), title.alias("title"), F.when(k == 9, "Other").alias("brand"), null.alias("model"), F.when(k == 5, "777").alias("color"), null.alias("caliber"),
        F.when(k.isin(1, 7), F.col("product.ean")).when(k == 2, F.col("other")).when(k == 3, "123").alias("ean_published"), F.when(k == 7, F.array(F.concat("product.model", F.lit(" 006")))).alias("identifiers"), (k == 8).alias("ambiguous"), (k == 8).alias("offer_binding_unresolved"),
    )
    told_by = F.struct(F.col("url").alias("url"), F.when(q == 8, evidence.SEARCH_CARD_METHODS[0]).otherwise("page").alias("method"), F.when(q == 9, "probable").otherwise("exact").alias("state"), page.alias("page"))
    config = F.struct(
        site.alias("domain"), (s % 7 != 0).alias("terms_reviewed"), F.lit("revisado").alias("terms_note"), F.when(s % 5 == 0, "blocked").otherwise("robots_allowed").alias("access_status"), F.when(s % 11 == 1, "known").otherwise("auto").alias("search_mode"),
        F.when(s % 4 == 0, "site_search").otherwise("sitemap,site_search").alias("locate_strategy"), (s % 3 != 0).alias("search_verified"), F.lit("get").alias("search_preferred"), F.lit("").alias("search_alternatives"),
    )
    rows = rows.withColumn("url", url)
    return rows.select(
        "id", F.col("l_orderkey").alias("run_id"), s.alias("competitor_id"), F.col("product.ean").alias("ean"), "url", _state().alias("state"),
        F.when(m == 0, "sitemap").when(m == 1, "get").otherwise("other").alias("method"), "product", config.alias("config"), told_by.alias("evidence"),
        F.when(q > 10, "HTTP 200").otherwise("HTTP 404").alias("result"), ((F.col("l_tax") > 0.07) & (F.col("l_discount") == 0)).alias("bad"),
    )


def _state() -> Column:
    flag = F.col("l_returnflag")
    return (
        F.when(flag == "A", "candidate_found").when(flag == "N", "pending_validation").when((F.col("l_linestatus") == "F") & (F.col("l_discount") < 0.02), "discarded")
        .when(F.col("l_discount") > 0.08, "rejected").otherwise("confirmed")
    )


def decided(t: Tables) -> DataFrame:
    """``id, state, checks, reasons, confirm`` of all candidates. Pages are judged as the lines were dealt, then what was said of them meets the facts."""
    found = _found(t)
    known = found.where("bad").select("competitor_id", "ean", "url", F.lit("rejected").alias("status"))
    facts = evidence.address_facts(found.drop("result", "bad"), found.select("run_id", "competitor_id", "ean", "url", "result"), known)
    judged = evidence.judge(found.drop("result", "bad")).select("id", "state", "judged")
    return evidence.conclude(evidence.with_facts(judged, facts))


@query("F14_page_identity", f"WITH {FOUND} SELECT id, status, basis, why AS reasons FROM found")
def _identity(t: Tables) -> DataFrame:
    """what pages publish against the catalogue's brand, model, colour code and EAN."""
    rows = _found(t).select("id", "product", F.when(F.col("evidence.page.url").isNotNull(), F.col("evidence.page")).alias("page"))
    return evidence.compare(rows).select("id", "match.status", "match.basis", F.array_join("match.reasons", "; ").alias("reasons"))


@query("X3_all_checks", f"WITH {FOUND} SELECT id, reasons, confirm AS confirmed FROM decided")
def _checks(t: Tables) -> DataFrame:
    """Eight checks of every candidate, by its evidence, its competitor's settings and what is stored of its address."""
    return decided(t).select("id", F.array_join("reasons", "; ").alias("reasons"), F.col("confirm").alias("confirmed"))


@query(
    "X8_reevaluation",
    f"""WITH {FOUND} SELECT id, state AS previous_state, reasons, CASE WHEN confirm THEN 'would_confirm' ELSE 'manual_review' END AS dry_run, CASE WHEN NOT confirm THEN 'manual_review' WHEN run % 7 = 3 THEN 'skipped_changed' ELSE 'confirmed' END AS applied FROM decided WHERE state IN ('candidate_found', 'pending_validation')""",
)
def _reevaluation(t: Tables) -> DataFrame:
    """Both runs beside each other; meanwhile the candidates of runs ``% 7 = 3`` were reviewed."""
    rows = decided(t)
    states = _lines(t).select("id", F.when(F.col("l_orderkey") % 7 == 3, "confirmed").otherwise(_state()).alias("state"))
    applied = evidence.reevaluate(rows, states, "revisión de prueba")
    dry = F.when(F.col("result") == "manual_review", F.col("result")).otherwise("would_confirm")
    return applied.select("id", "previous_state", F.array_join("reasons", "; ").alias("reasons"), dry.alias("dry_run"), F.col("result").alias("applied"))
