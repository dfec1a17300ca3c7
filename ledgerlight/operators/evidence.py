"""Whether a found page is the product that was looked for, by what it publishes; nothing is asked for again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import page_allowed, same_site
from . import page_identity

#: The stored evidence of a candidate as JSON (fixed field names).
EVIDENCE = """url string, method string, state string, page struct<url string, source_url string, title string, brand string, model string, color string, caliber string,
ean_published string, identifiers array<string>, ambiguous boolean, offer_binding_unresolved boolean>"""

# The rule's name, methods that never ask for the page itself, checks in order, states that wait for a review.
RULE = "identidad_comercial_v1"
SEARCH_CARD_METHODS = ("web:edel-optics-search-card",)
CHECKS = ("metodo_autorizado", "dominio_competidor", "ficha_consultada", "marca_modelo_color_exactos", "ean_no_contradictorio", "sin_ambiguedad", "url_no_descartada", "url_no_rechazada")
UNREVIEWED = ("candidate_found", "pending_validation")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _given(*columns: Column) -> Column:
    return F.array_compact(F.array(*columns))


def _listed(values: Column) -> Column:
    return F.array_join(values, ", ")


def _or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("desconocido"))


def compare(candidates: DataFrame) -> DataFrame:
    """``candidates`` with ``match``: status (exact, probable, rejected), basis (ean, reference), reasons, observations, the keys that were published and the product's own.

    A candidate has ``id`` (unique), ``product`` (ean, brand, model, color, caliber) and
    ``page`` as in ``EVIDENCE``. Title and identifiers are read with the product's own
    brand and model; what differs from the catalogue contradicts it, what isn't
    published leaves the match probable unless the published EAN is the product's. An
    EAN of another product is never exact, a contradiction under the right EAN is
    probable, one without it is rejected. Calibres are told, they never decide. NULL
    fields are unpublished; without a page the match is NULL.

    Names under which a single brand sells a model aren't known. Pairs are judged in
    tasks (``page_identity``), so rows stay where they are.
    """
    page, product = F.col("page"), F.col("product")
    of_product = [product[n] for n in ("ean", "brand", "model", "color", "caliber")]
    of_page = [page[n] for n in ("title", "brand", "model", "color", "caliber", "ean_published", "ambiguous", "offer_binding_unresolved")]
    match = F.arrow_udf(page_identity.judged, page_identity.MATCH)
    return candidates.withColumn("match", match(page.isNotNull(), page["identifiers"], *of_product, *of_page))


def method_refusal(config: Column, method: Column) -> Column:
    """Why a way of finding pages isn't allowed by ``config`` (terms_reviewed, terms_note, access_status, search_mode, locate_strategy, search_verified, search_preferred, search_alternatives); empty if it is."""
    parts = lambda c: F.split(_text(c), ",")
    mode, way = F.coalesce(F.nullif(config["search_mode"], F.lit("")), F.lit("auto")), _text(method)
    open_ = _true(config["terms_reviewed"]) & (F.trim(_text(config["terms_note"])) != "") & (_text(config["access_status"]) == "robots_allowed")
    permitted = F.when(mode != "auto", F.array(mode)).otherwise(F.concat(F.array(_text(config["search_preferred"])), parts(config["search_alternatives"])))
    allowed = parts(config["locate_strategy"])
    return (
        F.when(~open_, "Sin autorización comercial y robots.txt verificado").when(mode == "known", "Competidor configurado solo para URLs conocidas")
        .when(way == "sitemap", F.when(F.array_contains(allowed, "sitemap"), "").otherwise("Localización por sitemap no autorizada"))
        .when(~_true(config["search_verified"]) | ~F.array_contains(allowed, "site_search"), "Búsqueda GET no verificada o no autorizada")
        .when((way != "") & F.array_contains(permitted, way), "").otherwise(F.concat(F.lit("Método «"), _or_unknown(way), F.lit("» no autorizado")))
    )


def address_facts(candidates: DataFrame, answers: DataFrame, known: DataFrame) -> DataFrame:
    """``id, fetched, discarded, rejected`` of ``candidates`` (id, run_id, competitor_id, ean, url, state, evidence) by stored rows alone; one without an address has no row.

    A candidate's addresses are its own, its evidence's and its page's. Fetched: its run
    had a 2xx answer for one (``answers``: run_id, competitor_id, ean, url, result).
    Discarded: any candidate of the pair with one of them was. Rejected: another
    candidate was, or a known page is (``known``: competitor_id, ean, url, status). Facts
    are reduced to distinct keys before they meet candidates.
    """
    pair = ["competitor_id", "ean", "url"]
    urls = F.array_distinct(F.filter(F.array("url", "evidence.url", "evidence.page.url"), lambda u: u != ""))
    asked = candidates.select("id", "run_id", "competitor_id", "ean", F.explode(urls).alias("url"))
    ok = answers.where(F.col("result").startswith("HTTP 2")).select("run_id", *pair).distinct().withColumn("ok", F.lit(True))
    # two rejected candidates reject each other: the smallest and the largest id tell whether there's another
    past = candidates.where(F.col("state").isin("discarded", "rejected")).groupBy(*pair).agg(
        F.bool_or(F.col("state") == "discarded").alias("gone"), F.min(F.when(F.col("state") == "rejected", F.col("id"))).alias("low"), F.max(F.when(F.col("state") == "rejected", F.col("id"))).alias("high"))
    bad = known.where("status = 'rejected'").select(*pair).distinct().withColumn("bad", F.lit(True))
    rows = asked.join(ok, ["run_id", *pair], "left").join(past, pair, "left").join(bad, pair, "left")
    other = (F.col("low") != F.col("id")) | (F.col("high") != F.col("id"))
    return rows.groupBy("id").agg(*[F.bool_or(_true(c)).alias(name) for name, c in (("fetched", F.col("ok")), ("discarded", F.col("gone")), ("rejected", other | _true(F.col("bad"))))])


def with_facts(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """``candidates`` with their ``address_facts``, false where there are none."""
    return candidates.join(facts, "id", "left").withColumns({c: _true(F.col(c)) for c in ("fetched", "discarded", "rejected")})


def stored_facts(candidates: DataFrame, answers: DataFrame, known: DataFrame) -> DataFrame:
    """``candidates`` with ``fetched``, ``discarded`` and ``rejected``."""
    return with_facts(candidates, address_facts(candidates, answers, known))


def decide(candidates: DataFrame) -> DataFrame:
    """Candidates with ``checks`` (each by its name), ``reasons`` and ``confirm``: every check is made, all must hold.

    A candidate has ``id, method, product, config`` (with ``domain``), ``evidence`` as in
    ``EVIDENCE`` and the facts ``fetched, discarded, rejected``; other columns stay, but
    ``page`` and ``match`` are made here. Brand, model and colour code must be published
    and be the catalogue's; an EAN may lack but never contradict. NULL evidence, or
    one without a page's address, is no page.
    """
    return conclude(judge(candidates))


def judge(candidates: DataFrame) -> DataFrame:
    """``decide`` as far as it needs no facts: ``page``, ``match`` and ``judged``, so that a candidate's few answers meet its facts and not its page."""
    rows = compare(candidates.withColumn("page", F.when(_text(F.col("evidence.page.url")) != "", F.col("evidence.page"))))
    page, match, product, e = F.col("page"), F.col("match"), F.col("product"), F.col("evidence")
    domain, has_page = _text(F.col("config.domain")), page.isNotNull()
    # columns of their own, as each is used several times
    rows = rows.withColumns({
        "_refused": method_refusal(F.col("config"), F.col("method")),
        "_in_domain": page_allowed(e["url"], domain) & (~has_page | same_site(page["url"], domain)),
    })
    visited = has_page & ~_text(e["method"]).isin(*SEARCH_CARD_METHODS) & (_text(page["source_url"]) == "")
    ean_ok = has_page & ((match["ean"] == "") | (match["ean"] == _text(product["ean"])))
    clear = has_page & ~_true(page["ambiguous"]) & (_text(e["state"]) == "exact")
    names = (("Marca", match["own_brand"], match["brands"], "Marca no publicado en la ficha"), ("Modelo", match["own_model"], match["models"], "Modelo no publicado en la ficha"), ("Código de color", match["own_color"], match["colors"], "La ficha no publica el código de color"))
    same = has_page & (match["status"] == "exact")
    for _, expected, found, _ in names:
        same = same & (expected != "") & (found == F.array(expected))
    when_page = lambda c: F.when(has_page, c)
    by_field = [
        when_page(F.when(e_ == "", f"{label} sin valor en el catálogo").when(F.size(f) == 0, absent).when(f != F.array(e_), F.concat(F.lit(f"{label} distinto: catálogo "), e_, F.lit(", ficha "), _listed(f)))) for label, e_, f, absent in names
    ]
    rows = rows.withColumns({
        "_head": _given(F.nullif(F.col("_refused"), F.lit("")), F.when(~F.col("_in_domain"), "La URL no pertenece al dominio del competidor")),
        "_unseen": F.when(~has_page, "No hay evidencia analizada de la ficha").when(~visited, "La ficha no se consultó directamente (solo una tarjeta de resultados de búsqueda)"),
        "_fields": _given(
            *by_field, when_page(F.when(~_true(ean_ok), F.concat(F.lit("EAN publicado contradictorio: ficha "), match["ean"], F.lit(", catálogo "), _text(product["ean"])))),
            when_page(F.when(~_true(clear), "Coincidencia ambigua o no exacta: requiere revisión manual")),
        ),
    })
    of_match = F.when(has_page & (match["status"] != "exact"), match["reasons"]).otherwise(F.array().cast("array<string>"))
    said = F.concat(F.col("_fields"), F.array_except(of_match, F.concat("_head", "_fields")))
    judged = F.struct(
        (F.col("_refused") == "").alias("allowed"), F.col("_in_domain").alias("in_domain"), visited.alias("visited"), same.alias("same"), ean_ok.alias("ean_ok"), clear.alias("clear"), F.col("_head").alias("head"), F.col("_unseen").alias("unseen"), said.alias("said")
    )
    return rows.select(*candidates.columns, *[c for c in ("page", "match") if c not in candidates.columns], judged.alias("judged"))


def conclude(judged: DataFrame) -> DataFrame:
    """``checks``, ``reasons`` and ``confirm`` of candidates that are ``judged``, by their facts ``fetched, discarded, rejected``."""
    j = F.col("judged")
    made = (j["allowed"], j["in_domain"], j["visited"] & F.col("fetched"), j["same"], j["ean_ok"], j["clear"], ~F.col("discarded"), ~F.col("rejected"))
    rows = judged.withColumn("checks", F.struct(*[_true(c).alias(name) for name, c in zip(CHECKS, made, strict=True)]))
    unseen = F.coalesce(j["unseen"], F.when(~F.col("fetched"), "No consta una respuesta HTTP 2xx de la ficha en la ejecución registrada"))
    last = _given(F.when(F.col("discarded"), "La URL fue descartada anteriormente"), F.when(F.col("rejected"), "La URL fue rechazada anteriormente por identidad"))
    confirm = F.lit(True)
    for name in CHECKS:
        confirm = confirm & F.col("checks")[name]
    return rows.withColumns({"reasons": F.concat(j["head"], _given(unseen), j["said"], last), "confirm": confirm}).drop("judged")


def reevaluate(decided: DataFrame, current: DataFrame | None = None, note: str = "") -> DataFrame:
    """The rule again over stored candidates that nobody has reviewed: ``id, previous_state, result, reasons``.

    Without ``current`` it is a dry run: ``would_confirm`` or ``manual_review``. With the
    states as they are now (id, state) it is applied: ``confirmed``, or
    ``skipped_changed`` where the state isn't what was judged or the row is gone; then
    ``note`` must say who asks and why.
    """
    if current is not None and not note.strip():
        raise ValueError("an applied re-evaluation needs a note")
    rows = decided.where(F.col("state").isin(*UNREVIEWED)).select("id", F.col("state").alias("previous_state"), "confirm", "reasons", "checks")
    if current is None:
        done = F.lit("would_confirm")
    else:
        rows = rows.join(current.select("id", F.col("state").alias("_now")), "id", "left")
        done = F.when(_true(F.col("_now") == F.col("previous_state")), "confirmed").otherwise("skipped_changed")
    return rows.select("id", "previous_state", F.when(F.col("confirm"), done).otherwise("manual_review").alias("result"), "reasons", "checks")


def audit_rows(results: DataFrame, batch: Column, note: str) -> DataFrame:
    """A row for each re-evaluated candidate, for the append-only log: batch, rule, states, reasons and checks as JSON, note."""
    said = F.to_json(F.struct("reasons", "checks"))
    return results.select(batch.alias("batch"), F.col("id").alias("candidate_id"), F.lit(RULE).alias("rule"), "previous_state", "result", said.alias("reasons"), F.lit(note.strip()).alias("note"))
