"""Identity and the automatic rule against loops over random pages."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_references import KEY, MODEL, by_loop

from ledgerlight import plans
from ledgerlight.functions import urls
from ledgerlight.operators import evidence as ev
from ledgerlight.operators import page_identity

BRAND = lambda s: {"TIFFANY": "TIFFANYCO"}.get(KEY(s or ""), KEY(s or ""))
PRODUCT = "struct<ean string, brand string, model string, color string, caliber string>"
CONFIG = "struct<domain string, terms_reviewed boolean, terms_note string, access_status string, search_mode string, locate_strategy string, search_verified boolean, search_preferred string, search_alternatives string>"
SCHEMA = f"id long, method string, product {PRODUCT}, config {CONFIG}, evidence struct<{ev.EVIDENCE}>, fetched boolean, discarded boolean, rejected boolean, state string"


def gtin(text):
    text = (text or "").strip()
    if not re.fullmatch("[0-9]{12,13}", text):
        return ""
    total = sum(int(d) * (3 if i % 2 else 1) for i, d in enumerate(reversed(text)))
    return text.zfill(13) if total % 10 == 0 else ""


def sizes(text):
    m = re.search("(?<![0-9])([0-9]{2})[-/ ]([0-9]{2})(?![0-9])", text or "")
    return f"{m[1]}-{m[2]}" if m else text if re.fullmatch("[0-9]{2}", text or "") else ""


def compared(a, b):
    if not a or not b:
        return "unknown"
    (al, _, ab), (bl, _, bb) = a.partition("-"), b.partition("-")
    return "different" if al != bl or (ab and bb and ab != bb) else "equal"


def same_product(product, page):
    """status, basis, reasons, brands, models, colours, calibre state."""
    brand, model, colour = BRAND(product["brand"]), MODEL(product["model"] or ""), KEY(product["color"] or "")
    texts = [page["title"] or "", *(page["identifiers"] or [])]
    refs = [by_loop(t, [product["brand"]] if product["brand"] else [], [product["model"]] if product["model"] else []) for t in texts]
    published = (page["ean_published"] or "").strip()
    ean = gtin(published)
    verified = bool(ean) and ean == gtin(product["ean"])
    brands, models, colours, calibers = set(), set(), set(), set()
    for n, (b, m, c, lens, _) in enumerate(refs):
        m, c = m or "", c or ""
        if b:
            brands.add(BRAND(b))
        if lens:
            calibers.add(lens)
        coded = re.fullmatch("0?[A-Z]{1,4}_[A-Z0-9]+?([0-9]{2})([0-9]{2})", texts[n].upper()) if n else None
        if coded and not (38 <= int(coded[1]) <= 66 and 10 <= int(coded[2]) <= 26):
            coded = None
        if not (n == 0 or MODEL(m) == model or (c and re.search("[A-Za-z]", m) and re.search("[0-9]", m) and not coded)):
            continue
        if MODEL(m) and (MODEL(m) == model or re.search("[0-9]", m)):
            models.add(MODEL(m))
        if re.search("[0-9]", c):
            colours.add(KEY(c))
    if page["brand"]:
        brands.add(BRAND(page["brand"]))
    if page["model"]:
        models.add(MODEL(page["model"]))
    if re.search("[0-9]", page["color"] or ""):
        colours.add(KEY(page["color"]))
    words = lambda t: " " + " ".join(re.findall("[A-Z0-9]+", (t or "").upper())) + " "
    if words(product["brand"]).strip() and words(product["brand"]) in words(page["title"]):
        brands.add(brand)
    if sizes(page["caliber"]):
        calibers.add(sizes(page["caliber"]))
    caliber = compared(sizes(product["caliber"]), sizes(page["caliber"]) or (sorted(calibers)[0] if calibers else ""))
    found = (sorted(brands), sorted(models), sorted(colours), caliber)
    reasons = ["EAN publicado no válido: no se aplica la excepción de calibre"] if published and not ean else []
    doubtful = any(r[4] for r in refs)
    unclear = ["Identificación ambigua: requiere revisión"] + [f"Varias referencias en {'título' if n == 0 else f'identificador {n}'}: {texts[n]}" for n, r in enumerate(refs) if r[4]]
    ambiguous = page["ambiguous"] or doubtful
    if ambiguous and (not page["offer_binding_unresolved"] or doubtful):
        return ("probable", "", reasons + unclear, *found)
    fields = [("marca", brand, brands), ("modelo", model, models), ("color", colour, colours)]
    contradicts = any(f and f != {e} for _, e, f in fields)
    for name, expected, f in fields:
        if f and f != {expected}:
            reasons.append(f"Distinto {name}: catálogo {expected or 'desconocido'}, ficha {', '.join(sorted(f))}")
        elif not verified and (not expected or not f):
            reasons.append(f"{name.capitalize()} no confirmado: catálogo {expected or 'desconocido'}, ficha {', '.join(sorted(f)) or 'desconocido'}")
    if ean and not verified:
        return ("rejected" if contradicts else "probable", "", [f"EAN publicado distinto: {ean}; revisión manual obligatoria", *reasons], *found)
    if contradicts:
        return ("probable" if verified else "rejected", "", reasons, *found)
    if ambiguous:
        return ("probable", "", reasons + unclear, *found)
    if reasons:
        return ("probable", "", reasons, *found)
    if verified:
        return ("exact", "ean", ["EAN publicado idéntico; marca, modelo y código de color confirmados"], *found)
    return ("exact", "reference", ["Marca, modelo y código de color coinciden"], *found)


def decided(row):
    """The failed checks by number, and the reasons."""
    c, e, failed, reasons = row["config"], row["evidence"], set(), []

    def fail(n, reason):
        failed.add(n)
        if reason:
            reasons.append(reason)

    mode, strategy = c["search_mode"] or "auto", (c["locate_strategy"] or "").split(",")
    permitted = {mode} if mode != "auto" else {c["search_preferred"] or "", *(c["search_alternatives"] or "").split(",")}
    if not c["terms_reviewed"] or not (c["terms_note"] or "").strip() or c["access_status"] != "robots_allowed":
        fail(0, "Sin autorización comercial y robots.txt verificado")
    elif mode == "known":
        fail(0, "Competidor configurado solo para URLs conocidas")
    elif row["method"] == "sitemap":
        if "sitemap" not in strategy:
            fail(0, "Localización por sitemap no autorizada")
    elif not c["search_verified"] or "site_search" not in strategy:
        fail(0, "Búsqueda GET no verificada o no autorizada")
    elif not row["method"] or row["method"] not in permitted:
        fail(0, f"Método «{row['method'] or 'desconocido'}» no autorizado")
    page = e["page"] if e["page"] and e["page"]["url"] else None
    good = ("https://s.es/p", "https://www.s.es/p#x", "https://tienda.s.es:443/p")
    if e["url"] not in good or (page and page["url"] not in (*good, "http://s.es/q")):
        fail(1, "La URL no pertenece al dominio del competidor")
    visited = page and e["method"] not in ev.SEARCH_CARD_METHODS and not page["source_url"]
    if not page:
        fail(2, "No hay evidencia analizada de la ficha")
    elif not visited:
        fail(2, "La ficha no se consultó directamente (solo una tarjeta de resultados de búsqueda)")
    elif not row["fetched"]:
        fail(2, "No consta una respuesta HTTP 2xx de la ficha en la ejecución registrada")
    if page:
        p = row["product"]
        status, _, why, *found, _ = same_product(p, page)
        if status != "exact":
            fail(3, None)
        for label, expected, f, absent in (("Marca", KEY(p["brand"] or ""), found[0], "Marca no publicado en la ficha"), ("Modelo", MODEL(p["model"] or ""), found[1], "Modelo no publicado en la ficha"), ("Código de color", KEY(p["color"] or ""), found[2], "La ficha no publica el código de color")):
            if not expected:
                fail(3, f"{label} sin valor en el catálogo")
            elif not f:
                fail(3, absent)
            elif f != [expected]:
                fail(3, f"{label} distinto: catálogo {expected}, ficha {', '.join(f)}")
        if gtin(page["ean_published"]) not in ("", p["ean"] or ""):
            fail(4, f"EAN publicado contradictorio: ficha {gtin(page['ean_published'])}, catálogo {p['ean'] or ''}")
        if page["ambiguous"] or e["state"] != "exact":
            fail(5, "Coincidencia ambigua o no exacta: requiere revisión manual")
        if status != "exact":
            reasons += [r for r in why if r not in reasons]
    else:
        failed |= {3, 4, 5}
    if row["discarded"]:
        fail(6, "La URL fue descartada anteriormente")
    if row["rejected"]:
        fail(7, "La URL fue rechazada anteriormente por identidad")
    return failed, reasons


def random_rows(n, seed=11):
    rng = random.Random(seed)
    often = lambda usual, *others: usual if rng.random() < 0.75 else rng.choice(others)
    rows = []
    for i in range(n):
        brand, model, colour = rng.choice([("Ray-Ban", "RB2140", "901"), ("Tom Ford", "FT1044", "01A"), ("Tiffany & Co", "TF 4120", "8055"), ("D&G", "AB12", "C3")])
        product = {"ean": often("8056597625302", None, "", "12"), "brand": often(brand, None, ""), "model": often(model, None, ""), "color": often(colour, None, ""), "caliber": often("54-21", None, "54", "49-20")}
        pieces = [often(brand, "", brand.upper(), "Gucci"), often(model, "", model.lower(), "RB9999", f"{model} {model}"), often(colour, "", "777", "negro")]
        identifiers = rng.choice([None, [], [], [f"{model} {colour}"], [f"{model} 005", None], ["0PR_27ZS16K08Z5421"], ["ref 12", f"X{model} 3"], [f"{model}-{colour}", f"{model} RB1111 1"]])
        page = {
            "url": often("https://s.es/p", "", None, "http://s.es/q", "https://otra.es/p"), "source_url": often("", None, "https://s.es/l"), "title": often(" ".join(pieces), None, ""), "brand": often(brand, None, "", "Otra"),
            "model": often("", model, None, "ZZ9"), "color": often("", colour, None, "negro", "9"), "caliber": often("", None, "54-21", "50", "50/20", "x"),
            "ean_published": often("", None, "8056597625302", "4006381333931", "123", " 8056597625302 "), "identifiers": identifiers, "ambiguous": often(False, None, True), "offer_binding_unresolved": often(False, None, True),
        }
        config = {
            "domain": often("s.es", "otra.es") if rng.random() < 0.2 else "s.es", "terms_reviewed": often(True, None, False), "terms_note": often("ok", "", " ", None), "access_status": often("robots_allowed", "blocked", None), "search_mode": often("auto", "known", "get", None, ""),
            "locate_strategy": often("sitemap,site_search", "sitemap", "site_search", None), "search_verified": often(True, False, None), "search_preferred": often("get", "", None), "search_alternatives": often("json,html", None, ""),
        }
        config["domain"] = "s.es"
        evidence = {"url": often("https://s.es/p", "https://www.s.es/p#x", "https://tienda.s.es:443/p", "http://s.es/p", "https://u@s.es/p", "https://s.es:8443/p", "https://xs.es/p", "https://10.0.0.1/p", "", None, "https://s.es/a b"), "method": often("page", *ev.SEARCH_CARD_METHODS, None), "state": often("exact", "probable", None), "page": often(page, None)}
        rows.append({"id": i, "method": rng.choice(["sitemap", "get", "json", "other", "", None]), "product": product, "config": config, "evidence": evidence, "fetched": often(True, False), "discarded": often(False, True), "rejected": often(False, True), "state": rng.choice(["candidate_found", "pending_validation", "discarded", "confirmed"])})
    return rows


@pytest.fixture(scope="module")
def judged(spark):
    rows = random_rows(1200)
    frame = ev.decide(spark.createDataFrame([tuple(r[c] for c in ("id", "method", "product", "config", "evidence", "fetched", "discarded", "rejected", "state")) for r in rows], SCHEMA).repartition(3))
    return rows, {r.id: r for r in frame.collect()}


def test_identity_against_the_loop(judged):
    rows, got = judged
    seen = set()
    for row in rows:
        page, match = row["evidence"]["page"], got[row["id"]].match
        if not page or not page["url"]:
            assert match is None
            continue
        page = {**page, "identifiers": [i for i in page["identifiers"] or [] if i is not None]}
        want = same_product(row["product"], page)
        assert (match.status, match.basis, match.reasons, match.brands, match.models, match.colors, match.caliber_comparison) == want, row
        seen.add(want[:2] + (want[2][0][:14],))
    assert len(seen) >= 9, seen


def test_checks_and_reasons_against_the_loop(judged):
    rows, got = judged
    failures = set()
    for row in rows:
        if row["evidence"]["page"]:
            row = {**row, "evidence": {**row["evidence"], "page": {**row["evidence"]["page"], "identifiers": [i for i in row["evidence"]["page"]["identifiers"] or [] if i is not None]}}}
        failed, reasons = decided(row)
        r = got[row["id"]]
        assert {n for n, name in enumerate(ev.CHECKS) if not r.checks[name]} == failed, row
        assert r.reasons == reasons and r.confirm == (not failed), row
        failures |= failed
    assert failures == set(range(8))


def test_all_checks_hold(spark):
    row = random_rows(1)[0]
    row |= {"method": "sitemap", "product": {"ean": "8056597625302", "brand": "Ray-Ban", "model": "RB2140", "color": "901", "caliber": "54-21"}, "fetched": True, "discarded": False, "rejected": False, "state": "candidate_found"}
    row["config"] = {"domain": "s.es", "terms_reviewed": True, "terms_note": "x", "access_status": "robots_allowed", "search_mode": None, "locate_strategy": "sitemap", "search_verified": None, "search_preferred": None, "search_alternatives": None}
    row["evidence"] = {"url": "https://s.es/p", "method": None, "state": "exact", "page": {"url": "https://s.es/p", "title": "RAY BAN RB2140 901", "caliber": "50-20", "ean_published": "8056597625302"}}
    frame = spark.createDataFrame([tuple(row[c] for c in ("id", "method", "product", "config", "evidence", "fetched", "discarded", "rejected", "state"))], SCHEMA)
    got = ev.decide(frame).first()
    assert got.confirm and got.reasons == [] and got.match.basis == "ean" and got.match.observations[0].endswith("ficha 50-20 (different)")
    assert ev.reevaluate(ev.decide(frame)).first().result == "would_confirm"
    assert ev.reevaluate(ev.decide(frame), frame.select("id", "state"), "who").first().result == "confirmed"
    assert ev.reevaluate(ev.decide(frame), frame.select("id", F.lit("confirmed").alias("state")), "who").first().result == "skipped_changed"
    assert ev.reevaluate(ev.decide(frame), frame.select("id", "state").limit(0), "who").first().result == "skipped_changed"
    with pytest.raises(ValueError):
        ev.reevaluate(ev.decide(frame), frame.select("id", "state"), " ")
    said = ev.audit_rows(ev.reevaluate(ev.decide(frame)), F.lit("b1"), " who ").first()
    assert said.note == "who" and '"metodo_autorizado":true' in said.reasons
    assert ev.decide(frame.limit(0)).count() == 0
    stored = frame.withColumn("evidence", F.from_json(F.to_json("evidence"), ev.EVIDENCE))
    assert ev.decide(stored).first().confirm and not ev.decide(frame.withColumn("evidence", F.from_json(F.lit("{no"), ev.EVIDENCE))).first().confirm


def test_stored_facts(spark):
    evidence = lambda url, page: (url, None, None, {"url": page} if page else None)
    rows = [(1, 7, 1, "e", "a", "candidate_found", evidence("b", "c")), (2, 7, 1, "e", "b", "rejected", None), (3, 7, 2, "e", "a", "rejected", None), (4, 8, 1, "f", "x", "discarded", None), (5, 8, 1, "f", "y", "candidate_found", evidence("x", "")), (6, 8, 1, "g", None, "candidate_found", None), (7, 9, 1, "h", "k", "candidate_found", None)]
    candidates = spark.createDataFrame(rows, f"id long, run_id long, competitor_id long, ean string, url string, state string, evidence struct<{ev.EVIDENCE}>")
    answers = spark.createDataFrame([(7, 1, "e", "c", "HTTP 200"), (8, 1, "e", "a", "HTTP 200"), (8, 1, "f", "y", "HTTP 404"), (8, 1, "f", "x", "HTTP 204")], "run_id long, competitor_id long, ean string, url string, result string")
    known = spark.createDataFrame([(1, "h", "k", "rejected"), (1, "f", "x", "verified")], "competitor_id long, ean string, url string, status string")
    got = {r.id: (r.fetched, r.discarded, r.rejected) for r in ev.stored_facts(candidates, answers, known).collect()}
    # the second is rejected itself, by no other one
    assert got == {1: (True, False, True), 2: (False, False, False), 3: (False, False, False), 4: (True, True, False), 5: (True, True, False), 6: (False, False, False), 7: (False, False, True)}


def test_addresses(spark):
    good = ["https://s.es", "HTTPS://WWW.S.ES/a?b", " https://a.b.s.es/ ", "https://s.es:443/x", "https://s.es:/x"]
    bad = [None, "", "s.es", "http://s.es", "https://s.es.com", "https://xs.es", "https://s.es:80", "https://a@s.es", "https://1.2.3.4", "https://s.es/a b", "https://s.es/" + "a" * 500, "https://[::1]/", "ftp://s.es"]
    got = spark.createDataFrame([(u,) for u in good + bad], "u string").select(urls.page_allowed(F.col("u"), F.lit("s.es")).alias("ok")).collect()
    assert [r.ok for r in got] == [True] * len(good) + [False] * len(bad)


def test_identity_is_judged_where_rows_are(spark, data):
    """Pages aren't taken apart and put together again: lines are dealt once, by part."""
    plan = plans.QUERIES["F14_page_identity"](spark, data)._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [line for line in plan if "Generate" in line or "collect_set" in line]
    assert ["REPARTITION_BY_NUM" in line for line in plan if " Exchange" in line] == [True]


def test_rows_that_are_the_same_in_all_columns():
    rng = random.Random(2)
    rows = [tuple(rng.choice([None, "a", "b", f"x{i % 40}"]) for _ in range(12)) for i in range(400)] * 2
    first, kind = page_identity._alike([pa.array(c, pa.string()) for c in zip(*rows)])
    assert [rows[first[k]] for k in kind] == rows and len(first) == len(set(rows))
    first, kind = page_identity._alike([pa.array([], pa.string())])
    assert len(first) == len(kind) == 0


def test_pages_are_judged_before_their_facts_come(spark, data):
    for name in ("X3_all_checks", "X8_reevaluation"):
        plan = plans.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString().splitlines()
        first = lambda what: next(n for n, line in enumerate(plan) if what in line)  # noqa: B023, E731
        assert first("Join ") < first("ArrowEvalPython"), name  # from the last step down to the scans
