"""What a page publishes against its product, read in tasks: every distinct pair of a batch is judged once.

The same rules as columns needed hundreds of interpreted array functions a row, a shuffle
of a page's texts and another of the pages. Patterns are those of ``functions.codes`` and
``functions.text``.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from ..functions.text import FOLDED
from .references import BRAND_ALIASES, COLLECTION

MATCH = """status string, basis string, reasons array<string>, observations array<string>, ean string, verified_ean boolean,
brands array<string>, models array<string>, colors array<string>, calibers array<string>, caliber_comparison string, own_brand string, own_model string, own_color string"""
_TYPE = pa.struct([
    *[(n, pa.string()) for n in ("status", "basis")], *[(n, pa.list_(pa.string())) for n in ("reasons", "observations")], ("ean", pa.string()), ("verified_ean", pa.bool_()),
    *[(n, pa.list_(pa.string())) for n in ("brands", "models", "colors", "calibers")], *[(n, pa.string()) for n in ("caliber_comparison", "own_brand", "own_model", "own_color")],
])

#: Texts of which a task remembers what they tell, and the longest (in characters) of which it does.
REMEMBERED, LONGEST = 4096, 2000

_END = r"(?:\r\n|[\n\r\x85\u2028\u2029])?\Z"  # the end as Java's $ has it
_TABLE = str.maketrans(FOLDED)
_OTHER = re.compile("[^A-Z0-9]+")
_CALIBER = re.compile(r"(?<![0-9])([0-9]{2})\s*[□×xX/\-\s]\s*([0-9]{2})(?![0-9])", re.ASCII)
_BARE = re.compile(r"(?<![0-9])[0-9]{2}\s*[xX/\-\s]\s*[0-9]{2}(?![0-9])", re.ASCII)
_SLASH = re.compile("(?<=[0-9])/(?=[0-9])")
_TWO = re.compile("[0-9]{2}" + _END)
_CODE = re.compile("0?[A-Z]{1,4}_[A-Z0-9]+?([0-9]{4})" + _END)
_FT_S, _FT, _KIND = re.compile("FT[0-9]{4}S"), re.compile("FT[0-9]{4}"), re.compile("[A-Z]+(?=[0-9])")
_CODES = {kind: re.compile(rf"\b{kind}\s*[0-9]+[A-Z]*\b", re.ASCII) for kind in ("RB", "FT")}
_OF_KIND = {kind: re.compile(f"{kind}[0-9]+[A-Z]*") for kind in ("RB", "FT")}
_DIGIT, _LETTER, _DIGITS = re.compile("[0-9]"), re.compile("[A-Za-z]"), re.compile("[0-9]+")


def _fold(text: str) -> str:
    return text if text.isascii() else text.translate(_TABLE).encode("ascii", "ignore").decode()


def _tokens(text: str) -> list[str]:
    return [w for w in _OTHER.split(_fold(text).upper()) if w]


def _model_of(key: str) -> str:
    return key[:6] if _FT_S.fullmatch(key) else key


@lru_cache(REMEMBERED)
def _key(text: str | None) -> str:
    return _OTHER.sub("", _fold(text or "").upper())


def _brand(text: str | None) -> str:
    key = _key(text)
    return BRAND_ALIASES.get(key, key)


def _model(text: str | None) -> str:
    return _model_of(_key(text))


def _caliber(text: str) -> str | None:
    m = _CALIBER.search(text)
    return f"{m[1]}-{m[2]}" if m else None


def _plausible(caliber: str | None) -> str | None:
    return caliber if caliber and 38 <= int(caliber[:2]) <= 66 and 10 <= int(caliber[3:]) <= 26 else None


def _lens_or_caliber(text: str | None) -> str | None:
    if text is None:
        return None
    bare = text.strip(" ")
    return _caliber(text) or (bare if _TWO.match(bare) else None)


def _caliber_of_code(name: str) -> str | None:
    m = _CODE.match(name.strip(" ").upper())
    return _plausible(f"{m[1][:2]}-{m[1][2:]}") if m else None


def _compared(a: str | None, b: str | None) -> str:
    if a is None or b is None:
        return "unknown"
    (lens, _, bridge), (lens_b, _, bridge_b) = a.partition("-"), b.partition("-")
    return "different" if lens != lens_b or (bridge and bridge_b and bridge != bridge_b) else "equal"


def _gtin(text: str | None) -> str | None:
    code = (text or "").strip(" ")
    if len(code) not in (12, 13) or not _DIGITS.fullmatch(code):
        return None
    return code.rjust(13, "0") if (sum(map(int, code[::-2])) + 3 * sum(map(int, code[-2::-2]))) % 10 == 0 else None


def _hits(words: list[str], key: str) -> list[tuple[int, int]]:
    """Stretches of words that are the model, joined; a key may have lost a letter."""
    found, most = [], len(key) + 1
    for start in range(len(words)):
        text = ""
        for end in range(start, len(words)):
            text += words[end]
            if len(text) > most:
                break
            if _model_of(text) == key:
                found.append((start, end + 1))
    return found


def _behind(words: list[str], key: str, start: int, end: int) -> tuple[str, str | None, bool, bool, bool]:
    """What stands behind a model: colour, lens, whether it's optical, whether another reference follows at once or the same one again."""
    following = _model_of("".join(words[end : end + end - start]))
    kind = _KIND.match(key)
    code = bool(kind and following.startswith(kind[0]) and re.fullmatch("[0-9]+[A-Z]*", following[len(kind[0]) :]))
    at = end + (1 if end < len(words) and words[end] == "S" and _FT.fullmatch(key) else 0)
    optical = at < len(words) and words[at] == "OPT"
    parts, lens = [], None
    for w in words[at + optical :]:
        if parts and len(w) == 2 and w.isdigit() and 38 <= int(w) <= 66:
            lens = w
            break
        if not _DIGIT.search(w):
            break
        parts.append(w)
    return " ".join(parts), lens, optical, code and following != key, code and following == key


def _reference(name: str, own_brand: str | None, own_model: str | None) -> tuple[str | None, str | None, str | None, str | None, bool]:
    """brand, model, colour, caliber and whether it's ambiguous, of a text by a dictionary of one brand and one model."""
    folded = _fold(name)
    caliber = _plausible(_caliber(folded))
    words = [w for w in _OTHER.split(_SLASH.sub("", _BARE.sub(" ", folded) if caliber else folded).upper()) if w]
    key, model_key = _brand(own_brand), _model(own_model)
    width, text = 0, ""
    for end, w in enumerate(words if key else [], 1):  # a brand's alias may be shorter than its key
        text += w
        if len(text) > len(key) + 2:
            break
        if BRAND_ALIASES.get(text, text) == key:
            width = end
    words = words[width:]
    if words and words[0] in COLLECTION:
        words = words[1:]
    read = [(start, *_behind(words, model_key, start, end)) for start, end in _hits(words, model_key)] if model_key else []
    clash = any(other for _, _, _, _, other, _ in read)
    for kind, pattern in _CODES.items():
        if read and _OF_KIND[kind].fullmatch(model_key):
            codes = {_model_of(c.replace(" ", "")) for c in pattern.findall(" ".join(words))}
            clash = clash or (model_key in codes and len(codes) > 1)
    read = [r for r in read if not r[4] and not r[5]]
    ambiguous = clash or len({r[1].replace(" ", "") for r in read}) > 1
    best = min(read, key=lambda r: r[0]) if read else None
    lens = best[2] if best and not ambiguous else None
    if ambiguous:
        model = colour = None
    elif best:
        model, colour = own_model + (" OPT" if best[3] else ""), best[1]
    elif len(words) >= 2:
        model, colour = " ".join(words[:-1]), words[-1]
    else:
        model, colour = words[0] if words else None, None
    return own_brand if width else None, model, colour, caliber or lens, ambiguous


_reference_known = lru_cache(REMEMBERED)(_reference)


def _published(brand: str | None, model: str | None, texts: tuple[str, ...]) -> tuple[set[str], set[str], set[str], set[str], list[tuple[int, str]]]:
    """Brands, models, colours and calibres that a page's title and identifiers tell, and those of them that are ambiguous."""
    own_key = _model(model)
    brands, models, colours, calibers, doubtful = set(), set(), set(), set(), []
    for place, name in enumerate(texts):
        of_brand, told, code, caliber, ambiguous = (_reference_known if len(name) <= LONGEST else _reference)(name, brand, model)
        key, colour = _model(told), _key(code)
        own, numbered = key == own_key, bool(told and _DIGIT.search(told))
        if place == 0 or own or (colour and numbered and _LETTER.search(told) and _caliber_of_code(name) is None):
            if key and (own or numbered):
                models.add(key)
            if code and _DIGIT.search(code):
                colours.add(colour)
        if _brand(of_brand):
            brands.add(_brand(of_brand))
        if _lens_or_caliber(caliber):
            calibers.add(_lens_or_caliber(caliber))
        if ambiguous:
            doubtful.append((place, name))
    return brands, models, colours, calibers, doubtful


def _or_unknown(text: str | None) -> str:
    return text or "desconocido"


def judge(product: tuple, page: tuple) -> tuple:
    """the fields of ``MATCH`` for a product (ean, brand, model, color, caliber) and a page (title, brand, model, color, caliber, ean_published, identifiers, ambiguous, offer_binding_unresolved)."""
    own_ean, brand, model, color, own_size = product
    title, page_brand, page_model, page_color, page_size, published, identifiers, unclear_page, unresolved = page
    own_brand, own_model, own_color = _brand(brand), _model(model), _key(color)
    texts = (title or "", *[t for t in identifiers or () if t is not None])
    brands, models, colors, calibers, doubtful = _published(brand, model, texts)
    if page_brand:
        brands.add(_brand(page_brand))
    words = " ".join(_tokens(brand or ""))
    if words and f" {words} " in f" {' '.join(_tokens(title or ''))} ":
        brands.add(own_brand)
    if page_model:
        models.add(_model(page_model))
    if page_color and _DIGIT.search(page_color):
        colors.add(_key(page_color))
    told_caliber, own_caliber = _lens_or_caliber(page_size), _lens_or_caliber(own_size)
    if told_caliber is not None:
        calibers.add(told_caliber)
    brands, models, colors, calibers = sorted(brands), sorted(models), sorted(colors), sorted(calibers)

    published = (published or "").strip(" ")
    ean, own = _gtin(published), _gtin(own_ean)
    verified = ean is not None and ean == own
    names = (("Marca", own_brand, brands), ("Modelo", own_model, models), ("Color", own_color, colors))
    contradicts = any(found and found != [expected] for _, expected, found in names)
    seen = told_caliber if told_caliber is not None else calibers[0] if calibers else None
    state = _compared(own_caliber, seen)
    open_ = ["EAN publicado no válido: no se aplica la excepción de calibre"] if published and ean is None else []
    invalid, fields = list(open_), []
    for name, expected, found in names:
        if found and found != [expected]:
            fields.append(f"Distinto {name.lower()}: catálogo {_or_unknown(expected)}, ficha {', '.join(found)}")
        elif not verified and (not expected or not found):
            fields.append(f"{name} no confirmado: catálogo {_or_unknown(expected)}, ficha {_or_unknown(', '.join(found))}")
    open_ += fields
    unclear = ["Identificación ambigua: requiere revisión", *[f"Varias referencias en {f'identificador {place}' if place else 'título'}: {name}" for place, name in doubtful]]
    ambiguous, basis = bool(unclear_page) or bool(doubtful), ""
    if ambiguous and (not unresolved or doubtful):
        status, reasons = "probable", invalid + unclear
    elif ean is not None and not verified:
        status, reasons = "rejected" if contradicts else "probable", [f"EAN publicado distinto: {ean}; revisión manual obligatoria", *fields]
    elif contradicts:
        status, reasons = "probable" if verified else "rejected", open_
    elif ambiguous:
        status, reasons = "probable", open_ + unclear
    elif open_:
        status, reasons = "probable", open_
    elif verified:
        status, basis, reasons = "exact", "ean", ["EAN publicado idéntico; marca, modelo y código de color confirmados"]
    else:
        status, basis, reasons = "exact", "reference", ["Marca, modelo y código de color coinciden"]
    observations = []
    if verified and state != "equal":
        observations.append(f"Calibre informativo por EAN publicado idéntico: catálogo {_or_unknown(own_caliber)}, ficha {_or_unknown(seen)} ({state})")
    if verified and any(_compared(a, b) == "different" for a in calibers for b in calibers):
        observations.append("Calibre informativo: medidas publicadas contradictorias")
    return status, basis, reasons, observations, ean or "", verified, brands, models, colors, calibers, state, _key(brand), own_model, own_color


def _alike(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """The first of each kind of rows that are the same in all columns, and each row's kind."""
    kind, kinds = np.zeros(len(columns[0]), np.int64), 1
    for c in columns:
        told = c.dictionary_encode(null_encoding="encode")
        kind, kinds = kind * len(told.dictionary) + told.indices.to_numpy(zero_copy_only=False), kinds * len(told.dictionary)
        if kinds > 1 << 31:
            kind = np.unique(kind, return_inverse=True)[1].astype(np.int64)
            kinds = len(kind)
    _, first, kind = np.unique(kind, return_index=True, return_inverse=True)
    return first, kind


def judged(given: pa.Array, identifiers: pa.Array, *fields: pa.Array) -> pa.Array:
    """``MATCH`` of each row: whether there's a page, its identifiers, then the other fields of product and page in the order of ``judge``; NULL without a page."""
    lists: dict[tuple | None, int] = {}
    told = pa.array([lists.setdefault(None if t is None else tuple(t), len(lists)) for t in identifiers.to_pylist()], pa.int32())
    first, kind = _alike([given, told, *fields])
    at, texts, found = pa.array(first), list(lists), []
    for there, t, *pair in zip(*(c.take(at).to_pylist() for c in (given, told, *fields)), strict=True):
        found.append(judge(tuple(pair[:5]), (*pair[5:11], texts[t], *pair[11:])) if there else (None,) * len(_TYPE))
    columns = [pa.array([m[i] for m in found], _TYPE.field(i).type) for i in range(len(_TYPE))]
    matches = pa.StructArray.from_arrays(columns, fields=list(_TYPE), mask=pa.array([m[0] is None for m in found], pa.bool_()))
    return matches.take(pa.array(kind))
