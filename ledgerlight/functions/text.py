"""Text expressions: Column in, Column out, all inside code generation."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F



def _decomposed(first: int, last: int) -> dict[str, str]:
    """Signs of a range whose compatibility decomposition is ASCII but for combining marks, with that ASCII text."""
    out = {}
    for sign in map(chr, range(first, last + 1)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", sign) if not unicodedata.combining(x))
        if plain and plain != sign and plain.isascii():
            out[sign] = plain
    return out


_ONE = {sign: plain for sign, plain in _decomposed(0xA0, 0xFFFF).items() if len(plain) == 1}
#: Of the signs for several letters those of Latin text: digraphs, ligatures, trade marks.
_SEVERAL = {sign: plain for span in ((0xA0, 0x24F), (0x2120, 0x2122), (0xFB00, 0xFB06)) for sign, plain in _decomposed(*span).items() if len(plain) > 1}
ACCENTED, PLAIN = "".join(_ONE), "".join(_ONE.values())
#: What ``ascii_fold`` makes of each sign that isn't removed.
FOLDED = _ONE | _SEVERAL | dict.fromkeys("□×", "x")


def _letters(first: int, last: int) -> dict[str, str]:
    """Signs of a range that are one sign and combining marks, with that sign."""
    out = {}
    for sign in map(chr, range(first, last + 1)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", sign) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != sign:
            out[sign] = plain
    return out


#: Letters of all scripts without marks, but for the syllables that are put together of letters (Hangul) and surrogates.
_BARE = _letters(0xA0, 0xABFF) | _letters(0xF900, 0xFFFF)


def bare_letters(c: Column) -> Column:
    """Lower case without marks; letters without an ASCII form stay (``ł``, Greek, Cyrillic)."""
    for sign, plain in (_SEVERAL | {"ß": "ss", "ς": "σ"}).items():
        c = F.replace(c, F.lit(sign), F.lit(plain))
    return F.regexp_replace(F.translate(F.lower(c), "".join(_BARE), "".join(_BARE.values())), r"\p{Mn}", "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression that uses a value more than once and computes it once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def safe_text(c: Column) -> Column:
    """trimmed text, empty for NULL."""
    return F.coalesce(F.trim(c), F.lit(""))


def normalize_text(c: Column) -> Column:
    """lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def ascii_fold(c: Column) -> Column:
    """letters by their compatibility decomposition without marks, the signs for "by" as x; what has no such ASCII form (``ø``, ``ł``) is removed."""
    for sign, plain in _SEVERAL.items():
        c = F.replace(c, F.lit(sign), F.lit(plain))
    return F.regexp_replace(F.translate(c, "□×" + ACCENTED, "xx" + PLAIN), r"[^\x00-\x7F]", "")


def identity_key(c: Column) -> Column:
    """folded, upper case, letters and digits only."""
    return F.regexp_replace(F.upper(ascii_fold(F.coalesce(c, F.lit("")))), "[^A-Z0-9]", "")


def model_key(c: Column) -> Column:
    """the identity key; ``FT`` and four digits lose a trailing S."""
    return bound(identity_key(c), lambda key: F.when(key.rlike("^FT[0-9]{4}S$"), F.substring(key, 1, 6)).otherwise(key))


def tokens(c: Column) -> Column:
    """upper-case folded words."""
    return F.array_remove(F.split(F.upper(ascii_fold(F.coalesce(c, F.lit("")))), "[^A-Z0-9]+"), "")


def zero_padded(c: Column, width: int = 14) -> Column:
    """a code without regard to leading zeros, as ``width`` digits or more; NULL if it is no digits."""
    bare = F.coalesce(F.nullif(F.ltrim(c, F.lit("0")), F.lit("")), F.lit("0"))
    return F.when(c.rlike(r"^[0-9]+$"), F.lpad(bare, F.greatest(F.lit(width), F.length(bare)), F.lit("0")))


def slug(c: Column) -> Column:
    """lower-case ASCII words joined by hyphens."""
    return F.trim(F.regexp_replace(F.lower(ascii_fold(c)), "[^a-z0-9]+", "-"), F.lit("-"))


def view_of_file(name: Column) -> Column:
    """F8: the market view (V1, V2, V3) named by one of the last two ``__`` parts of a file name."""
    parts = F.split(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), "__")
    last, before = F.upper(F.element_at(parts, -1)), F.upper(F.try_element_at(parts, F.lit(-2)))
    views = ("V1", "V2", "V3")
    return F.when(F.size(parts) > 1, F.when(last.isin(*views), last).when(before.isin(*views), before))


def starts_with_any(c: Column, heads: Sequence[str]) -> Column:
    """F9."""
    return F.coalesce(F.greatest(*[c.startswith(h) for h in heads], F.lit(False)), F.lit(False))


def contains_any(c: Column, parts: Sequence[str]) -> Column:
    """literal, case ignored."""
    low = F.lower(c)
    return F.coalesce(F.greatest(*[low.contains(p.lower()) for p in parts], F.lit(False)), F.lit(False))


def rule_chain(c: Column, rules: Sequence[tuple[str, str]], otherwise: Column) -> Column:
    """the value of the first rule whose pattern the text holds."""
    out = otherwise
    for pattern, value in reversed(rules):
        out = F.when(c.rlike(pattern), F.lit(value)).otherwise(out)
    return out


def search_any(columns: Sequence[Column], query: str) -> Column:
    """The query inside the joined columns, literally and without regard to case."""
    return F.lower(F.concat_ws(" ", *columns)).contains(query.lower())


def like_literal(c: Column, query: str) -> Column:
    """LIKE with the pattern signs of the query escaped."""
    safe = query.lower().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return F.like(F.lower(c), F.lit(f"%{safe}%"), F.lit("\\"))


def natural_key(c: Column) -> Column:
    """A key in natural order: texts without marks and case, numbers by their value, in turn.

    A text ends in a sign below all others, so that one comes before what it begins; a
    number stands behind its length without leading zeros, so that 10 follows 9.
    """
    parts = F.regexp_extract_all(bare_letters(F.coalesce(c, F.lit(""))), F.lit("([^0-9]*)([0-9]*)"), 0)
    text = lambda p: F.regexp_replace(p, "[0-9]+$", "")
    keyed = F.transform(parts, lambda p: F.concat(text(p), F.when(p.rlike("[0-9]$"), F.concat(F.lit("\x01"), _counted(F.ltrim(F.regexp_extract(p, "([0-9]+)$", 1), F.lit("0"))))).otherwise("")))
    return F.array_join(keyed, "")


def _counted(digits: Column) -> Column:
    return F.concat(F.lpad(F.length(digits).cast("string"), 9, "0"), digits)


def canonical_url(url: Column) -> Column:
    """no fragment, no tracking parameters."""
    base = F.regexp_replace(url, r"#.*$", "")
    query = F.regexp_extract(base, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_|gclid|fbclid|ref=)"))
    return F.concat(F.regexp_replace(base, r"\?.*$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def is_technical(c: Column) -> Column:
    """a placeholder, a file name or a long number in place of a name."""
    value = normalize_text(c)
    return value.isin("", "-", "n/a", "none", "null", "unknown") | value.rlike(r"\.(jpe?g|png|webp|tiff?)$") | value.rlike(r"[0-9]{8,}")


def spans(words: Column, longest: int = 4) -> Column:
    """F16: the contiguous word groups of up to ``longest`` words."""
    n = F.size(words)

    def of(k: int) -> Column:
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), ""))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*[of(k) for k in range(1, longest + 1)])))


def link_matches(groups: Column, keys: Sequence[str]) -> Column:
    """F16: whether one of a link's keys is among a name's word groups."""
    return F.arrays_overlap(groups, F.array(*[F.lit(k) for k in keys]))


def complete(*columns: str) -> Column:
    """No column is NULL or blank."""
    out = F.lit(True)
    for c in columns:
        out = out & (safe_text(F.col(c)) != "")
    return out


def localised(c: Column) -> Column:
    """A text in several languages as JSON: Spanish, else English; what is no JSON, or has neither, as it is."""
    return F.coalesce(F.get_json_object(c, "$.es_ES"), F.get_json_object(c, "$.en_US"), c)


def html_escape(c: Column) -> Column:
    """F19."""
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for sign, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out
