"""Products known by text: references parsed from names, and how well two of them agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codes import compare_calibers, normalize_caliber, plausible_caliber
from .text import bound, identity_key, model_key, tokens


def parse_reference(name: Column, brands: Sequence[str]) -> Column:
    """``brand, model, colour, caliber`` out of a free text such as ``BRAND BV1274S 005 54-21``.

    The brand is a known one that the text holds, the model the first word with letters
    and digits, the colour the word after it; NULL where there is none. For a handful of
    brands: a catalogue's are joined by ``operators.references``.
    """
    caliber = bound(normalize_caliber(name), plausible_caliber)
    return bound(F.struct(tokens(name).alias("words"), caliber.alias("caliber")), lambda x: _parsed(x["words"], x["caliber"], brands))


def _parsed(words: Column, caliber: Column, brands: Sequence[str]) -> Column:
    brand = F.lit(None).cast("string")
    for b in sorted(brands, key=len):
        spelt = F.concat(F.lit(" "), F.array_join(tokens(F.lit(b)), " "), F.lit(" "))
        brand = F.when(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).contains(spelt), F.lit(b.upper())).otherwise(brand)

    def rest(model: Column) -> Column:
        after = F.try_element_at(words, (F.array_position(words, model) + 1).cast("int"))
        colour = F.when(after.rlike("^[0-9A-Z]{1,6}$") & after.rlike("[0-9]"), after)
        return F.struct(brand.alias("brand"), F.nullif(model_key(model), F.lit("")).alias("model"), colour.alias("colour"), caliber.alias("caliber"))

    return bound(F.try_element_at(F.filter(words, lambda w: w.rlike("[0-9]") & w.rlike("[A-Z]")), F.lit(1)), rest)


def classify(ours: Column, theirs: Column) -> Column:
    """``match`` (exact, probable or rejected) of two references, and the reasons against exact."""
    return bound(F.struct(ours.alias("ours"), theirs.alias("theirs")), lambda x: _classified(x["ours"], x["theirs"]))


def _classified(ours: Column, theirs: Column) -> Column:
    differs = lambda f: ours[f].isNotNull() & theirs[f].isNotNull() & (identity_key(ours[f]) != identity_key(theirs[f]))
    unknown = lambda f: ours[f].isNull() | theirs[f].isNull()
    caliber = compare_calibers(ours["caliber"], theirs["caliber"])
    hard = F.array_compact(F.array(F.when(differs("brand"), "brand"), F.when(differs("model"), "model"), F.when(differs("colour"), "colour"), F.when(caliber == "different", "caliber")))
    soft = F.array_compact(F.array(F.when(unknown("brand"), "brand?"), F.when(unknown("model"), "model?"), F.when(unknown("colour"), "colour?")))

    def judged(x: Column) -> Column:
        match = F.when(F.size(x["hard"]) > 0, "rejected").when(F.size(x["soft"]) == 0, "exact").otherwise("probable")
        return F.struct(match.alias("match"), F.array_join(F.concat(x["hard"], x["soft"]), ",").alias("reasons"))

    return bound(F.struct(hard.alias("hard"), soft.alias("soft")), judged)


def lookup(asked: DataFrame, index: DataFrame, levels: Sequence[Sequence[str]]) -> DataFrame:
    """Rows of ``asked`` (id and key columns) with the entries of the first level that has any.

    A level is a set of key columns; a NULL key finds nothing at its level.
    """
    found = None
    for rank, keys in enumerate(levels):
        hit = asked.select("id", *keys).join(index.select("entry", *keys), list(keys)).select("id", "entry", F.lit(rank).alias("level"))
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy("id").agg(F.min("level").alias("level"))
    return found.join(best, ["id", "level"], "left_semi").distinct()
