"""Benchmark decontamination by a distributed positional inverted index.

Built of DataFrame functions alone. Items are cut into windows of consecutive
words. Each window is looked up by its two rarest words, counted over all training
texts: the index stores the postings (word, text, position) of those words, and
lists shifted by the word's place in the item are intersected. What both lists
share is compared word by word with the text, which gives exact phrase matches.
``proximity_matches`` asks for both words within a wider span, in any order, and then
for all the others.

A text is cut into words wherever they are needed: writing the words of all texts
took as much CPU time as cutting them again, and four times the disk.
Texts are known by a digest, so copies of a text give one set of postings.

Words are made in an encoding of one character a byte: lower-casing then changes
A-Z, and of other bytes only the leading bytes of characters, each to one that no
valid text could have in its place. Distinct words stay distinct.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Workspace

#: Words of a list that every task may hold; longer ones are joined by a shuffle.
HELD_WORDS = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    plain = F.lower(F.decode(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), "ISO-8859-1"))
    return F.array_remove(F.split(plain, SEPARATORS), "")


def _digest(value: Column) -> Column:
    return F.unhex(F.md5(value))


class Index(NamedTuple):
    """``texts`` (key, text and other columns), ``items`` (ikey, iwords), ``item_ids``, ``windows`` (ikey, w, p1, p2), ``anchors``, ``postings``."""

    texts: DataFrame
    items: DataFrame
    item_ids: DataFrame
    windows: DataFrame
    anchors: DataFrame
    postings: DataFrame
    width: int


def _held(words: DataFrame) -> bool:
    """Whether a written list of distinct words is short enough for every task to hold."""
    return words.count() <= HELD_WORDS


def _counted(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``word, f``: how often each of the terms is in the texts."""
    tokens = texts.select(F.explode(words_of(F.col("text"))).alias("word"))
    if _held(terms):
        return tokens.join(F.broadcast(terms), "word").groupBy("word").agg(F.count("*").alias("f"))
    # counted before words move, so that a frequent one is a row of each task
    return tokens.groupBy("word").agg(F.count("*").alias("f")).join(terms, "word")


def build_index(docs: DataFrame, items: DataFrame, width: int, work: Workspace) -> Index:
    """Count the items' words in all texts, choose each window's rarest two, and store their postings.

    ``docs`` has ``text``; its other columns stay in ``texts``.
    """
    texts = docs.withColumn("key", _digest(F.coalesce("text", F.lit(""))))
    # a digest of the words, which ends of words can't blur as no word holds a space
    named = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("iwords")).where(F.size("iwords") > 0)
    named = work.put(named.withColumn("ikey", _digest(F.array_join("iwords", " "))), "items")
    unique = named.dropDuplicates(["ikey"]).select("ikey", "iwords")
    terms = work.put(unique.select(F.explode("iwords").alias("word")).distinct(), "terms")
    counts = work.put(_counted(texts, terms), "counts")

    placed = unique.select("ikey", F.posexplode("iwords").alias("p", "word")).join(counts, "word", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    rows = placed.groupBy("ikey").agg(F.array_sort(F.collect_list(F.struct("p", "f", "word"))).alias("at"))
    length = F.least(F.size("at"), F.lit(width))
    rarest = F.transform(
        F.sequence(F.lit(0), F.size("at") - length),
        lambda w: F.struct(
            w.alias("w"), F.slice(F.array_sort(F.transform(F.slice("at", w + 1, length), lambda x: F.struct(x["f"].alias("f"), x["p"].alias("p"), x["word"].alias("word")))), 1, 2).alias("least")
        ),
    )
    # a window with a word that no text has occurs nowhere
    windows = rows.select("ikey", F.explode(rarest).alias("x")).where(F.col("x.least")[0]["f"] > 0)
    windows = windows.select("ikey", F.col("x.w").alias("w"), F.col("x.least")[0].alias("one"), F.element_at("x.least", -1).alias("two"))
    windows = work.put(windows, "windows")
    ends = windows.select("ikey", F.explode(F.array("one", "two")).alias("a"))
    anchors = work.put(ends.select("ikey", F.col("a.p").alias("p"), F.col("a.word").alias("word")).distinct(), "anchors")
    wanted = work.put(anchors.select("word").distinct(), "wanted")
    listed = texts.select("key", F.posexplode(words_of(F.col("text"))).alias("pos", "word")).join(F.broadcast(wanted) if _held(wanted) else wanted, "word")
    postings = work.put(listed.select("word", "key", "pos").distinct(), "postings")
    pairs = windows.select("ikey", "w", F.col("one.p").alias("p1"), F.col("two.p").alias("p2"))
    return Index(texts, unique, named.select("ikey", "item_id").distinct(), pairs, anchors, postings, width)


def _pairs(index: Index) -> DataFrame:
    """``ikey, pairs``: each item's windows with the places of their two rarest words."""
    return index.windows.groupBy("ikey").agg(F.collect_list(F.struct("w", "p1", "p2")).alias("pairs"))


def _both_met() -> Column:
    """The ``pairs`` of which ``got`` holds both places."""
    return F.filter("pairs", lambda x: F.array_contains("got", x["p1"]) & F.array_contains("got", x["p2"]))


def phrase_matches(index: Index, work: Workspace) -> DataFrame:
    """``key, ikey, first, last``: text words (from 0, both inclusive) that an occurrence of an item's window covers."""
    shifted = index.postings.join(index.anchors, "word").select("key", "ikey", (F.col("pos") - F.col("p")).alias("shift"), "p")
    met = shifted.groupBy("key", "ikey", "shift").agg(F.collect_set("p").alias("got"))
    both = met.join(_pairs(index), "ikey").select("key", "ikey", "shift", _both_met().alias("pairs"))
    likely = both.where(F.size("pairs") > 0).select("key", "ikey", "shift", F.transform("pairs", lambda x: x["w"]).alias("ws"))
    likely = work.put(likely, "likely")
    tried = likely.join(index.items, "ikey").join(_words_of_keys(index, likely, work), "key")
    length = F.least(F.size("iwords"), F.lit(index.width))
    here = F.filter("ws", lambda w: (w + F.col("shift") >= 0) & (F.slice("words", F.greatest(w + F.col("shift") + 1, F.lit(1)), length) == F.slice("iwords", w + 1, length)))
    found = tried.select("key", "ikey", length.alias("length"), F.explode(F.transform(here, lambda w: w + F.col("shift"))).alias("first"))
    return work.put(found.select("key", "ikey", "first", (F.col("first") + F.col("length") - 1).alias("last")).distinct(), "matches")


def _words_of_keys(index: Index, likely: DataFrame, work: Workspace) -> DataFrame:
    """``key, words`` of the texts that ``likely`` names, once each."""
    held = work.put(index.texts.select("key", "text").join(likely.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]), "held")
    return held.select("key", words_of(F.col("text")).alias("words"))


def proximity_matches(docs: DataFrame, items: DataFrame, width: int = 10, slack: int = 5) -> DataFrame:
    """``doc_id, item_id, windows``: how many of an item's windows have all their words, in any order, within ``slack`` words more than they are.

    A window's words count once each. A null or empty text, and an item without words,
    match nothing; an item with a null id gives rows with a null one. Rows that repeat
    an id or a text count each; empty tables give no rows; other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "proximity")
    index = build_index(docs.select("doc_id", "text"), items, width, work)
    # a span lies in one of the cells of twice its length, of which each place is in two
    cell = width + slack
    placed = index.postings.join(index.anchors, "word").select("key", "ikey", "p", F.explode(F.array(F.floor(F.col("pos") / cell), F.floor(F.col("pos") / cell) + 1)).alias("cell"))
    met = placed.groupBy("key", "ikey", "cell").agg(F.collect_set("p").alias("got"))
    likely = met.join(_pairs(index), "ikey").select("key", "ikey", "cell", _both_met().alias("pairs")).where(F.size("pairs") > 0)
    likely = work.put(likely.select("key", "ikey", "cell", F.transform("pairs", lambda x: x["w"]).alias("ws")), "likely")
    tried = likely.join(index.items, "ikey").join(_words_of_keys(index, likely, work), "key")
    length = F.least(F.size("iwords"), F.lit(width))
    starts = F.sequence(F.greatest((F.col("cell") - 1) * cell, F.lit(0)).cast("int"), (F.col("cell") * cell).cast("int"))
    whole = lambda w, s: F.size(F.array_except(F.slice("iwords", w + 1, length), F.slice("words", s + 1, length + slack))) == 0
    near = tried.select("key", "ikey", F.explode(F.filter("ws", lambda w: F.exists(starts, lambda s: whole(w, s)))).alias("w"))
    found = work.put(near.distinct().groupBy("key", "ikey").agg(F.count("*").alias("windows")), "near")
    return index.texts.select("doc_id", "key").join(found.join(index.item_ids, "ikey"), "key").select("doc_id", "item_id", "windows")


def contamination(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A window is ``width`` consecutive words of an item; an item of fewer, but not none,
    is one window. ``n_hit`` counts the words of a text inside any occurrence of a
    window, ``n_items`` the items with one, whose ids ``items_sha256`` digests, sorted
    as strings and comma-joined. Null and empty texts have no words; an item with a
    null id hits words but isn't listed. Rows that repeat an id or a text are judged
    each; empty tables give no hits or no rows; other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "decontaminate")
    index = build_index(docs.select("doc_id", "text"), items, width, work)
    matches = phrase_matches(index, work)
    spans = matches.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    count = F.aggregate(
        "spans",
        start,
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["last"] + 1 - F.greatest(x["first"], acc["reach"]))).alias("n"), F.greatest(acc["reach"], x["last"] + 1).alias("reach")
        ),
        lambda acc: acc["n"],
    )
    listed = matches.select("key", "ikey").distinct().join(index.item_ids, "ikey").groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    hit = work.put(spans.select("key", count.cast("long").alias("n_hit")).join(listed, "key", "left"), "hit")
    out = index.texts.select("doc_id", "key", F.size(words_of(F.col("text"))).cast("long").alias("n_words")).join(hit, "key", "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def without_contaminated(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of an item, with all their columns."""
    work = Workspace(docs.sparkSession, "decontaminate")
    index = build_index(docs.select("text"), items, width, work)
    keys = work.put(phrase_matches(index, work).select(F.col("key").alias("__key")).distinct(), "keys")
    return docs.withColumn("__key", _digest(F.coalesce("text", F.lit("")))).join(keys, "__key", "left_anti").drop("__key")
