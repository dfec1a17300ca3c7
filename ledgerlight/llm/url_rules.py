"""URL filters: stated host and path rules, and association rules mined from them.

URLs that a stated rule decides are the labelled set. Spark's FP-growth finds the
token combinations (of host labels, their hyphenated parts, path words and query
keys) that go with a label; rules below a support or confidence or without lift, and
rules that a shorter one with at least their confidence covers, drop out, and so do
rules of nothing but the tokens of the stated rule they agree with. What is left is
matched through an inverted index that lists a rule under its rarest token alone:
distinct token sets meet the rules on that token, and a rule fits where the set has
all its tokens.

Two things keep the combinations few without losing a rule. Tokens that stand in just
the same labelled URLs are mined as one, and any of them stands for all. A token whose
URLs all have one label is a rule by itself, which covers whatever it is combined
with, so it isn't combined. (Tokens of both labels that nearly always go together are
still combined in all ways that reach ``support``.)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Workspace

#: Share of labelled URLs that hold a combination, and share of these with the label.
SUPPORT, CONFIDENCE = 0.002, 0.9
#: A rule is surer than the label's share of all labelled URLs by more than this factor.
LIFT = 1 + 1e-9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z as a-z; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Sorted distinct tokens: ``h:`` host labels and hyphenated parts, ``p:`` path words, ``q:`` query keys."""
    host = F.split(host_of(url), r"\.")
    parts = F.flatten(F.transform(host, lambda x: F.split(x, "-")))
    path = F.split(F.translate(path_of(url), UPPER, LOWER), r"[/._-]+")
    query = F.transform(F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&"), lambda x: F.substring_index(x, "=", 1))

    def tagged(tag: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.concat(F.lit(tag), x))

    words = F.filter(F.concat(tagged("h:", host), tagged("h:", parts), tagged("p:", path), tagged("q:", query)), lambda x: (F.length(x) > 2) & ~x.rlike(r"^.:[0-9]+$"))
    return F.coalesce(F.array_sort(F.array_distinct(words)), F.array().cast("array<string>"))


def stated_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (``host/path``) that fits, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        where, _, rest = text.partition("/")
        fits = ((host == where) | host.endswith("." + where)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def vocabulary(labelled: DataFrame, support: float = SUPPORT, apart: Sequence[str] = ()) -> DataFrame:
    """``token, stands, f, pure`` of the tokens frequent enough, from ``tokens, label, copies``.

    ``stands`` is the smallest of the tokens that are in just the same rows (those in
    ``apart`` stand for themselves alone), ``f`` the number of these, and ``pure`` tells
    that they have one label.
    """
    rows = labelled.groupBy("tokens", "label").agg(F.sum("copies").alias("copies"))
    signs = [F.xxhash64(*c).cast("decimal(38,0)").alias(n) for n, c in (("a", ("tokens", "label")), ("b", ("label", "tokens")))]
    each = rows.select(F.explode("tokens").alias("token"), "label", "copies", *signs)
    held = each.groupBy("token").agg(F.sum("copies").alias("f"), F.sum("a").alias("a"), F.sum("b").alias("b"), (F.min("label") == F.max("label")).alias("pure"))
    least = F.ceil(F.lit(support) * (labelled.agg(F.sum("copies")).first()[0] or 0))
    alone = F.when(F.col("token").isin(*apart), F.col("token")) if apart else F.lit(None)
    per = Window.partitionBy("a", "b", "f", alone)  # tokens in the same rows
    return held.where(F.col("f") >= least).select("token", F.min("token").over(per).alias("stands"), "f", "pure")


def standing(rows: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """``key`` and ``tokens`` of ``rows`` with each token as the one that stands for it; others, and rows without any, drop out."""
    met = rows.select(key, F.explode("tokens").alias("token")).join(words.select("token", "stands"), "token")
    return met.groupBy(key).agg(F.array_sort(F.collect_set("stands")).alias("tokens"))


def mine(labelled: DataFrame, words: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``tokens, label, confidence, support, rule_id`` of the rules, from ``tokens, label, copies`` with tokens that stand for all.

    Single tokens are counted; FP-growth finds the combinations of those with both labels.
    """
    shares = {r.label: r.n for r in labelled.groupBy("label").agg(F.sum("copies").alias("n")).collect()}  # a row for each label
    total = sum(shares.values())
    if not total:
        return labelled.sparkSession.createDataFrame([], "tokens array<string>, label string, confidence double, support double, rule_id long")
    least = F.create_map(*[F.lit(x) for label, n in shares.items() for x in (label, n / total * LIFT)])[F.col("label")]
    counts = labelled.select(F.explode("tokens").alias("token"), "label", "copies").groupBy("token", "label").agg(F.sum("copies").alias("n")).join(words, "token")
    single = counts.select(F.array("token").alias("tokens"), "label", (F.col("n") / F.col("f")).alias("confidence"), (F.col("n") / total).alias("support"))
    mixed = words.where("not pure and token = stands").agg(F.collect_list("token")).first()[0]  # at most 1 / support for each token of a URL
    kept = F.filter("tokens", lambda x: x.isin(mixed)) if mixed else F.array().cast("array<string>")
    items = labelled.select(F.array_append(kept, F.concat(F.lit("label:"), F.col("label"))).alias("items"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("items")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    found = model.associationRules.where(F.col("consequent")[0].startswith("label:") & ~F.exists("antecedent", lambda x: x.startswith("label:")) & (F.size("antecedent") > 1))
    found = found.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 7, 99).alias("label"), "confidence", "support")
    rules = single.where((F.col("confidence") >= confidence) & (F.col("support") >= support)).unionByName(found)
    return rules.where(F.col("confidence") > least).withColumn("rule_id", F.xxhash64(F.array_join("tokens", " "), "label"))


def matched(asked: DataFrame, rules: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """The columns ``keys`` of ``asked`` with each rule whose tokens its ``tokens`` all have. ``words`` has ``token, f``."""
    about = ["rule_id", "label", "confidence", "support"]
    placed = rules.select(*about, F.col("tokens").alias("needs"), F.explode("tokens").alias("token")).join(words.select("token", "f"), "token", "left")
    rarest = placed.groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("f", F.lit(0)), "token")).alias("token"))
    index = placed.join(rarest, ["rule_id", "token"]).select("token", *about, "needs")
    met = asked.select(*keys, "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return met.where(F.size(F.array_except("needs", "tokens")) == 0).select(*keys, *about)


def beyond_stated(rules: DataFrame, labelled: DataFrame, words: DataFrame, stated: Sequence[tuple[str, str]]) -> DataFrame:
    """Without the rules that merely restate: all their tokens are those of each stated rule whose URLs they agree with."""
    agree = matched(labelled.withColumnRenamed("label", "told"), rules, words, ["source", "told"]).where("told = label").select("rule_id", "source").distinct()
    spelled = rules.sparkSession.createDataFrame([(text,) for text, _ in stated], "source string")
    own = standing(spelled.select("source", tokens_of(F.concat(F.lit("x://"), "source")).alias("tokens")), words, "source").withColumnRenamed("tokens", "own")
    own = spelled.join(own, "source", "left").select("source", F.coalesce("own", F.array().cast("array<string>")).alias("own"))  # the stated rules are few
    says_more = agree.join(F.broadcast(own), "source").join(rules.select("rule_id", "tokens"), "rule_id").where(F.size(F.array_except("tokens", "own")) > 0)
    return rules.join(says_more.select("rule_id").distinct(), "rule_id", "left_semi")


def prune(rules: DataFrame, words: DataFrame) -> DataFrame:
    """Drop a rule if another one on a part of its tokens is as sure.

    Rules of one token go first: what a dropped rule would cover, the one that covers it does too.
    """
    single = rules.where(F.size("tokens") == 1).select(F.col("tokens")[0].alias("token"), "label", F.col("confidence").alias("conf1"))
    over = rules.where(F.size("tokens") > 1).select(F.explode("tokens").alias("token"), "rule_id", "label", "confidence")
    keyed = rules.join(over.join(single, ["token", "label"]).where("conf1 >= confidence").select("rule_id").distinct(), "rule_id", "left_anti")
    long = keyed.where(F.size("tokens") > 1).select(F.col("rule_id").alias("long_id"), "tokens", F.col("label").alias("label1"), F.col("confidence").alias("conf1"))
    covered = matched(long, keyed, words, ["long_id", "label1", "conf1"]).where("rule_id <> long_id and label = label1 and confidence >= conf1")
    return keyed.join(covered.select(F.col("long_id").alias("rule_id")).distinct(), "rule_id", "left_anti")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], otherwise: str = "allow", url_col: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``; columns of these names are replaced.

    The longest stated rule decides; else the mined rule with the best confidence,
    then support, then number; else ``otherwise``. A null url, or one without
    ``://``, has an empty host and path, no tokens, and the last verdict. Rows and
    other columns stay, repeated ones too; an empty table gives an empty table.
    """
    work = Workspace(pages.sparkSession, "urls")
    url = F.col(f"`{url_col}`")
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_of(url), path_of(url)
    rule, says = stated_rule(host, path, rules)
    told = pages.select(*keep, host.alias("host"), path.alias("path"), rule.alias("rule"), says.alias("__says"), tokens_of(url).alias("__tokens"))
    labelled = told.where("__says is not null").groupBy(F.col("__tokens").alias("tokens"), F.col("__says").alias("label"), F.col("rule").alias("source")).agg(F.count("*").alias("copies"))
    labelled = work.put(labelled.withColumn("key", F.monotonically_increasing_id()), "labelled")
    spelled = pages.sparkSession.createDataFrame([(f"x://{text}",) for text, _ in rules], "url string")
    own = [r.token for r in spelled.select(F.explode(tokens_of(F.col("url"))).alias("token")).distinct().collect()]  # of the stated rules
    words = work.put(vocabulary(labelled, apart=own), "words")
    sets = labelled.drop("tokens").join(standing(labelled, words, "key"), "key", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    sets = work.put(sets, "sets")
    mined = work.put(mine(sets, words), "mined")
    kept = work.put(beyond_stated(work.put(prune(mined, words), "pruned"), sets, words, rules), "rules")

    key = F.array_join("__tokens", " ")
    asked = told.where("__says is null").select(F.col("__tokens").alias("tokens"), key.alias("__key")).distinct()
    fits = matched(standing(asked, words, "__key"), kept, words, ["__key"])
    best = fits.groupBy("__key").agg(F.max_by("label", F.struct("confidence", "support", "rule_id")).alias("__mined"))
    best = work.put(best, "best")
    out = told.withColumn("__key", key).join(best, "__key", "left")
    return out.withColumn("verdict", F.coalesce("__says", "__mined", F.lit(otherwise))).drop("__says", "__tokens", "__key", "__mined")
