"""What a monitored page's samples give rise to: alerts at edges, and the market they are good for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_key(job: Column, kind: Column, episode: Column) -> Column:
    """A digest of what happened once."""
    return F.sha2(F.to_json(F.array(job.cast("string"), kind, episode.cast("string"))), 256)


def sample_alerts(samples: DataFrame, keys: Sequence[str], at: str, *order: str, threshold: float = 5.0) -> DataFrame:
    """``keys, at, kind, old_value, new_value, event_key`` of each sample against the one before it.

    ``samples``: keys, at, availability, price, includes_tax, gap (what is missing, empty or
    NULL if nothing), stock_conflict, own_price, eligible. ``availability`` tells any change
    of it; ``price_up`` and ``price_down`` a move by the threshold in percent between two
    samples without a gap and with tax; ``undercut`` an eligible price below the own one
    where the sample before wasn't cheaper already: then it had no gap, tax, stock
    without conflict, and a price below the own one of its time.
    """
    now = F.struct("availability", "price", "includes_tax", "gap", "stock_conflict", "own_price")
    rows = samples.withColumn("was", F.lag(now).over(Window.partitionBy(*keys).orderBy(at, *order)))
    told = lambda c: F.coalesce(c, F.lit(False))
    whole = lambda s: (F.coalesce(F.col(f"{s}gap"), F.lit("")) == "") & told(F.col(f"{s}includes_tax"))
    price, before = F.col("price"), F.col("was.price")
    before_whole = F.col("was").isNotNull() & whole("was.")
    move = F.abs((price - before) / F.when(before != 0, before) * 100)
    cheaper = told(before_whole & (F.col("was.availability") == "available") & ~told(F.col("was.stock_conflict")) & (before < F.col("was.own_price")))
    kinds = [
        (F.col("was").isNotNull() & ~F.col("was.availability").eqNullSafe(F.col("availability")), F.lit("availability"), F.col("was.availability"), F.col("availability")),
        (whole("") & before_whole & (move >= threshold), F.when(price > before, "price_up").otherwise("price_down"), before.cast("string"), price.cast("string")),
        (told(F.col("eligible")) & (price < F.col("own_price")) & ~cheaper, F.lit("undercut"), before.cast("string"), price.cast("string")),
    ]
    found = F.array(*[F.when(told(holds), F.struct(kind.alias("kind"), old.alias("old_value"), new.alias("new_value"))) for holds, kind, old, new in kinds])
    out = rows.select(*keys, at, F.explode(F.array_compact(found)).alias("a")).select(*keys, at, "a.*")
    return out.withColumn("event_key", event_key(F.concat_ws("|", *keys), F.col("kind"), F.col(at)))


def stale_alerts(jobs: DataFrame, keys: Sequence[str], now: Column) -> DataFrame:
    """``keys, last_ok_at, event_key`` of jobs (keys, last_ok_at, valid_until, offer) whose price has run out: once for each last success."""
    gone = jobs.where((F.col("valid_until") < now) & F.col("offer").isNotNull())
    return gone.select(*keys, "last_ok_at", event_key(F.concat_ws("|", *keys), F.lit("stale"), F.col("last_ok_at")).alias("event_key"))


def resolved_markets(pages: DataFrame) -> DataFrame:
    """``pages`` with ``sales_market, market_reason, market_review``.

    ``pages``: market, market_source and market_conflict as the page says, and of its shop's
    settings configured_market, market_verified, evidence_url, market_note. A setting
    counts only if it is verified with an address and a note. A page that contradicts
    itself or the setting goes to review with the market it names; else the page speaks,
    then the setting, and without either the market stays empty.
    """
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    verified = F.coalesce("market_verified", F.lit(False)) & (text("evidence_url") != "") & (text("market_note") != "")
    configured = F.when(verified, text("configured_market")).otherwise("")
    page = text("market")
    conflict = F.coalesce("market_conflict", F.lit(False)) | ((page != "") & (configured != "") & (page != configured))
    reason = F.when(conflict, "contradictorio").when(page != "", "ficha").when(configured != "", "configuración").otherwise("sin evidencia")
    return pages.withColumns({"sales_market": F.when(page != "", page).otherwise(configured), "market_reason": reason, "market_review": conflict})
