"""Crawler visits, and visits that AI assistants sent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.enrich import assistant
from tidewatch.operators.common import local_day, of_site, uniques
from tidewatch.plans.request import Request
from tidewatch.schema import CRAWL, CRAWL_SUFFIX, PAGEVIEW


def _hits(events: DataFrame, r: Request) -> DataFrame:
    # props may be a JSON document, or a JSON string that holds one.
    status = F.coalesce(F.get_json_object("props", "$.status"), F.regexp_extract("props", r'\\?"status\\?"\s*:\s*(\d+)', 1))
    out = of_site(events, r.site + CRAWL_SUFFIX, r.span).where(F.col("event") == CRAWL).withColumns({"ai": F.col("channel") == "ai", "status": F.coalesce(status.try_cast("int"), F.lit(0))})
    return out.where("ai") if r.ai_only else out


def crawl_pages(events: DataFrame, r: Request) -> DataFrame:
    """bot, ai, path, hits, errors, status (the latest), last_ms."""
    rows = _hits(events, r).groupBy(F.col("label").alias("bot"), "path").agg(F.max("ai").alias("ai"), F.count(F.lit(1)).alias("hits"), F.count_if(F.col("status") >= 400).alias("errors"), F.max_by("status", F.struct("ts_ms", "event_id")).alias("status"), F.max("ts_ms").alias("last_ms"))
    return rows.select("bot", "ai", "path", "hits", "errors", "status", "last_ms").orderBy(F.desc("hits"), "bot", "path").limit(r.limit)


def crawl_bots(events: DataFrame, r: Request) -> DataFrame:
    """bot, ai, hits, pages, last_ms; no limit."""
    return _hits(events, r).groupBy(F.col("label").alias("bot")).agg(F.max("ai").alias("ai"), F.count(F.lit(1)).alias("hits"), F.count_distinct("path").alias("pages"), F.max("ts_ms").alias("last_ms")).orderBy(F.desc("hits"), "bot")


def crawl_days(events: DataFrame, r: Request) -> DataFrame:
    return _hits(events, r).groupBy(local_day(r.timezone).alias("day")).agg(F.count(F.lit(1)).alias("hits"), F.count_if("ai").alias("ai_hits")).orderBy("day")


def _referrals(events: DataFrame, r: Request) -> DataFrame:
    rows = of_site(events, r.site, r.span).where((F.col("event") == PAGEVIEW) & ~F.col("channel").isin("paid", "internal"))
    own = F.when(F.col("session") != "", F.col("session")).otherwise(F.concat(F.lit("\0"), "visitor", F.lit("\0"), F.col("ts_ms").cast("string")))
    return rows.select("ts_ms", "event_id", "visitor", "path", own.alias("session"), assistant(F.col("referrer_host"), F.col("utm_source")).alias("source")).where("source <> ''")


def _firsts(events: DataFrame, r: Request) -> DataFrame:
    """The first row of each session decides its source, landing page and day."""
    return _referrals(events, r).groupBy("session").agg(F.min(F.struct("ts_ms", "event_id", "source", "path")).alias("f")).select("f.*")


def ai_sources(events: DataFrame, r: Request) -> DataFrame:
    """label, events, visitors, visits, most visits first. A session of two sources counts for both."""
    rows = _referrals(events, r).groupBy(F.col("source").alias("label")).agg(F.count(F.lit(1)).alias("events"), uniques("visitor").alias("visitors"), F.count_distinct("session").alias("visits"))
    return rows.orderBy(F.desc("visits"), "label")


def ai_landing(events: DataFrame, r: Request) -> DataFrame:
    rows = _firsts(events, r).groupBy("source", "path").agg(F.count(F.lit(1)).alias("visits"))
    return rows.orderBy(F.desc("visits"), "source", "path").limit(r.limit)


def ai_days(events: DataFrame, r: Request) -> DataFrame:
    return _firsts(events, r).groupBy(local_day(r.timezone).alias("day")).agg(F.count(F.lit(1)).alias("visits")).orderBy("day")


def ai_totals(events: DataFrame, r: Request) -> DataFrame:
    return _referrals(events, r).agg(F.count(F.lit(1)).alias("pageviews"), uniques("visitor").alias("visitors"), F.count_distinct("session").alias("visits"))
