"""The rollup tier: hourly counts and mergeable sketches, and the union that answers from both tiers.

A raw row fans out to one headline row and one for each dimension it has, all in one pass; counting is by partial
aggregation, so what is shuffled is a row per (hour, event, dimension, key) and task.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.common import local_day, of_site, within
from tidewatch.plans.timerange import HOUR_MS, Span, local_days, midnight, plan_hours
from tidewatch.schema import DIMENSIONS

#: log2 of registers: headline rows and breakdown rows. Sketches of different sizes can't be merged, nor need they be.
HEADLINE, BREAKDOWN = 14, 11


def _sketch(c: str, size: int, when: Column) -> Column:
    return F.hll_sketch_agg(F.when(when & (F.col(c) != ""), F.col(c)), size)


def build(events: DataFrame) -> DataFrame:
    """Rollup rows of raw rows. Empty dimensions have no row; empty visitors and sessions are in no sketch."""
    parts = [F.struct(F.lit("").alias("dim"), F.lit("").alias("key"))] + [F.struct(F.lit(d).alias("dim"), F.col(d).alias("key")) for d in DIMENSIONS]
    fan = events.select((F.floor(F.col("ts_ms") / HOUR_MS) * HOUR_MS).cast("long").alias("hour"), "site", "event", "visitor", "session", F.explode(F.array(*parts)).alias("x"))
    fan = fan.select("hour", "site", "event", "visitor", "session", "x.dim", "x.key").where("dim = '' OR key <> ''")
    keys = ["hour", "site", "event", "dim", "key"]
    head = fan.where("dim = ''").groupBy(*keys).agg(F.count(F.lit(1)).alias("events"), _sketch("visitor", HEADLINE, F.lit(True)).alias("visitors"), _sketch("session", HEADLINE, F.lit(True)).alias("sessions"))
    rest = fan.where("dim <> ''").groupBy(*keys).agg(F.count(F.lit(1)).alias("events"), _sketch("visitor", BREAKDOWN, F.lit(True)).alias("visitors"), F.lit(None).cast("binary").alias("sessions"))
    return head.unionByName(rest)


def collect(events: DataFrame, rollups: DataFrame, site: str, span: Span, event: str | None, dim: str) -> DataFrame:
    """Rollup rows of a span: those stored for its whole hours, and those of the raw rows at its ends, built now."""
    plan = plan_hours(span)
    want = lambda df: df.where(F.col("event") == event) if event else df
    out = want(rollups.where((F.col("site") == site) & (F.col("dim") == dim)))
    full = plan.full or Span(0, 0)
    out = out.where((F.col("hour") >= full.start) & (F.col("hour") < full.end))
    if plan.partial:
        inside = within(plan.partial[0])
        for s in plan.partial[1:]:
            inside = inside | within(s)
        out = out.unionByName(build(want(of_site(events, site)).where(inside)).where(F.col("dim") == dim))
    return out


def merge(rows: DataFrame, *keys: str, sessions: bool = False) -> DataFrame:
    """Sum of events and estimate of uniques by key."""
    estimate = lambda c: F.hll_sketch_estimate(F.hll_union_agg(c))
    out = [F.sum("events").alias("events"), F.coalesce(estimate("visitors"), F.lit(0)).alias("visitors")]
    if sessions:
        out.append(F.coalesce(estimate("sessions"), F.lit(0)).alias("visits"))
    return rows.groupBy(*keys).agg(*out)


def breakdown(events: DataFrame, rollups: DataFrame, site: str, span: Span, event: str | None, dim: str, limit: int) -> DataFrame:
    rows = merge(collect(events, rollups, site, span, event, dim), "key").withColumnRenamed("key", "label")
    return rows.orderBy(F.desc("events"), "label").limit(limit)


def total(events: DataFrame, rollups: DataFrame, site: str, span: Span, event: str | None, dim: str) -> DataFrame:
    """Events of every key, whatever a limit shows."""
    return collect(events, rollups, site, span, event, dim).agg(F.coalesce(F.sum("events"), F.lit(0)).alias("total"))


def audience(events: DataFrame, rollups: DataFrame, site: str, span: Span, event: str) -> DataFrame:
    return merge(collect(events, rollups, site, span, event, ""), sessions=True).select(F.coalesce("events", F.lit(0)).alias("views"), "visitors", "visits")


def over_time(events: DataFrame, rollups: DataFrame, site: str, span: Span, zone: str, event: str | None) -> DataFrame:
    """label, events, visitors, visits of each local day of the span, in one job.

    Whole hours that lie in one local day come from rollups. Hours that a day's bound cuts (one a day in zones that are
    not whole hours from UTC) and the span's ends come from raw rows, sketched by day.
    """
    bounds = sorted({midnight(date.fromisoformat(d), zone) for d in local_days(span, zone)} | {span.start, span.end})
    cut = sorted({b // HOUR_MS * HOUR_MS for b in bounds if b % HOUR_MS})  # at most one for each of 402 bounds
    want = lambda df: df.where(F.col("event") == event) if event else df
    first, last = -(-span.start // HOUR_MS) * HOUR_MS, span.end // HOUR_MS * HOUR_MS
    whole = want(rollups.where((F.col("site") == site) & (F.col("dim") == ""))).where((F.col("hour") >= first) & (F.col("hour") < last))
    whole = (whole.where(~F.col("hour").isin(cut)) if cut else whole).select(local_day(zone, "hour").alias("label"), "events", "visitors", "sessions")
    if cut:
        hour = (F.floor(F.col("ts_ms") / HOUR_MS) * HOUR_MS).cast("long")
        raw = want(of_site(events, site, span)).where(hour.isin(cut)).groupBy(local_day(zone).alias("label"))
        whole = whole.unionByName(raw.agg(F.count(F.lit(1)).alias("events"), _sketch("visitor", HEADLINE, F.lit(True)).alias("visitors"), _sketch("session", HEADLINE, F.lit(True)).alias("sessions")))
    days = events.sparkSession.createDataFrame([(d,) for d in local_days(span, zone)], "label string")
    return days.join(merge(whole, "label", sessions=True), "label", "left").na.fill(0).orderBy("label")


def top_events(events: DataFrame, rollups: DataFrame, site: str, span: Span, limit: int) -> DataFrame:
    rows = merge(collect(events, rollups, site, span, None, ""), "event", sessions=True).withColumnRenamed("event", "label")
    return rows.orderBy(F.desc("events"), "label").limit(limit)
