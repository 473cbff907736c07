"""Exact time series, breakdowns and their comparison with the span before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.common import local_day, of_site, ranked, uniques
from tidewatch.plans.request import BREAKDOWNS, Request
from tidewatch.plans.timerange import Span, local_days, previous
from tidewatch.schema import PAGEVIEW


def _rows(events: DataFrame, r: Request, span: Span | None = None) -> DataFrame:
    out = of_site(events, r.site, span or r.span)
    return out.where(F.col("event") == r.event) if r.event else out


def over_time(events: DataFrame, r: Request, span: Span | None = None) -> DataFrame:
    """A row for each local day of the span, empty ones too: label, events, visitors, visits."""
    span = span or r.span
    days = events.sparkSession.createDataFrame([(d,) for d in local_days(span, r.timezone)], "label string")  # at most 401 rows
    counts = _rows(events, r, span).groupBy(local_day(r.timezone).alias("label")).agg(F.count(F.lit(1)).alias("events"), uniques("visitor").alias("visitors"), uniques("session").alias("visits"))
    return days.join(counts, "label", "left").na.fill(0).orderBy("label")


def counts(events: DataFrame, r: Request, dim: str, span: Span | None = None) -> DataFrame:
    """label, events, visitors of each value of a dimension but ''."""
    return _rows(events, r, span).where(F.col(dim) != "").groupBy(F.col(dim).alias("label")).agg(F.count(F.lit(1)).alias("events"), uniques("visitor").alias("visitors"))


def breakdown(events: DataFrame, r: Request) -> DataFrame:
    return ranked(counts(events, r, r.dimension or BREAKDOWNS[r.widget]), r.limit)


def total(events: DataFrame, r: Request) -> DataFrame:
    """Events of every value of the dimension, before any limit."""
    return counts(events, r, r.dimension or BREAKDOWNS[r.widget]).agg(F.coalesce(F.sum("events"), F.lit(0)).alias("total"))


def top_events(events: DataFrame, r: Request) -> DataFrame:
    """By event name; the request's own event is ignored."""
    rows = of_site(events, r.site, r.span).groupBy(F.col("event").alias("label")).agg(F.count(F.lit(1)).alias("events"), uniques("visitor").alias("visitors"), uniques("session").alias("visits"))
    return ranked(rows, r.limit)


def compare_top_events(events: DataFrame, r: Request) -> DataFrame:
    """The event names with each one's count in the span before, 0 where it is new."""
    before = of_site(events, r.site, previous(r.span, r.timezone)).groupBy(F.col("event").alias("label")).agg(F.count(F.lit(1)).alias("previous"))
    return top_events(events, r).join(before, "label", "left").na.fill(0, ["previous"]).orderBy(F.desc("events"), "label")


def period_total(events: DataFrame, r: Request, any_event: bool = False) -> DataFrame:
    """Events of the span, and of the span before where the request compares; before any limit."""

    def rows(span: Span, name: str) -> DataFrame:
        own = of_site(events, r.site, span) if any_event else _rows(events, r, span)
        return own.select(F.lit(name).alias("span"))

    spans = {"total": r.span} | ({"previous_total": previous(r.span, r.timezone)} if r.compare else {})
    both = [rows(span, name) for name, span in spans.items()]
    return (both[0].union(both[1]) if r.compare else both[0]).agg(*(F.count_if(F.col("span") == name).alias(name) for name in spans))


def audience(events: DataFrame, r: Request) -> DataFrame:
    """views, visitors, visits of page views."""
    rows = of_site(events, r.site, r.span).where(F.col("event") == PAGEVIEW)
    return rows.agg(F.count(F.lit(1)).alias("views"), uniques("visitor").alias("visitors"), uniques("session").alias("visits"))


def compare_breakdown(events: DataFrame, r: Request) -> DataFrame:
    """The breakdown with each label's count in the span before, 0 where it is new."""
    dim = r.dimension or BREAKDOWNS[r.widget]
    before = counts(events, r, dim, previous(r.span, r.timezone)).select("label", F.col("events").alias("previous"))
    top = ranked(counts(events, r, dim), r.limit)
    return top.join(before, "label", "left").na.fill(0, ["previous"]).orderBy(F.desc("events"), "label")


def compare_total(events: DataFrame, r: Request) -> DataFrame:
    dim = r.dimension or BREAKDOWNS[r.widget]
    return counts(events, r, dim, previous(r.span, r.timezone)).agg(F.coalesce(F.sum("events"), F.lit(0)).alias("previous_total"))


def compare_timeline(events: DataFrame, r: Request) -> DataFrame:
    """Day i beside day i of the span before; labels are those of now. Both sides have a row a day, 401 at most."""
    at = Window.orderBy("label")
    now = over_time(events, r).withColumn("i", F.row_number().over(at))
    before = over_time(events, r, previous(r.span, r.timezone)).withColumn("i", F.row_number().over(at))
    return now.join(before.select("i", F.col("events").alias("previous")), "i", "left").na.fill(0, ["previous"]).select("label", "events", "previous").orderBy("label")
