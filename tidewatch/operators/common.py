"""Filters, calendar keys and rankings that the questions share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.plans.timerange import Span


def within(span: Span, c: str = "ts_ms") -> Column:
    return (F.col(c) >= span.start) & (F.col(c) < span.end)


def of_site(df: DataFrame, site: str, span: Span | None = None) -> DataFrame:
    """Rows of one site and span; both predicates reach the scan."""
    out = df.where(F.col("site") == site)
    return out.where(within(span)) if span else out


def local_day(zone: str, c: str = "ts_ms") -> Column:
    """Local calendar day as text."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(F.col(c)), zone), "yyyy-MM-dd")


def period_of(day: Column, period: str) -> Column:
    """The day, or its ISO week like 2024-W03."""
    if period != "week":
        return day
    d = day.cast("date")
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), d).cast("int"), F.extract(F.lit("WEEK"), d).cast("int"))


def page_of() -> Column:
    """A page's name where it has one, else its path."""
    return F.when(F.col("page") != "", F.col("page")).otherwise(F.col("path"))


def on_page(page: str, path: str) -> Column:
    return F.col("page") == page if page else F.col("path") == path


def band(width: Column) -> Column:
    """Upper bound of a viewport's band; 0 for unknown."""
    return F.when(width <= 0, 0).when(width < 600, 600).when(width < 1024, 1024).otherwise(9999)


def in_band(viewport: int) -> Column:
    """Whether a row's viewport is in the band of the one asked for; any for 0."""
    if viewport <= 0:
        return F.lit(True)
    wanted = 600 if viewport < 600 else 1024 if viewport < 1024 else 9999
    return band(F.col("viewport")) == wanted


def ranked(df: DataFrame, limit: int, measure: str = "events", label: str = "label") -> DataFrame:
    """Most first, ties by label: a top-k, never a whole sort."""
    return df.orderBy(F.desc(measure), F.asc(label)).limit(limit)


def uniques(c: str) -> Column:
    """Exact distinct values, '' not among them."""
    return F.count_distinct(F.when(F.col(c) != "", F.col(c)))
