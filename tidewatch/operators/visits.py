"""Questions on visits (sessions). One pass with partial aggregation by session; no sort of a session's rows.

The scan is half an hour wider than the range on either side, so that a visit that began before or goes on after it is
known to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.common import of_site, page_of, ranked, within
from tidewatch.plans.request import Request
from tidewatch.plans.timerange import Span
from tidewatch.schema import PAGEVIEW

IDLE_MS = 30 * 60_000
#: Upper bounds in seconds, with their labels.
LENGTHS = ((10, "under 10s"), (30, "10s to 30s"), (60, "30s to 1m"), (180, "1m to 3m"), (600, "3m to 10m"), (None, "over 10m"))


def visits(events: DataFrame, r: Request) -> DataFrame:
    """A row for each visit with a row in range: starts, complete, first and last time and page in range, counts."""
    wide = of_site(events, r.site, Span(r.start - IDLE_MS, r.end + IDLE_MS)).where(F.col("session") != "")
    inside = within(r.span)
    view = inside & (F.col("event") == PAGEVIEW)
    at = F.struct("ts_ms", "event_id", page_of().alias("page"))
    out = wide.groupBy("session").agg(
        F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"),
        F.min(F.when(inside, F.col("ts_ms"))).alias("in_first"), F.max(F.when(inside, F.col("ts_ms"))).alias("in_last"), F.count_if(inside).alias("n"),
        F.count_if(view).alias("views"), F.min(F.when(view, at)).alias("entry"), F.max(F.when(view, at)).alias("exit"),
    ).where("n > 0")
    return out.select("session", (F.col("first") >= r.start).alias("starts"), (F.col("last") < r.end).alias("complete"), "in_first", "in_last", "n", "views", F.col("entry.page").alias("entry"), F.col("exit.page").alias("exit"))


def _counted(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("visits"))


def _entries(events: DataFrame, r: Request) -> DataFrame:
    return visits(events, r).where("starts AND views > 0")


def entry_pages(events: DataFrame, r: Request) -> DataFrame:
    return ranked(_counted(_entries(events, r), "entry"), r.limit, "visits")


def entry_total(events: DataFrame, r: Request) -> DataFrame:
    return _entries(events, r).agg(F.count(F.lit(1)).alias("total"))


def exit_pages(events: DataFrame, r: Request) -> DataFrame:
    return ranked(_counted(_entries(events, r).where("complete"), "exit"), r.limit, "visits")


def pages_per_visit(events: DataFrame, r: Request) -> DataFrame:
    rows = _entries(events, r).where("complete").select(F.least("views", F.lit(10)).alias("pages"))
    return rows.groupBy("pages").agg(F.count(F.lit(1)).alias("visits")).select(F.when(F.col("pages") >= 10, "10+").otherwise(F.col("pages").cast("string")).alias("label"), "visits", "pages").orderBy("pages")


def visit_length(events: DataFrame, r: Request) -> DataFrame:
    rows = visits(events, r).where("starts AND complete AND n >= 2").select((F.col("in_last") - F.col("in_first")).alias("ms"))
    label = F.lit(LENGTHS[-1][1])
    for bound, name in reversed(LENGTHS[:-1]):
        label = F.when(F.col("ms") < bound * 1000, name).otherwise(label)
    return rows.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("visits"))
