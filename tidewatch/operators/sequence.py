"""Questions on what each visitor did in order: funnel, retention, stickiness, lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.common import local_day, of_site, period_of
from tidewatch.plans.request import Request
from tidewatch.plans.timerange import HOUR_MS, periods


def funnel(events: DataFrame, r: Request) -> DataFrame:
    """step, event, visitors, from_previous, from_first.

    Anchored on a visitor's first step 1; each next step is the first after the one before (strictly), until the
    window's end (inclusive). The chain of windows shares one shuffle and one sort by visitor, and the count by
    visitor after it needs neither again.
    """
    rows = of_site(events, r.site, r.span).where((F.col("visitor") != "") & F.col("event").isin(*set(r.steps))).select("visitor", "event", "ts_ms")
    w = Window.partitionBy("visitor")
    rows = rows.withColumn("_t0", F.min(F.when(F.col("event") == r.steps[0], F.col("ts_ms"))).over(w))
    for i, step in enumerate(r.steps[1:], 1):
        reached = (F.col("event") == step) & (F.col("ts_ms") > F.col(f"_t{i - 1}")) & (F.col("ts_ms") <= F.col("_t0") + r.window_hours * HOUR_MS)
        rows = rows.withColumn(f"_t{i}", F.min(F.when(reached, F.col("ts_ms"))).over(w))
    each = rows.groupBy("visitor").agg(*(F.max(F.col(f"_t{i}").isNotNull().cast("int")).alias(f"_r{i}") for i in range(len(r.steps))))
    sums = each.agg(*(F.coalesce(F.sum(f"_r{i}"), F.lit(0)).alias(f"_n{i}") for i in range(len(r.steps))))
    n = [F.col(f"_n{i}") for i in range(len(r.steps))]
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    table = F.array(*(F.struct(F.lit(i + 1).alias("step"), F.lit(s).alias("event"), n[i].alias("visitors"), (ratio(n[i], n[i - 1]) if i else F.lit(1.0)).alias("from_previous"), ratio(n[i], n[0]).alias("from_first")) for i, s in enumerate(r.steps)))
    return sums.select(F.inline(table))


def _active(events: DataFrame, r: Request) -> tuple[DataFrame, list[str]]:
    """Distinct (visitor, index of an active period), and the periods."""
    names = periods(r.span, r.timezone, r.period)
    index = events.sparkSession.createDataFrame([(p, i) for i, p in enumerate(names)], "period string, i int")  # at most 401 rows
    rows = of_site(events, r.site, r.span).where(F.col("visitor") != "")
    if r.event:
        rows = rows.where(F.col("event") == r.event)
    days = rows.select("visitor", local_day(r.timezone).alias("day")).distinct()
    return days.select("visitor", period_of(F.col("day"), r.period).alias("period")).distinct().join(F.broadcast(index), "period").select("visitor", "i"), names


def retention(events: DataFrame, r: Request) -> DataFrame:
    """cohort, offset, visitors: of each first active period, how many were active so many periods later. Row i has n - i values."""
    active, names = _active(events, r)
    firsts = active.withColumn("first", F.min("i").over(Window.partitionBy("visitor")))
    found = firsts.groupBy("first", (F.col("i") - F.col("first")).alias("offset")).agg(F.count(F.lit(1)).alias("visitors"))
    grid = events.sparkSession.createDataFrame([(p, i, k) for i, p in enumerate(names) for k in range(len(names) - i)], "cohort string, first int, offset int")
    return grid.join(found, ["first", "offset"], "left").na.fill(0, ["visitors"]).select("cohort", "offset", "visitors").orderBy("cohort", "offset")


def stickiness(events: DataFrame, r: Request) -> DataFrame:
    """periods, visitors: how many visitors were active in so many periods."""
    active, _ = _active(events, r)
    return active.groupBy("visitor").agg(F.count(F.lit(1)).alias("periods")).groupBy("periods").agg(F.count(F.lit(1)).alias("visitors")).orderBy("periods")


def lifecycle(events: DataFrame, r: Request) -> DataFrame:
    """period, new, returning, resurrecting, dormant; from active periods alone, without a row for idle ones.

    An active period is new if it is the first, returning if the one before was active, else resurrecting; the first
    idle period after an active one is dormant.
    """
    active, names = _active(events, r)
    w = Window.partitionBy("visitor").orderBy("i")
    rows = active.select("i", F.lag("i").over(w).alias("before"), F.lead("i").over(w).alias("after"))
    state = F.when(F.col("before").isNull(), "new").when(F.col("before") == F.col("i") - 1, "returning").otherwise("resurrecting")
    idle = (F.col("after").isNull() | (F.col("after") > F.col("i") + 1)) & (F.col("i") + 1 < len(names))
    marks = rows.select(F.inline(F.array(F.struct(F.col("i").alias("i"), state.alias("state")), F.struct(F.when(idle, F.col("i") + 1).alias("i"), F.lit("dormant").alias("state")))))
    states = ("new", "returning", "resurrecting", "dormant")
    found = marks.where("i IS NOT NULL").groupBy("i").agg(*(F.count_if(F.col("state") == s).alias(s) for s in states))
    index = events.sparkSession.createDataFrame([(p, i) for i, p in enumerate(names)], "period string, i int")
    return index.join(found, "i", "left").na.fill(0).select("period", *states).orderBy("period")
