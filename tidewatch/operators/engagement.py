"""Scroll depth, click heatmaps, and click friction: dead clicks and rage runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.common import band, in_band, of_site, on_page, page_of, ranked
from tidewatch.plans.request import Request
from tidewatch.schema import CLICK, SCROLL

DEPTHS = (25, 50, 75, 90, 100)
CELL_X, CELL_Y = 100, 20
RUN_MS, RUN_X, RUN_Y, RUN_CLICKS = 1000, 300, 2 * CELL_Y, 3


def _scrolls(events: DataFrame, r: Request) -> DataFrame:
    out = of_site(events, r.site, r.span).where((F.col("event") == SCROLL) & (F.col("doc_h") > 0) & on_page(r.page, r.path) & in_band(r.viewport))
    return out.where(F.col("variant") == r.variant) if r.variant else out


def scroll_depth(events: DataFrame, r: Request) -> DataFrame:
    """label, events: how many views reached each depth."""
    counts = _scrolls(events, r).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("scroll_pct") >= d).alias(f"d{d}") for d in DEPTHS)).where("n > 0")
    return counts.select(F.inline(F.array(*(F.struct(F.lit(f"{d}%").alias("label"), F.col(f"d{d}").alias("events")) for d in DEPTHS))))


def scroll_summary(events: DataFrame, r: Request) -> DataFrame:
    """views, average_pct, median_pct (the lower one), fold_pct (lower median of what shows unscrolled)."""
    fold = F.when(F.col("viewport_h") > 0, F.expr("viewport_h * 100L div doc_h"))
    rows = _scrolls(events, r).select("scroll_pct", fold.alias("fold"))
    return rows.agg(F.count(F.lit(1)).alias("views"), F.coalesce(F.avg("scroll_pct"), F.lit(0.0)).alias("average_pct"), F.expr("CAST(coalesce(percentile_disc(0.5) WITHIN GROUP (ORDER BY scroll_pct), 0) AS INT)").alias("median_pct"), F.expr("CAST(coalesce(percentile_disc(0.5) WITHIN GROUP (ORDER BY fold), 0) AS INT)").alias("fold_pct"))


def _by_page(rows: DataFrame) -> DataFrame:
    """A row for each named page, with its least path, and for each path without a name."""
    return rows.groupBy(page_of().alias("label"), "page", F.when(F.col("page") == "", F.col("path")).otherwise("").alias("_p")).agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.min(F.when(F.col("path") != "", F.col("path"))), F.lit("")).alias("path")).select("label", "page", "path", "events")


def scroll_pages(events: DataFrame, r: Request) -> DataFrame:
    return ranked(_by_page(of_site(events, r.site, r.span).where((F.col("event") == SCROLL) & (F.col("doc_h") > 0))), r.limit)


def heatmap_pages(events: DataFrame, r: Request) -> DataFrame:
    return ranked(_by_page(of_site(events, r.site, r.span).where((F.col("event") == CLICK) & (F.col("viewport") > 0))), r.limit)


def _all_clicks(events: DataFrame, r: Request) -> DataFrame:
    return of_site(events, r.site, r.span).where((F.col("event") == CLICK) & (F.col("viewport") > 0) & on_page(r.page, r.path))


def _clicks(events: DataFrame, r: Request) -> DataFrame:
    out = _all_clicks(events, r).where(in_band(r.viewport))
    return out.where(F.col("variant") == r.variant) if r.variant else out


def _cell() -> list:
    return [F.expr(f"CAST(click_x div {CELL_X} * {CELL_X} AS INT)").alias("x"), F.expr(f"CAST(click_y div {CELL_Y} * {CELL_Y} AS INT)").alias("y")]


def heatmap_cells(events: DataFrame, r: Request) -> DataFrame:
    return _clicks(events, r).groupBy(*_cell()).agg(F.count(F.lit(1)).alias("clicks")).orderBy("y", "x")


def heatmap_summary(events: DataFrame, r: Request) -> DataFrame:
    """clicks and max of the filtered clicks; variants and viewports of all that the page has."""
    cells = _clicks(events, r).groupBy(*_cell()).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("clicks"), F.coalesce(F.max("n"), F.lit(0)).alias("max"))
    seen = _all_clicks(events, r).agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("variant") != "", F.col("variant")))), ",").alias("variants"), F.array_join(F.array_sort(F.collect_set(band(F.col("viewport")))), ",").alias("viewports"))
    return cells.join(F.broadcast(seen), F.lit(True))  # one row each


def friction_summary(events: DataFrame, r: Request) -> DataFrame:
    """clicks, measured: whether any click says that it met something live, without which dead ones can't be told."""
    return _clicks(events, r).agg(F.count(F.lit(1)).alias("clicks"), F.coalesce(F.max("interactive") == 1, F.lit(False)).alias("measured"))


def dead_cells(events: DataFrame, r: Request) -> DataFrame:
    """x, y, clicks, sessions of clicks that met nothing; no row where that isn't measured."""
    clicks = _clicks(events, r)
    measured = clicks.where("interactive = 1").select(F.lit(1).alias("_m")).limit(1)
    cells = clicks.where("interactive = 0").groupBy(*_cell()).agg(F.count(F.lit(1)).alias("clicks"), F.count_distinct("session").alias("sessions"))
    return cells.withColumn("_m", F.lit(1)).join(F.broadcast(measured), "_m", "left_semi").drop("_m")


def rage_cells(events: DataFrame, r: Request) -> DataFrame:
    """x, y, clicks, sessions by the cell of a run's first click.

    A run holds the clicks of a session that follow its first within a second and near it. No run crosses a pause of
    more than that, so a session is cut at its pauses first, and only stretches of enough clicks are gathered and
    walked through.
    """
    w = Window.partitionBy("session").orderBy("ts_ms", "event_id")
    clicks = _clicks(events, r).select("session", "ts_ms", "event_id", "click_x", "click_y")
    pause = F.coalesce(F.col("ts_ms") - F.lag("ts_ms").over(w) > RUN_MS, F.lit(True))
    cut = clicks.withColumn("_new", pause.cast("int")).withColumn("_part", F.sum("_new").over(w))
    parts = cut.groupBy("session", "_part").agg(F.collect_list(F.struct("ts_ms", "event_id", "click_x", "click_y")).alias("c")).where(F.size("c") >= RUN_CLICKS)
    state = "struct<t: bigint, x: int, y: int, n: bigint, runs: array<struct<x: int, y: int, n: bigint>>>"
    close = f"CASE WHEN a.n >= {RUN_CLICKS} THEN array_append(a.runs, named_struct('x', a.x, 'y', a.y, 'n', a.n)) ELSE a.runs END"
    runs = f"""aggregate(array_sort(c), CAST(named_struct('t', CAST(NULL AS BIGINT), 'x', 0, 'y', 0, 'n', 0L, 'runs', array()) AS {state}),
        (a, k) -> CASE WHEN k.ts_ms - a.t <= {RUN_MS} AND abs(k.click_x - a.x) <= {RUN_X} AND abs(k.click_y - a.y) <= {RUN_Y}
            THEN named_struct('t', a.t, 'x', a.x, 'y', a.y, 'n', a.n + 1L, 'runs', a.runs)
            ELSE named_struct('t', k.ts_ms, 'x', k.click_x, 'y', k.click_y, 'n', 1L, 'runs', {close}) END,
        a -> {close})"""
    found = parts.select("session", F.inline(F.expr(runs)))
    return found.groupBy(F.expr(f"CAST(x div {CELL_X} * {CELL_X} AS INT)").alias("x"), F.expr(f"CAST(y div {CELL_Y} * {CELL_Y} AS INT)").alias("y")).agg(F.sum("n").alias("clicks"), F.count_distinct("session").alias("sessions"))


def spots(cells: DataFrame) -> DataFrame:
    """Cells that touch, corners too, as one spot: clicks and sessions added, at the cell of most clicks.

    Cells lie on the grid of one page, whose coordinates are clamped at ingest: a bound of about a million cells.
    """

    def join(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(parts)
        at = {(x, y): i for i, (x, y) in enumerate(zip(pdf["x"], pdf["y"], strict=True))}
        root = list(range(len(at)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for (x, y), i in at.items():
            for dx, dy in ((CELL_X, 0), (0, CELL_Y), (CELL_X, CELL_Y), (CELL_X, -CELL_Y)):
                j = at.get((x + dx, y + dy))
                if j is not None:
                    root[find(i)] = find(j)
        pdf["root"] = [find(i) for i in range(len(at))]
        best = pdf.sort_values(["clicks", "y", "x"], ascending=[False, True, True]).groupby("root", sort=False).first()[["x", "y"]]
        yield best.join(pdf.groupby("root")[["clicks", "sessions"]].sum())[["x", "y", "clicks", "sessions"]]

    out = cells.select("x", "y", "clicks", "sessions").coalesce(1).mapInPandas(lambda parts: (p for p in join(_some(parts))), "x int, y int, clicks long, sessions long")
    return out.orderBy(F.desc("sessions"), F.desc("clicks"), "y", "x")


def _some(parts: Iterator[pd.DataFrame]) -> list[pd.DataFrame]:
    found = list(parts)
    return found or [pd.DataFrame({"x": pd.Series(dtype="int32"), "y": pd.Series(dtype="int32"), "clicks": pd.Series(dtype="int64"), "sessions": pd.Series(dtype="int64")})]


def dead_spots(events: DataFrame, r: Request) -> DataFrame:
    return spots(dead_cells(events, r))


def rage_spots(events: DataFrame, r: Request) -> DataFrame:
    return spots(rage_cells(events, r))
