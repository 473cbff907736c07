"""From a request to the DataFrames that answer it; what can come from rollups does."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import assistants, engagement, rollup, sequence, traffic, visits
from tidewatch.plans.request import BREAKDOWNS, ROLLED, Authorizer, DenyAll, Refused, Request, checked
from tidewatch.plans.timerange import Span, plan_hours, previous, visitors_daily
from tidewatch.schema import PAGEVIEW


@dataclass
class Answer:
    """One lazy DataFrame for each section."""

    sections: dict[str, DataFrame]
    visitors_daily: bool = False
    range_relative: bool = False
    raw_spans: int = 0
    previous: Span | None = None


@dataclass
class Engine:
    events: DataFrame
    rollups: DataFrame | None = None
    authorizer: Authorizer = field(default_factory=DenyAll)

    def query(self, request: Request, token: str = "") -> Answer:
        if not self.authorizer.allows(token, request.site):
            raise PermissionError("not allowed to read this site")
        return self.answer(request)

    def answer(self, request: Request) -> Answer:
        r = checked(request)
        e = self.events
        out = Answer(self._sections(e, r), visitors_daily(r.span), r.widget == "lifecycle")
        if r.compare:
            out.previous = previous(r.span, r.timezone)
        if self.rollups is not None and self._rolled(r):
            out.raw_spans = len(plan_hours(r.span).partial)
        return out

    def _rolled(self, r: Request) -> bool:
        return not r.compare and r.widget in ROLLED

    def _audience(self, r: Request) -> DataFrame:
        if self.rollups is not None:
            return rollup.audience(self.events, self.rollups, r.site, r.span, PAGEVIEW)
        return traffic.audience(self.events, r)

    def _sections(self, e: DataFrame, r: Request) -> dict[str, DataFrame]:
        if self.rollups is not None and self._rolled(r):
            if r.widget in ("pageviewsOverTime", "eventTimeline"):
                rows = rollup.over_time(e, self.rollups, r.site, r.span, r.timezone, r.event)
                return {"rows": rows, "total": rows.agg(F.coalesce(F.sum("events"), F.lit(0)).alias("total")), "audience": self._audience(r)}
            if r.widget == "topEvents":
                return {"rows": rollup.top_events(e, self.rollups, r.site, r.span, r.limit), "audience": self._audience(r)}
        match r.widget:
            case "pageviewsOverTime" | "eventTimeline":
                rows = traffic.compare_timeline(e, r) if r.compare else traffic.over_time(e, r)
                return {"rows": rows, "total": traffic.period_total(e, r), "audience": self._audience(r)}
            case "topEvents":
                rows = traffic.compare_top_events(e, r) if r.compare else traffic.top_events(e, r)
                return {"rows": rows, "total": traffic.period_total(e, r, any_event=True), "audience": self._audience(r)}
            case "funnel":
                return {"rows": sequence.funnel(e, r)}
            case "retention":
                return {"rows": sequence.retention(e, r)}
            case "stickiness":
                return {"rows": sequence.stickiness(e, r)}
            case "lifecycle":
                return {"rows": sequence.lifecycle(e, r)}
            case "entryPages":
                return {"rows": visits.entry_pages(e, r), "total": visits.entry_total(e, r)}
            case "exitPages":
                return {"rows": visits.exit_pages(e, r)}
            case "pagesPerVisit":
                return {"rows": visits.pages_per_visit(e, r)}
            case "visitLength":
                return {"rows": visits.visit_length(e, r)}
            case "scrollDepth":
                return {"rows": engagement.scroll_depth(e, r), "summary": engagement.scroll_summary(e, r)}
            case "scrollPages":
                return {"rows": engagement.scroll_pages(e, r)}
            case "heatmap":
                return {"cells": engagement.heatmap_cells(e, r), "summary": engagement.heatmap_summary(e, r)}
            case "heatmapPages":
                return {"rows": engagement.heatmap_pages(e, r)}
            case "clickFriction":
                return {"summary": engagement.friction_summary(e, r), "dead": engagement.dead_spots(e, r), "rage": engagement.rage_spots(e, r)}
            case "crawlerVisits":
                return {"bots": assistants.crawl_bots(e, r), "pages": assistants.crawl_pages(e, r), "days": assistants.crawl_days(e, r)}
            case "aiReferrals":
                return {"rows": assistants.ai_sources(e, r), "landing": assistants.ai_landing(e, r), "days": assistants.ai_days(e, r), "totals": assistants.ai_totals(e, r), "audience": self._audience(r)}
        dim = r.dimension or BREAKDOWNS.get(r.widget)
        if dim is None:
            raise Refused(f"unknown question {r.widget!r}")
        if r.compare:
            return {"rows": traffic.compare_breakdown(e, r), "total": traffic.total(e, r), "previous_total": traffic.compare_total(e, r)}
        if self.rollups is not None:
            return {"rows": rollup.breakdown(e, self.rollups, r.site, r.span, r.event, dim, r.limit), "total": rollup.total(e, self.rollups, r.site, r.span, r.event, dim)}
        return {"rows": traffic.breakdown(e, r), "total": traffic.total(e, r)}
