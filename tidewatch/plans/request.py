"""What a question may say, and the refusals; nothing here touches data."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Protocol
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from tidewatch.plans.timerange import DAY_MS, MAX_DAYS, Span
from tidewatch.schema import DIMENSIONS, PAGEVIEW

BREAKDOWNS = {"topPages": "path", "topReferrers": "referrer_host", "channelBreakdown": "channel", "deviceBreakdown": "device", "browserBreakdown": "browser", "osBreakdown": "os", "geoBreakdown": "country", "platformBreakdown": "platform", "appVersionBreakdown": "app_version"}
#: Questions that rollups can answer, and that compare with the span before.
ROLLED = ("pageviewsOverTime", "eventTimeline", *BREAKDOWNS, "breakdownByProperty", "topEvents")
RAW = ("funnel", "retention", "stickiness", "lifecycle", "entryPages", "exitPages", "pagesPerVisit", "visitLength", "scrollDepth", "scrollPages", "heatmap", "heatmapPages", "clickFriction", "crawlerVisits", "aiReferrals")
NEED_PAGE = ("scrollDepth", "heatmap", "clickFriction")
MAX_WINDOW_HOURS = 24


class Refused(ValueError):
    """The question can't be asked."""


@dataclass(frozen=True)
class Request:
    widget: str
    site: str
    start: int
    end: int
    timezone: str = "UTC"
    event: str | None = None
    dimension: str | None = None
    steps: tuple[str, ...] = ()
    window_hours: int = 0
    period: str = "day"
    page: str = ""
    path: str = ""
    variant: str = ""
    viewport: int = 0
    ai_only: bool = False
    compare: str = ""
    limit: int = 10

    @property
    def span(self) -> Span:
        return Span(self.start, self.end)


class Authorizer(Protocol):
    def allows(self, token: str, site: str) -> bool: ...


class DenyAll:
    """What holds unless another one is given."""

    def allows(self, token: str, site: str) -> bool:
        return False


class SharedSecret:
    def __init__(self, secret: str):
        if not secret:
            raise Refused("a shared secret must not be empty")
        self.secret = secret

    def allows(self, token: str, site: str) -> bool:
        import hmac

        return hmac.compare_digest(token.encode(), self.secret.encode())


def checked(r: Request) -> Request:
    """The request with its defaults; raises :class:`Refused`."""
    if r.widget not in ROLLED and r.widget not in RAW:
        raise Refused(f"unknown question {r.widget!r}")
    if not r.site:
        raise Refused("a site is required")
    if r.end <= r.start:
        raise Refused("the range is empty")
    if r.end - r.start > MAX_DAYS * DAY_MS:
        raise Refused(f"a range is at most {MAX_DAYS} days")
    try:
        ZoneInfo(r.timezone or "UTC")
    except (ZoneInfoNotFoundError, ValueError) as e:
        raise Refused(f"unknown timezone {r.timezone!r}") from e
    if r.widget == "breakdownByProperty" and r.dimension not in DIMENSIONS:
        raise Refused(f"{r.dimension!r} is not a dimension")
    if r.widget == "funnel":
        if not 2 <= len(r.steps) <= 10 or not all(r.steps):
            raise Refused("a funnel has 2 to 10 steps")
        if not 0 <= r.window_hours <= MAX_WINDOW_HOURS:
            raise Refused(f"a funnel's window is at most {MAX_WINDOW_HOURS} hours")
    if r.widget in NEED_PAGE and not (r.page or r.path):
        raise Refused("a page or a path is required")
    if r.compare and (r.compare != "previous" or r.widget not in ROLLED):
        raise Refused("only rolled-up questions compare, and only with the previous span")
    event = r.event or (PAGEVIEW if r.widget in ROLLED else None)
    return replace(r, timezone=r.timezone or "UTC", event=event, limit=r.limit if r.limit > 0 else 10, window_hours=r.window_hours or MAX_WINDOW_HOURS)
