"""Time on the driver: spans, whole hours and remainders, local days and periods, the span before.

Instants are epoch milliseconds. Local calendars come from ``zoneinfo``, so that days of 23 and 25 hours are what they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

HOUR_MS, DAY_MS = 3_600_000, 86_400_000
MAX_DAYS = 400


@dataclass(frozen=True)
class Span:
    """Half open: ``start <= t < end``."""

    start: int
    end: int


@dataclass(frozen=True)
class HourPlan:
    """Whole UTC hours as one span (None if there is none), and what is left on either side."""

    full: Span | None
    partial: tuple[Span, ...]


def to_ms(t: datetime) -> int:
    return int(t.timestamp() * 1000)


def local(ms: int, zone: str) -> datetime:
    return datetime.fromtimestamp(ms / 1000, ZoneInfo(zone))


def midnight(day: date, zone: str) -> int:
    return to_ms(datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(zone)))


def plan_hours(span: Span) -> HourPlan:
    first = -(-span.start // HOUR_MS) * HOUR_MS
    last = span.end // HOUR_MS * HOUR_MS
    if first >= last:
        return HourPlan(None, (span,) if span.start < span.end else ())
    sides = (Span(span.start, first), Span(last, span.end))
    return HourPlan(Span(first, last), tuple(s for s in sides if s.start < s.end))


def utc_dates(span: Span) -> tuple[str, str]:
    """First and last UTC date that a span touches, for partition pruning."""
    day = lambda ms: datetime.fromtimestamp(ms / 1000, ZoneInfo("UTC")).date().isoformat()
    return day(span.start), day(span.end)


def local_days(span: Span, zone: str) -> list[str]:
    """Every local day that the span touches, in order."""
    if span.start >= span.end:
        return []
    at, last = local(span.start, zone).date(), local(span.end - 1, zone).date()
    return [(at + timedelta(days=i)).isoformat() for i in range((last - at).days + 1)]


def period_key(day: str, period: str) -> str:
    """The day itself, or its ISO week where the period is "week"; any other period means day."""
    if period != "week":
        return day
    year, week, _ = date.fromisoformat(day).isocalendar()
    return f"{year:04d}-W{week:02d}"


def periods(span: Span, zone: str, period: str) -> list[str]:
    """Every calendar period that the span touches, in order."""
    return list(dict.fromkeys(period_key(d, period) for d in local_days(span, zone)))


def previous(span: Span, zone: str) -> Span:
    """As many calendar days before, if both ends are local midnights; else as much time before."""
    a, b = local(span.start, zone), local(span.end, zone)
    if a.time() == b.time() == datetime.min.time() and b.date() > a.date():
        days = min((b.date() - a.date()).days, MAX_DAYS + 1)
        return Span(midnight(a.date() - timedelta(days=days), zone), span.start)
    return Span(2 * span.start - span.end, span.start)


def visitors_daily(span: Span) -> bool:
    """Whether visitor ids, which rotate each UTC day, change within the span."""
    return span.start // DAY_MS != (span.end - 1) // DAY_MS
