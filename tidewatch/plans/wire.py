"""Requests and answers as JSON: what a thin service in front of the engine would read and write."""

from __future__ import annotations

import json
from datetime import datetime

from tidewatch.plans.engine import Answer
from tidewatch.plans.request import Refused, Request, checked

MAX_BODY = 64 << 10
_FIELDS = {"widget": "widget", "site": "site", "timezone": "timezone", "event": "event", "property": "dimension", "windowHours": "window_hours", "period": "period", "page": "page", "path": "path", "variant": "variant", "viewport": "viewport", "aiOnly": "ai_only", "compare": "compare", "limit": "limit"}


def _instant(text: object, name: str) -> int:
    try:
        at = datetime.fromisoformat(str(text))
    except ValueError as e:
        raise Refused(f"{name} is not an RFC 3339 time") from e
    if at.tzinfo is None:
        raise Refused(f"{name} has no offset from UTC")
    return int(at.timestamp() * 1000)


def parse(body: bytes) -> Request:
    """The checked request of a JSON body; raises :class:`Refused`."""
    if len(body) > MAX_BODY:
        raise Refused("the body is too large")
    try:
        raw = json.loads(body)
    except ValueError as e:
        raise Refused("the body is not JSON") from e
    if not isinstance(raw, dict):
        raise Refused("the body is not an object")
    known = {ours: raw[theirs] for theirs, ours in _FIELDS.items() if raw.get(theirs) is not None}
    try:
        return checked(Request(**{"widget": "", "site": "", **known}, start=_instant(raw.get("from"), "from"), end=_instant(raw.get("to"), "to"), steps=tuple(raw.get("steps") or ())))
    except (TypeError, AttributeError) as e:
        raise Refused("a field has the wrong type") from e


def to_json(answer: Answer) -> str:
    """All sections, collected: an answer has as many rows as its limits, days or grids allow."""
    sections = {name: [json.loads(r) for r in df.toJSON().collect()] for name, df in answer.sections.items()}
    return json.dumps({**sections, "visitorsDaily": answer.visitors_daily, "rangeRelative": answer.range_relative, "rawSpans": answer.raw_spans})
