"""Hand-made rows with hand-computed answers."""

import pytest

from tidewatch.operators import assistants, engagement, rollup, sequence, traffic, visits
from tidewatch.plans.engine import Engine
from tidewatch.plans.request import DenyAll, Refused, Request, SharedSecret, checked
from tidewatch.plans.timerange import DAY_MS, HOUR_MS
from tidewatch.schema import complete

T0 = 1_788_220_800_000  # 2026-09-01 00:00 UTC


def events(spark, rows):
    return complete(spark.createDataFrame([{"event_id": i, "site": "s", **r} for i, r in enumerate(rows)]))


def ask(widget, start=T0, end=T0 + 4 * DAY_MS, **more):
    return checked(Request(widget, "s", start, end, **more))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_funnel_ties_windows_and_order(spark):
    step = lambda v, t, e: {"visitor": v, "ts_ms": T0 + t, "event": e}
    day = 24 * HOUR_MS
    e = events(spark, [step("a", 0, "x"), step("a", 1, "y"), step("a", 2, "z"), step("b", 0, "x"), step("b", day, "y"), step("c", 0, "x"), step("c", day + 1, "y"), step("d", 5, "y"), step("d", 5, "x"), step("e", 0, "x"), step("e", 0, "y"), step("", 0, "x")])
    assert [r[2] for r in rows(sequence.funnel(e, ask("funnel", steps=("x", "y", "z"))))] == [5, 2, 1]
    assert [r[2] for r in rows(sequence.funnel(e, ask("funnel", steps=("nothing", "y"))))] == [0, 0]


def _days(*active):
    return [{"visitor": v, "ts_ms": T0 + d * DAY_MS, "event": "$pageview"} for v, d in active]


def test_retention_stickiness_lifecycle(spark):
    e = events(spark, _days(("a", 0), ("a", 1), ("a", 3), ("b", 0), ("c", 1), ("c", 2)))
    got = {(c, o): n for c, o, n in rows(sequence.retention(e, ask("retention")))}
    assert len(got) == 10 and got["2026-09-01", 0] == 2 and got["2026-09-01", 1] == 1 and got["2026-09-01", 3] == 1 and got["2026-09-02", 1] == 1 and got["2026-09-04", 0] == 0
    assert rows(sequence.stickiness(e, ask("stickiness"))) == [(1, 1), (2, 1), (3, 1)]
    assert rows(sequence.lifecycle(e, ask("lifecycle"))) == [("2026-09-01", 2, 0, 0, 0), ("2026-09-02", 1, 1, 0, 1), ("2026-09-03", 0, 1, 0, 1), ("2026-09-04", 0, 0, 1, 1)]


def test_visits_at_both_edges(spark):
    view = lambda s, t, p: {"session": s, "ts_ms": t, "event": "$pageview", "path": p}
    end = T0 + 4 * DAY_MS
    e = events(spark, [view("in", T0 + 10, "/a"), view("in", T0 + 20_010, "/b"), view("early", T0 - 5, "/a"), view("early", T0 + 5, "/c"), view("late", end - 5, "/a"), view("late", end + 5, "/d"), view("out", T0 - 10, "/e"), view("", T0 + 1, "/f")])
    r = ask("entryPages")
    assert rows(visits.entry_pages(e, r)) == [("/a", 2)]
    assert rows(visits.exit_pages(e, r)) == [("/b", 1)]
    assert rows(visits.pages_per_visit(e, r)) == [("2", 1, 2)]
    assert rows(visits.visit_length(e, r)) == [("10s to 30s", 1)]


def test_scroll(spark):
    e = events(spark, [{"ts_ms": T0 + i, "event": "$scroll", "path": "/p", "scroll_pct": p, "viewport_h": 500, "doc_h": d} for i, (p, d) in enumerate([(10, 1000), (30, 1000), (60, 1000), (95, 1000), (100, 1000), (50, 0)])])
    r = ask("scrollDepth", path="/p")
    assert [n for _, n in rows(engagement.scroll_depth(e, r))] == [4, 3, 2, 2, 1]
    assert rows(engagement.scroll_summary(e, r)) == [(5, 59.0, 60, 50)]
    assert rows(engagement.scroll_summary(e, ask("scrollDepth", path="/none"))) == [(0, 0.0, 0, 0)]


def _click(s, t, x, y, live=1):
    return {"session": s, "ts_ms": T0 + t, "event": "$click", "path": "/p", "click_x": x, "click_y": y, "viewport": 1440, "interactive": live}


def test_rage_runs_and_spots(spark):
    e = events(spark, [_click("a", t, 500 + t // 10, 100) for t in (0, 200, 400, 600)] + [_click("b", 0, 10, 10), _click("b", 100, 10, 10)] + [_click("c", 2000 * i, 50, 50) for i in range(5)])
    r = ask("clickFriction", path="/p")
    assert rows(engagement.rage_spots(e, r)) == [(500, 100, 4, 1)]
    # A run is measured from its first click: one that drifts is cut.
    drift = events(spark, [_click("a", 200 * i, 150 * i, 0) for i in range(6)])
    assert rows(engagement.rage_cells(drift, r).orderBy("x")) == [(0, 0, 3, 1), (400, 0, 3, 1)]
    # Clicks without a session share one.
    assert rows(engagement.rage_cells(events(spark, [_click("", i, 0, 0) for i in range(3)]), r)) == [(0, 0, 3, 1)]


def test_dead_clicks_need_a_measure(spark):
    r = ask("clickFriction", path="/p")
    dead = [_click("a", 0, 0, 0, 0), _click("b", 1, 110, 30, 0), _click("b", 2, 900, 900, 0), _click("b", 3, 110, 31, 0)]
    assert rows(engagement.dead_spots(events(spark, dead), r)) == []
    assert rows(engagement.dead_spots(events(spark, [*dead, _click("c", 9, 5, 5)]), r)) == [(100, 20, 3, 2), (900, 900, 1, 1)]


def test_crawlers_and_referrals(spark):
    hit = lambda i, bot, path, status, ch="ai": {"site": "s.crawl", "ts_ms": T0 + i, "event": "$crawl", "label": bot, "path": path, "channel": ch, "props": status}
    e = complete(spark.createDataFrame([{"event_id": i, **h} for i, h in enumerate([hit(0, "GPTBot", "/a", '{"status":200}'), hit(1, "GPTBot", "/a", '{"status":404}'), hit(2, "GPTBot", "/b", '"{\\"status\\":200}"'), hit(3, "ClaudeBot", "/a", ""), hit(4, "Googlebot", "/a", '{"status":500}', "crawler")])]))
    r = ask("crawlerVisits")
    assert [(b, n, p) for b, _, n, p, _ in rows(assistants.crawl_bots(e, r))] == [("GPTBot", 3, 2), ("ClaudeBot", 1, 1), ("Googlebot", 1, 1)]
    assert rows(assistants.crawl_pages(e, r))[0][:6] == ("GPTBot", True, "/a", 2, 1, 404)
    assert rows(assistants.crawl_days(e, r)) == [("2026-09-01", 5, 4)]
    assert len(rows(assistants.crawl_bots(e, ask("crawlerVisits", ai_only=True)))) == 2
    view = lambda t, s, host, src="", ch="ai": {"ts_ms": T0 + t, "event": "$pageview", "session": s, "visitor": "v" + s, "referrer_host": host, "utm_source": src, "channel": ch, "path": f"/{t}"}
    e = events(spark, [view(2, "a", "chatgpt.com"), view(1, "a", "www.perplexity.ai"), view(3, "b", "", "gemini"), view(4, "c", "chatgpt.com", ch="paid"), view(5, "", "claude.ai"), view(6, "d", "google.com")])
    r = ask("aiReferrals")
    assert {x[0]: x[3] for x in rows(assistants.ai_sources(e, r))} == {"ChatGPT": 1, "Perplexity": 1, "Gemini": 1, "Claude": 1}
    assert ("Perplexity", "/1", 1) in rows(assistants.ai_landing(e, r))
    assert rows(assistants.ai_totals(e, r)) == [(4, 3, 3)]


def test_rollups_answer_as_raw_rows_do(spark, sf):
    from tidewatch.sources import adapter

    e = adapter.events(spark, sf)
    near = Engine(e, rollup.build(e))
    for start in (1_704_844_800_000, 1_704_844_800_000 - 20_700_000, 1_704_844_860_001):
        r = Request("topPages", adapter.SITE, start, start + 9 * DAY_MS)
        assert rows(near.answer(r).sections["rows"].select("label", "events")) == rows(Engine(e).answer(r).sections["rows"].select("label", "events"))
        assert rows(near.answer(r).sections["total"]) == rows(Engine(e).answer(r).sections["total"])


def test_compare_blanks_and_new_labels(spark):
    e = events(spark, [{"ts_ms": T0 + DAY_MS, "event": "$pageview", "path": "/new", "visitor": "a"}, {"ts_ms": T0, "event": "$pageview", "path": "/gone", "visitor": "a"}])
    r = ask("topPages", T0 + DAY_MS, T0 + 2 * DAY_MS, compare="previous")
    assert [(x["label"], x["events"], x["previous"]) for x in traffic.compare_breakdown(e, r).collect()] == [("/new", 1, 0)]
    assert rows(traffic.compare_total(e, r)) == [(1,)]


@pytest.mark.parametrize(
    "bad",
    [dict(widget="nothing"), dict(end=T0), dict(end=T0 + 401 * DAY_MS), dict(timezone="Mars/Base"), dict(widget="breakdownByProperty", dimension="visitor"), dict(widget="funnel", steps=("a",)), dict(widget="funnel", steps=("a", "b"), window_hours=25), dict(widget="heatmap"), dict(widget="funnel", steps=("a", "b"), compare="previous"), dict(compare="last"), dict(site="")],
)
def test_refusals(bad):
    with pytest.raises(Refused):
        checked(Request(**{"widget": "topPages", "site": "s", "start": T0, "end": T0 + DAY_MS, **bad}))


def test_authorizers(spark):
    e = events(spark, [{"ts_ms": T0, "event": "$pageview", "path": "/"}])
    with pytest.raises(PermissionError):
        Engine(e).query(ask("topPages"), "any")
    assert not DenyAll().allows("x", "s")
    assert Engine(e, authorizer=SharedSecret("x")).query(ask("topPages"), "x").sections["rows"].count() == 1


def test_wire(spark):
    import json

    from tidewatch.plans import wire

    e = events(spark, [{"ts_ms": T0 + 1, "event": "$pageview", "path": "/", "visitor": "a"}])
    body = {"widget": "topPages", "site": "s", "from": "2026-09-01T00:00:00Z", "to": "2026-09-02T00:00:00+00:00", "timezone": "Asia/Kolkata", "limit": 5}
    r = wire.parse(json.dumps(body).encode())
    assert (r.start, r.end, r.limit, r.event) == (T0, T0 + DAY_MS, 5, "$pageview")
    out = json.loads(wire.to_json(Engine(e).answer(r)))
    assert out["rows"] == [{"label": "/", "events": 1, "visitors": 1}] and out["total"] == [{"total": 1}]
    for bad in (b"x", b"[]", b" " * 70_000, json.dumps({**body, "from": "yesterday"}).encode(), json.dumps({**body, "to": "2026-09-02T00:00:00"}).encode(), json.dumps({**body, "limit": "x"}).encode()):
        with pytest.raises(Refused):
            wire.parse(bad)
