from datetime import UTC, date, datetime

from tidewatch.plans.timerange import DAY_MS, HOUR_MS, Span, local_days, midnight, periods, plan_hours, previous, to_ms, utc_dates, visitors_daily

IST, KATHMANDU, NEW_YORK, BERLIN = "Asia/Kolkata", "Asia/Kathmandu", "America/New_York", "Europe/Berlin"


def test_ist_days_leave_two_half_hours():
    for days in (1, 7, 30):
        a = midnight(date(2026, 9, 1), IST)
        plan = plan_hours(Span(a, a + days * DAY_MS))
        assert (plan.full.end - plan.full.start) // HOUR_MS == 24 * days - 1
        assert [s.end - s.start for s in plan.partial] == [HOUR_MS // 2] * 2


def test_kathmandu_and_a_short_range():
    a = midnight(date(2026, 9, 1), KATHMANDU)
    assert len(plan_hours(Span(a, a + DAY_MS)).partial) == 2
    plan = plan_hours(Span(HOUR_MS + 1, HOUR_MS + 1_200_001))
    assert plan.full is None and plan.partial == (Span(HOUR_MS + 1, HOUR_MS + 1_200_001),)
    assert plan_hours(Span(5, 5)).partial == ()


def test_spring_forward_has_a_day_of_23_hours():
    span = Span(midnight(date(2026, 3, 7), NEW_YORK), midnight(date(2026, 3, 10), NEW_YORK))
    assert local_days(span, NEW_YORK) == ["2026-03-07", "2026-03-08", "2026-03-09"]
    assert span.end - span.start == 71 * HOUR_MS


def test_periods_by_the_calendar():
    a = to_ms(datetime(2026, 9, 1, 16, tzinfo=UTC))
    assert len(periods(Span(a, a + DAY_MS), "UTC", "day")) == 2
    wednesday = to_ms(datetime(2026, 9, 2, tzinfo=UTC))
    assert len(periods(Span(wednesday, wednesday + 21 * DAY_MS), "UTC", "week")) == 4
    assert periods(Span(a, a + 1), "UTC", "fortnight") == ["2026-09-01"]


def test_previous_keeps_calendar_days():
    span = Span(midnight(date(2026, 10, 19), BERLIN), midnight(date(2026, 10, 26), BERLIN))
    assert span.end - span.start == 169 * HOUR_MS
    assert previous(span, BERLIN) == Span(midnight(date(2026, 10, 12), BERLIN), span.start)
    assert previous(Span(10, 14), "UTC") == Span(6, 10)


def test_dates_and_daily_visitors():
    assert utc_dates(Span(0, DAY_MS)) == ("1970-01-01", "1970-01-02")
    assert not visitors_daily(Span(0, DAY_MS)) and visitors_daily(Span(0, DAY_MS + 1))
