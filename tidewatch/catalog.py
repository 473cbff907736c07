"""Every question as a named query over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import enrich
from tidewatch.operators import assistants, engagement, rollup, sequence, traffic, visits
from tidewatch.operators.common import local_day, of_site, period_of, uniques
from tidewatch.plans.request import Request, checked
from tidewatch.plans.timerange import HOUR_MS, Span, local, local_days, midnight, period_key, plan_hours, previous
from tidewatch.schema import DIMENSIONS
from tidewatch.sources import adapter
from tidewatch.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
#: 2024-01-10 to 24 UTC.
START, END = 1_704_844_800_000, 1_706_054_400_000
IST, NEW_YORK = "Asia/Kolkata", "America/New_York"
IST_START, IST_END = START - 19_800_000, END - 19_800_000
EV = f"WITH {adapter.events_sql()}"
STEPS = ("$pageview", "$click", "purchase")


def _ask(widget: str, start: int = START, end: int = END, **more) -> Request:
    return checked(Request(widget, adapter.SITE, start, end, **more))


def _on(fn: Callable[[DataFrame, Request], DataFrame], r: Request) -> Query:
    return lambda spark, d: fn(adapter.events(spark, d), r)


def _in(r: Request, event: str | None = "$pageview") -> str:
    return f"ts_ms >= {r.start} AND ts_ms < {r.end}" + (f" AND event = '{event}'" if event else "")


def _days_sql(span: Span, zone: str) -> str:
    """(day, a, b) of each local day, with its bounds; the calendar is the driver's, not the other engine's."""
    from datetime import date, timedelta

    rows = []
    for d in local_days(span, zone):
        at = date.fromisoformat(d)
        rows.append(f"('{d}', {midnight(at, zone)}, {midnight(at + timedelta(days=1), zone)})")
    return f"days(day, a, b) AS (VALUES {', '.join(rows)})"


COUNTS = "CAST(count(*) AS BIGINT) AS events, CAST(count(DISTINCT NULLIF(visitor, '')) AS BIGINT) AS visitors"
VISITS = "CAST(count(DISTINCT NULLIF(session, '')) AS BIGINT)"


def _over_time_sql(r: Request) -> str:
    counts = f"CAST(count(event_id) AS BIGINT) AS events, CAST(count(DISTINCT NULLIF(visitor, '')) AS BIGINT) AS visitors, {VISITS} AS visits"
    return f"{EV}, {_days_sql(r.span, r.timezone)} SELECT day AS label, {counts} FROM days LEFT JOIN ev ON ts_ms >= a AND ts_ms < b AND {_in(r, r.event)} GROUP BY day"


def _breakdown_sql(r: Request, dim: str) -> str:
    return f"{EV} SELECT {dim} AS label, {COUNTS} FROM ev WHERE {_in(r, r.event)} AND {dim} <> '' GROUP BY {dim} ORDER BY events DESC, label LIMIT {r.limit}"


def _funnel_sql(r: Request) -> str:
    out = [f"s0 AS (SELECT visitor, min(ts_ms) AS t0, min(ts_ms) AS t FROM ev WHERE {_in(r, r.steps[0])} AND visitor <> '' GROUP BY visitor)"]
    for i, step in enumerate(r.steps[1:], 1):
        out.append(f"s{i} AS (SELECT s.visitor, s.t0, min(e.ts_ms) AS t FROM s{i - 1} s JOIN ev e ON e.visitor = s.visitor AND e.event = '{step}' AND e.ts_ms > s.t AND e.ts_ms <= s.t0 + {r.window_hours * HOUR_MS} AND e.ts_ms < {r.end} GROUP BY s.visitor, s.t0)")
    counts = ", ".join(f"(SELECT CAST(count(*) AS BIGINT) FROM s{i}) AS n{i}" for i in range(len(r.steps)))
    rows = " UNION ALL ".join(f"SELECT {i + 1} AS step, '{s}' AS event, n{i} AS visitors, " + ("CAST(1 AS DOUBLE)" if not i else f"CASE WHEN n{i - 1} > 0 THEN n{i} / n{i - 1} ELSE CAST(0 AS DOUBLE) END") + f" AS from_previous, CASE WHEN n0 > 0 THEN n{i} / n0 ELSE CAST(0 AS DOUBLE) END AS from_first FROM n" for i, s in enumerate(r.steps))
    return f"{EV}, {', '.join(out)}, n AS (SELECT {counts}) {rows}"


def _periods_sql(r: Request) -> str:
    """(visitor, i) of active periods, and the periods (period, i)."""
    names = list(dict.fromkeys(period_key(d, r.period) for d in local_days(r.span, r.timezone)))
    at = ", ".join(f"('{d}', '{period_key(d, r.period)}', {names.index(period_key(d, r.period))})" for d in local_days(r.span, r.timezone))
    return f"{EV}, {_days_sql(r.span, r.timezone)}, pd(day, period, i) AS (VALUES {at}), active AS (SELECT DISTINCT visitor, i FROM ev JOIN days ON ts_ms >= a AND ts_ms < b JOIN pd USING (day) WHERE {_in(r, r.event)} AND visitor <> ''), periods AS (SELECT DISTINCT period, i FROM pd)"


def _retention_sql(r: Request) -> str:
    return f"{_periods_sql(r)}, f AS (SELECT visitor, min(i) AS first FROM active GROUP BY visitor), c AS (SELECT first, i - first AS o, count(*) AS n FROM active JOIN f USING (visitor) GROUP BY ALL) SELECT p.period AS cohort, q.i - p.i AS \"offset\", CAST(coalesce(n, 0) AS BIGINT) AS visitors FROM periods p JOIN periods q ON q.i >= p.i LEFT JOIN c ON c.first = p.i AND c.o = q.i - p.i"


def _stickiness_sql(r: Request) -> str:
    return f"{_periods_sql(r)} SELECT CAST(n AS BIGINT) AS periods, CAST(count(*) AS BIGINT) AS visitors FROM (SELECT visitor, count(*) AS n FROM active GROUP BY visitor) GROUP BY n"


def _lifecycle_sql(r: Request) -> str:
    # The dense form: every visitor in every period since the first.
    return f"""{_periods_sql(r)}, f AS (SELECT visitor, min(i) AS first FROM active GROUP BY visitor),
        g AS (SELECT f.visitor, p.i, p.i = f.first AS is_first, a.i IS NOT NULL AS now, b.i IS NOT NULL AS before FROM f JOIN periods p ON p.i >= f.first LEFT JOIN active a ON a.visitor = f.visitor AND a.i = p.i LEFT JOIN active b ON b.visitor = f.visitor AND b.i = p.i - 1),
        c AS (SELECT i, sum(CASE WHEN is_first THEN 1 ELSE 0 END) AS n, sum(CASE WHEN NOT is_first AND now AND before THEN 1 ELSE 0 END) AS r, sum(CASE WHEN NOT is_first AND now AND NOT before THEN 1 ELSE 0 END) AS u, sum(CASE WHEN NOT now AND before THEN 1 ELSE 0 END) AS d FROM g GROUP BY i)
        SELECT period, CAST(coalesce(n, 0) AS BIGINT) AS new, CAST(coalesce(r, 0) AS BIGINT) AS returning, CAST(coalesce(u, 0) AS BIGINT) AS resurrecting, CAST(coalesce(d, 0) AS BIGINT) AS dormant FROM periods LEFT JOIN c USING (i)"""


def _visits_sql(r: Request) -> str:
    half = visits.IDLE_MS
    return f"""{EV}, w AS (SELECT *, CASE WHEN page <> '' THEN page ELSE path END AS pg, min(ts_ms) OVER (PARTITION BY session) AS first, max(ts_ms) OVER (PARTITION BY session) AS last FROM ev WHERE ts_ms >= {r.start - half} AND ts_ms < {r.end + half} AND session <> ''),
        i AS (SELECT * FROM w WHERE {_in(r, None)}),
        v AS (SELECT session, min(first) >= {r.start} AS starts, max(last) < {r.end} AS complete, count(*) AS n, max(ts_ms) - min(ts_ms) AS ms FROM i GROUP BY session),
        pv AS (SELECT session, pg, row_number() OVER (PARTITION BY session ORDER BY ts_ms, event_id) AS up, row_number() OVER (PARTITION BY session ORDER BY ts_ms DESC, event_id DESC) AS down, count(*) OVER (PARTITION BY session) AS views FROM i WHERE event = '$pageview')"""


def _clicks_sql(r: Request, table: str = "ev") -> str:
    page = f"page = '{r.page}'" if r.page else f"path = '{r.path}'"
    return f"cl AS (SELECT *, click_x // 100 * 100 AS x, click_y // 20 * 20 AS y FROM {table} WHERE {_in(r, '$click')} AND viewport > 0 AND {page}" + (f" AND variant = '{r.variant}'" if r.variant else "") + _band_sql(r) + ")"


def _band_sql(r: Request) -> str:
    if r.viewport <= 0:
        return ""
    return " AND " + ("viewport > 0 AND viewport < 600" if r.viewport < 600 else "viewport >= 600 AND viewport < 1024" if r.viewport < 1024 else "viewport >= 1024")


def _scroll_sql(r: Request) -> str:
    return f"{EV}, sc AS (SELECT * FROM ev WHERE {_in(r, '$scroll')} AND doc_h > 0 AND path = '{r.path}'{_band_sql(r)})"


def _pages_sql(r: Request, event: str, extra: str) -> str:
    return f"{EV} SELECT CASE WHEN page <> '' THEN page ELSE p END AS label, page, coalesce(min(NULLIF(path, '')), '') AS path, CAST(count(*) AS BIGINT) AS events FROM (SELECT page, path, CASE WHEN page = '' THEN path ELSE '' END AS p FROM ev WHERE {_in(r, event)} AND {extra}) GROUP BY page, p ORDER BY events DESC, label LIMIT {r.limit}"


def _rage_sql(r: Request) -> str:
    return f"""WITH RECURSIVE {adapter.events_sql()}, {adapter.bursts_sql()}, {_clicks_sql(r, "bu")},
        c AS (SELECT session, ts_ms, click_x, click_y, row_number() OVER (PARTITION BY session ORDER BY ts_ms, event_id) AS i FROM cl),
        run AS (SELECT session, i, i AS head, ts_ms AS t, click_x AS ax, click_y AS ay FROM c WHERE i = 1
            UNION ALL SELECT c.session, c.i, CASE WHEN c.ts_ms - t <= 1000 AND abs(c.click_x - ax) <= 300 AND abs(c.click_y - ay) <= 40 THEN head ELSE c.i END, CASE WHEN c.ts_ms - t <= 1000 AND abs(c.click_x - ax) <= 300 AND abs(c.click_y - ay) <= 40 THEN t ELSE c.ts_ms END, CASE WHEN c.ts_ms - t <= 1000 AND abs(c.click_x - ax) <= 300 AND abs(c.click_y - ay) <= 40 THEN ax ELSE c.click_x END, CASE WHEN c.ts_ms - t <= 1000 AND abs(c.click_x - ax) <= 300 AND abs(c.click_y - ay) <= 40 THEN ay ELSE c.click_y END FROM run JOIN c ON c.session = run.session AND c.i = run.i + 1),
        runs AS (SELECT session, head, any_value(ax) AS ax, any_value(ay) AS ay, count(*) AS n FROM run GROUP BY session, head HAVING count(*) >= 3),
        cells AS (SELECT CAST(ax // 100 * 100 AS INT) AS x, CAST(ay // 20 * 20 AS INT) AS y, CAST(sum(n) AS BIGINT) AS clicks, CAST(count(DISTINCT session) AS BIGINT) AS sessions FROM runs GROUP BY 1, 2)"""


def _spots_sql(cells: str) -> str:
    """Closure over cells that touch; position of the cell of most clicks, then least (y, x)."""
    return f"""{cells}, reach AS (SELECT x, y, x AS ox, y AS oy FROM cells UNION SELECT reach.x, reach.y, c.x, c.y FROM reach JOIN cells c ON abs(c.x - reach.ox) <= 100 AND abs(c.y - reach.oy) <= 20),
        part AS (SELECT x, y, min(oy * 1000000 + ox) AS id FROM reach GROUP BY x, y),
        full_ AS (SELECT cells.*, id, row_number() OVER (PARTITION BY id ORDER BY clicks DESC, y, x) AS k FROM cells JOIN part USING (x, y))
        SELECT CAST(max(CASE WHEN k = 1 THEN x END) AS INT) AS x, CAST(max(CASE WHEN k = 1 THEN y END) AS INT) AS y, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(sessions) AS BIGINT) AS sessions FROM full_ GROUP BY id"""


def _source_sql() -> str:
    host = " ".join(f"WHEN regexp_replace(lower(referrer_host), '^www\\.', '') IN ({', '.join(repr(h) for h in hosts)}) OR " + " OR ".join(f"suffix(lower(referrer_host), '.{h}')" for h in hosts) + f" THEN '{name}'" for name, (hosts, _) in enrich.ASSISTANTS.items())
    link = " ".join(f"WHEN regexp_replace(lower(trim(utm_source)), '^www\\.', '') IN ({', '.join(repr(v) for v in links)}) THEN '{name}'" for name, (_, links) in enrich.ASSISTANTS.items())
    return f"CASE {host} {link} ELSE '' END"


def _ai_sql(r: Request) -> str:
    return f"{EV}, ai AS (SELECT *, {_source_sql()} AS source FROM ev WHERE {_in(r)} AND channel NOT IN ('paid', 'internal')), s AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts_ms, event_id) AS nth FROM ai WHERE source <> '')"


def _crawl_sql(r: Request) -> str:
    return f"WITH {adapter.crawl_sql()}, h AS (SELECT *, CAST(json_extract_string(props, '$.status') AS INT) AS status FROM cr WHERE {_in(r, '$crawl')})"


def _dated_sql(ms: str = "ts_ms") -> str:
    return f"strftime(make_timestamp({ms} * 1000), '%Y-%m-%d')"


# --- scalar functions -----------------------------------------------------------------------------------------------

_UAS = ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0 Safari/537.36 Edg/120.0", "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Mobile/15E148", "Mozilla/5.0 (Linux; Android 13; Pixel 7; wv) AppleWebKit/537.36 Chrome/119.0 Mobile Safari/537.36", "Mozilla/5.0 (X11; CrOS x86_64 14541.0.0) AppleWebKit/537.36 Chrome/120.0 Safari/537.36", "Mozilla/5.0 (compatible; Googlebot/2.1)", "", "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15) Gecko/20100101 Firefox/121.0", "Mozilla/5.0 (iPad; CPU OS 16_0 like Mac OS X) AppleWebKit/605.1.15 Version/16.0 Mobile/15E148 Safari/604.1", "Mozilla/5.0 (Linux; Android 12; SM-T870) AppleWebKit/537.36 SamsungBrowser/20.0 Chrome/106.0 Safari/537.36", "Mozilla/4.0 (MSIE 7.0; Windows NT 6.1; Trident/7.0)")
_HOSTS = ("", "www.google.co.uk", "s.example", "chat.openai.com", "www.perplexity.ai", "m.facebook.com", "x.com", "t.company", "news.google.com", "duckduckgo.com", "example.org", "bing.com", "yahoo.co.jp", "old.reddit.com")
_MEDIA = ("", "CPC", "email", "paid-social", "organic", "affiliate", "referral", "Display", "unknown")
_SOURCES = ("", "chatgpt.com", "newsletter", "www.Perplexity", "gemini")


def _case(by: str, values: tuple[str, ...]) -> str:
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _fn_channel(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", *(F.expr(_case(by, v)).alias(n) for n, by, v in (("host", "event_id", _HOSTS), ("medium", "event_id", _MEDIA), ("source", "event_id", _SOURCES))), (F.col("event_id") % 11 == 0).alias("click"))
    return rows.select("event_id", enrich.channel(F.col("host"), F.lit("www.s.example"), F.col("source"), F.col("medium"), F.col("click")).alias("channel"))


def _fn_channel_sql() -> str:
    any_prefix = lambda values: " OR ".join(f"prefix(h, '{v}')" for v in values)
    media = " ".join(f"WHEN m IN ({', '.join(repr(v) for v in values)}) THEN '{name}'" for name, values in enrich.MEDIA.items())
    paid = ", ".join(repr(v) for v in enrich.MEDIA["paid"])
    return f"""WITH a AS (SELECT event_id, {_case("event_id", _HOSTS)} AS referrer_host, lower({_case("event_id", _MEDIA)}) AS m, {_case("event_id", _SOURCES)} AS utm_source, event_id % 11 = 0 AS click FROM events),
        b AS (SELECT *, regexp_replace(referrer_host, '^www\\.', '') AS h, {_source_sql()} AS ai FROM a)
        SELECT event_id, CASE WHEN referrer_host <> '' AND h = 's.example' THEN 'internal' WHEN m NOT IN ({paid}) AND NOT click AND ai <> '' THEN 'ai' {media} WHEN click THEN 'paid' WHEN referrer_host = '' THEN 'direct'
        WHEN {any_prefix(enrich.SEARCH_HOSTS)} THEN 'organic' WHEN {any_prefix(enrich.SOCIAL_HOSTS)} THEN 'social' ELSE 'referral' END AS channel FROM b"""


def _fn_user_agent(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", enrich.user_agent(F.expr(_case("event_id", _UAS))).alias("a")).select("event_id", "a.*")


def _fn_user_agent_sql() -> str:
    has = lambda tokens: "(" + " OR ".join(f"contains(l, '{t}')" for t in tokens) + ")"
    first = lambda rules: "CASE WHEN l = '' THEN '' " + " ".join(f"WHEN {has(t)} THEN '{n}'" for n, t in rules) + " ELSE '' END"
    return f"""WITH a AS (SELECT event_id, lower({_case("event_id", _UAS)}) AS l FROM events) SELECT event_id, {first(enrich.BROWSERS)} AS browser, {first(enrich.SYSTEMS)} AS os,
        CASE WHEN l = '' THEN '' WHEN contains(l, 'ipad') OR contains(l, 'tablet') OR (contains(l, 'android') AND NOT contains(l, 'mobile')) THEN 'tablet' WHEN contains(l, 'mobile') OR contains(l, 'iphone') OR contains(l, 'ipod') THEN 'mobile' ELSE 'desktop' END AS device,
        CASE WHEN l = '' THEN '' WHEN contains(l, '; wv)') OR contains(l, ' wv ') OR ((contains(l, 'iphone') OR contains(l, 'ipad')) AND contains(l, 'applewebkit') AND NOT contains(l, 'safari/')) THEN 'mobile_app' ELSE 'web' END AS platform,
        {has(enrich.BOTS)} AS bot FROM a"""


def _fn_page_url(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", enrich.url_host(u).alias("host"), enrich.url_path(u).alias("path"), enrich.url_parameter(u, "utm_source").alias("utm_source"), enrich.has_click_id(u).alias("click_id"))


_FN_PAGE_URL_SQL = "WITH a AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS p FROM pages) SELECT page_id, host, CASE WHEN p = '' THEN '/' ELSE p END AS path, regexp_extract(url, '[?&]utm_source=([^&#]*)', 1) AS utm_source, regexp_matches(url, '[?&](gclid|gbraid|wbraid|fbclid|msclkid|ttclid|li_fat_id)=[^&#]') AS click_id FROM a"


# URLs that are odd, with their host and path.
_URL_EDGES = [
    ("http://h/a b", "h", "/a%20b"), ("https://User@Host:8080//x//?q", "host", "//x"), ("https://h", "h", "/"), ("nothing", "", ""), ("", "", ""), ("https://h/é/", "h", "/%C3%A9"), ("https://h/<a>", "h", "/%3Ca%3E"),
    ("https://h/a%2Fb", "h", "/a%2Fb"), ("https://h/{x}+%41", "h", "/%7Bx%7D+A"), ("http://[::1]:80/x", "::1", "/x"), ("//h/p", "h", "/p"), ("http://h:abc/", "", ""), ("http://h/%zz", "", ""), ("http://a b/", "", ""), ("http://h/(a)*", "h", "/(a)*"),
]
_CRAWL_BODY = '{"b": [{"s": "bad site", "u": "/a", "bot": "B"}, {"s": "shop.example", "u": "/a/?x", "bot": " GPTBot", "ai": true, "st": 200, "g": "%s"}, {"s": "x.crawl", "u": "/a", "bot": "B"}, {"s": "x", "u": "/b", "bot": "B", "st": 9, "g": "p"}]}' % ("g" * 200)
_CRAWL_ROWS = [(1000, 1000, "shop.example.crawl", "/a", "g" * 128, "GPTBot", "ai", "web", '{"status":200}'), (1001, 1001, "x.crawl", "/b", "p", "B", "crawler", "web", '{"status":0}')]


def _values(columns: str, rows: list[tuple]) -> str:
    cell = lambda v: f"CAST({v} AS BIGINT)" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({columns})"


def _fn_url_edges(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return spark.createDataFrame([(r[0],) for r in _URL_EDGES], "url string").select("url", enrich.url_host(u).alias("host"), enrich.url_path(u).alias("path"))


def _fn_crawl_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.crawl_events(spark.createDataFrame([(_CRAWL_BODY,)], "body string"), F.lit(1000).cast("long"))
    return rows.select("ts_ms", "ts_client_ms", "site", "path", "page", "label", "channel", "platform", "props")


def _fn_visitor_id(spark: SparkSession, d: str) -> DataFrame:
    salt = F.lit(enrich.daily_salt(b"secret", "2024-01-10"))
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", enrich.visitor_id(F.concat(F.lit("10.0.0."), (F.col("user_id") % 255).cast("string")), F.expr(_case("user_id", _UAS)), F.lit(adapter.SITE), salt).alias("visitor_id"))


def _fn_tenant(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/pages.parquet")
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://apps.example.com/Shop/acme/page/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    ua = F.when(F.col("page_id") % 5 == 0, "Mozilla/5.0 Wrapper/1.2 ACME/Shop").otherwise("Mozilla/5.0")
    return p.select("page_id", enrich.tenant_site(ua, url, url, enrich.site_of(url, F.lit(""), F.lit("")), "Wrapper/", ("apps.example.com",)).alias("site"))


def _fn_crawl_clean(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/"), F.split_part("url", F.lit("/"), F.lit(4)), F.lit("//?q#f"))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", enrich.crawl_path(path).alias("path"), enrich.crawl_valid(F.lit("s.example"), F.when(F.col("page_id") % 4 == 0, "").otherwise("GPTBot"), path).alias("valid"))


def _flat(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- rollups --------------------------------------------------------------------------------------------------------


def _build_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = rollup.build(adapter.events(spark, d))
    return rows.groupBy("dim", "key", "event").agg(F.sum("events").alias("events"), F.count(F.lit(1)).alias("hours"))


def _build_counts_sql() -> str:
    dims = " UNION ALL ".join(f"SELECT '{x}' AS dim, {x} AS key, event, ts_ms FROM ev WHERE {x} <> ''" for x in DIMENSIONS)
    return f"{EV}, a AS (SELECT '' AS dim, '' AS key, event, ts_ms FROM ev UNION ALL {dims}) SELECT dim, key, event, CAST(count(*) AS BIGINT) AS events, CAST(count(DISTINCT ts_ms // {HOUR_MS}) AS BIGINT) AS hours FROM a GROUP BY ALL"


def _two_tier(spark: SparkSession, d: str, zone_shift: int) -> DataFrame:
    e = adapter.events(spark, d)
    out = rollup.breakdown(e, rollup.build(e), adapter.SITE, Span(START - zone_shift, END - zone_shift), "$pageview", "path", 10)
    return out.select("label", "events")


def _two_tier_sql(shift: int) -> str:
    return f"{EV} SELECT path AS label, CAST(count(*) AS BIGINT) AS events FROM ev WHERE ts_ms >= {START - shift} AND ts_ms < {END - shift} AND event = '$pageview' GROUP BY path ORDER BY events DESC, label LIMIT 10"


def _uniques_bound(spark: SparkSession, d: str) -> DataFrame:
    """Whether a sketch's estimate is within three standard errors of the exact count, and at least within 2."""
    e = adapter.events(spark, d)
    near = rollup.merge(rollup.build(e).where("dim = 'path'"), "key")
    exact = e.where("path <> ''").groupBy(F.col("path").alias("key")).agg(uniques("visitor").alias("exact"))
    return near.join(exact, "key").select("key", "events", "exact", (F.abs(F.col("visitors") - F.col("exact")) <= F.greatest(F.col("exact") * 0.07, F.lit(2))).alias("within_bound"))


def _audience_rolled(spark: SparkSession, d: str) -> DataFrame:
    e = adapter.events(spark, d)
    r = _ask("topPages")
    near = rollup.audience(e, rollup.build(e), r.site, r.span, "$pageview").withColumn("j", F.lit(1))
    exact = traffic.audience(e, r).select("views", F.col("visitors").alias("v"), F.col("visits").alias("s"), F.lit(1).alias("j"))
    off = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(F.col(b) * 0.025, F.lit(2))
    return near.drop("views").join(exact, "j").select("views", (off("visitors", "v") & off("visits", "s")).alias("within_bound"))


def _rolled_over_time(spark: SparkSession, d: str, r: Request) -> DataFrame:
    e = adapter.events(spark, d)
    near = rollup.over_time(e, rollup.build(e), r.site, r.span, r.timezone, r.event).withColumnsRenamed({"visitors": "v", "visits": "s"})
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(F.col(b) * 0.025, F.lit(2))
    return near.join(traffic.over_time(e, r).drop("events"), "label").select("label", "events", (close("v", "visitors") & close("s", "visits")).alias("within_bound"))


def _spans_table(spark: SparkSession, _: str) -> DataFrame:
    """The planner's golden cases: hour plans and previous spans of a few ranges and zones."""
    cases = [("ist_day", IST_START, IST_START + 86_400_000, IST), ("short", START + 60_000, START + 1_260_000, "UTC"), ("dst", midnight(local(1_709_960_400_000, NEW_YORK).date(), NEW_YORK), 1_710_216_000_000, NEW_YORK)]
    rows = []
    for name, a, b, zone in cases:
        plan, before = plan_hours(Span(a, b)), previous(Span(a, b), zone)
        rows.append((name, (plan.full.end - plan.full.start) // HOUR_MS if plan.full else 0, len(plan.partial), before.start, len(local_days(Span(a, b), zone))))
    return spark.createDataFrame(rows, "name string, full_hours long, partials int, previous_start long, days int")


# --- registry -------------------------------------------------------------------------------------------------------


def _table() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {}
    time = {
        "pageviews_over_time": _ask("pageviewsOverTime"),
        "pageviews_over_time_ist": _ask("pageviewsOverTime", IST_START, IST_END, timezone=IST),
        "pageviews_over_time_new_york": _ask("pageviewsOverTime", timezone=NEW_YORK),
        "event_timeline": _ask("eventTimeline", event="$click"),
    }
    for name, r in time.items():
        out[name] = _on(traffic.over_time, r), _over_time_sql(r)
    named = {"top_pages": "topPages", "top_referrers": "topReferrers", "channel_breakdown": "channelBreakdown", "device_breakdown": "deviceBreakdown", "browser_breakdown": "browserBreakdown", "os_breakdown": "osBreakdown", "geo_breakdown": "geoBreakdown", "platform_breakdown": "platformBreakdown", "app_version_breakdown": "appVersionBreakdown"}
    from tidewatch.plans.request import BREAKDOWNS

    for name, widget in named.items():
        r = _ask(widget)
        out[name] = _on(traffic.breakdown, r), _breakdown_sql(r, BREAKDOWNS[widget])
    for dim in DIMENSIONS:
        r = _ask("breakdownByProperty", dimension=dim)
        out[f"breakdown_{dim}"] = _on(traffic.breakdown, r), _breakdown_sql(r, dim)
    r = _ask("topEvents")
    out["top_events"] = _on(traffic.top_events, r), f"{EV} SELECT event AS label, {COUNTS}, {VISITS} AS visits FROM ev WHERE {_in(r, None)} GROUP BY event ORDER BY events DESC, label LIMIT 10"
    r = _ask("topPages", limit=3)
    out["total_beyond_limit"] = _on(traffic.total, r), f"{EV} SELECT CAST(count(*) AS BIGINT) AS total FROM ev WHERE {_in(r)} AND path <> ''"
    out["audience"] = _on(traffic.audience, r), f"{EV} SELECT CAST(count(*) AS BIGINT) AS views, CAST(count(DISTINCT NULLIF(visitor, '')) AS BIGINT) AS visitors, {VISITS} AS visits FROM ev WHERE {_in(r)}"
    r = _ask("topPages", START + 7 * 86_400_000, END, compare="previous")
    before = previous(r.span, r.timezone)
    out["compare_breakdown"] = _on(traffic.compare_breakdown, r), f"{EV}, p AS (SELECT path AS label, count(*) AS n FROM ev WHERE ts_ms >= {before.start} AND ts_ms < {before.end} AND event = '$pageview' AND path <> '' GROUP BY path) SELECT path AS label, {COUNTS}, CAST(coalesce(any_value(n), 0) AS BIGINT) AS previous FROM ev LEFT JOIN p ON p.label = path WHERE {_in(r)} AND path <> '' GROUP BY path ORDER BY events DESC, path LIMIT 10"
    out["compare_top_events"] = _on(traffic.compare_top_events, _ask("topEvents", r.start, r.end, compare="previous")), f"{EV}, p AS (SELECT event AS label, count(*) AS n FROM ev WHERE ts_ms >= {before.start} AND ts_ms < {before.end} GROUP BY event) SELECT event AS label, {COUNTS}, {VISITS} AS visits, CAST(coalesce(any_value(n), 0) AS BIGINT) AS previous FROM ev LEFT JOIN p ON p.label = event WHERE {_in(r, None)} GROUP BY event ORDER BY events DESC, label LIMIT 10"
    out["total_over_time"] = _on(traffic.period_total, _ask("pageviewsOverTime", r.start, r.end, compare="previous")), f"{EV} SELECT CAST(count(*) FILTER (WHERE {_in(r)}) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE ts_ms >= {before.start} AND ts_ms < {before.end} AND event = '$pageview') AS BIGINT) AS previous_total FROM ev"
    out["compare_total"] = _on(traffic.compare_total, r), f"{EV} SELECT CAST(count(*) AS BIGINT) AS previous_total FROM ev WHERE ts_ms >= {before.start} AND ts_ms < {before.end} AND event = '$pageview' AND path <> ''"
    r = _ask("pageviewsOverTime", START + 7 * 86_400_000, END, compare="previous")
    days = r.end - r.start
    out["compare_timeline"] = _on(traffic.compare_timeline, r), f"{EV}, {_days_sql(r.span, 'UTC')} SELECT day AS label, (SELECT CAST(count(*) AS BIGINT) FROM ev WHERE event = '$pageview' AND ts_ms >= a AND ts_ms < b) AS events, (SELECT CAST(count(*) AS BIGINT) FROM ev WHERE event = '$pageview' AND ts_ms >= a - {days} AND ts_ms < b - {days}) AS previous FROM days"

    for name, r in {"funnel_2": _ask("funnel", steps=STEPS[:2]), "funnel_3": _ask("funnel", steps=STEPS), "funnel_window": _ask("funnel", steps=STEPS, window_hours=2), "funnel_repeat": _ask("funnel", steps=("$click", "$click", "form_submit"))}.items():
        out[name] = _on(sequence.funnel, r), _funnel_sql(r)
    for suffix, more in {"day": {}, "week": {"period": "week"}, "event": {"event": "purchase"}, "ist": {"timezone": IST}}.items():
        r = _ask("retention", **more)
        out[f"retention_{suffix}"] = _on(sequence.retention, r), _retention_sql(r)
    for suffix, more in {"day": {}, "week": {"period": "week"}}.items():
        r = _ask("stickiness", event="$click", **more)
        out[f"stickiness_{suffix}"] = _on(sequence.stickiness, r), _stickiness_sql(r)
        r = _ask("lifecycle", event="$click", **more)
        out[f"lifecycle_{suffix}"] = _on(sequence.lifecycle, r), _lifecycle_sql(r)
    r = _ask("retention")
    out["iso_week"] = lambda s, d, r=r: adapter.events(s, d).select(local_day("UTC").alias("day")).distinct().select("day", period_of(F.col("day"), "week").alias("week")), f"{EV} SELECT DISTINCT {_dated_sql()} AS day, strftime(make_timestamp(ts_ms * 1000), '%G-W%V') AS week FROM ev"
    out["order_retention"] = _order_retention, "WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS v, date_diff('month', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS m FROM orders), a AS (SELECT DISTINCT v, m FROM o), f AS (SELECT v, min(m) AS first FROM a GROUP BY v) SELECT CAST(first AS BIGINT) AS cohort, CAST(m - first AS BIGINT) AS \"offset\", CAST(count(*) AS BIGINT) AS visitors FROM a JOIN f USING (v) GROUP BY ALL"

    r = _ask("entryPages")
    v = _visits_sql(r)
    out["entry_pages"] = _on(visits.entry_pages, r), f"{v} SELECT pg AS label, CAST(count(*) AS BIGINT) AS visits FROM v JOIN pv USING (session) WHERE starts AND up = 1 GROUP BY pg ORDER BY visits DESC, label LIMIT 10"
    out["entry_total"] = _on(visits.entry_total, r), f"{v} SELECT CAST(count(*) AS BIGINT) AS total FROM v JOIN pv USING (session) WHERE starts AND up = 1"
    out["exit_pages"] = _on(visits.exit_pages, r), f"{v} SELECT pg AS label, CAST(count(*) AS BIGINT) AS visits FROM v JOIN pv USING (session) WHERE starts AND complete AND down = 1 GROUP BY pg ORDER BY visits DESC, label LIMIT 10"
    out["pages_per_visit"] = _on(visits.pages_per_visit, r), f"{v} SELECT CASE WHEN least(views, 10) = 10 THEN '10+' ELSE CAST(views AS VARCHAR) END AS label, CAST(count(*) AS BIGINT) AS visits, CAST(least(views, 10) AS BIGINT) AS pages FROM v JOIN pv USING (session) WHERE starts AND complete AND up = 1 GROUP BY 1, 3"
    bounds = " ".join(f"WHEN ms < {b * 1000} THEN '{n}'" for b, n in visits.LENGTHS[:-1])
    out["visit_length"] = _on(visits.visit_length, r), f"{v} SELECT CASE {bounds} ELSE '{visits.LENGTHS[-1][1]}' END AS label, CAST(count(*) AS BIGINT) AS visits FROM v WHERE starts AND complete AND n >= 2 GROUP BY 1"
    mid = _ask("entryPages", START + 43_200_000, END - 43_200_000)
    out["exit_pages_edges"] = _on(visits.exit_pages, mid), f"{_visits_sql(mid)} SELECT pg AS label, CAST(count(*) AS BIGINT) AS visits FROM v JOIN pv USING (session) WHERE starts AND complete AND down = 1 GROUP BY pg ORDER BY visits DESC, label LIMIT 10"

    r = _ask("scrollDepth", path="/p/3")
    depths = " UNION ALL ".join(f"SELECT '{x}%' AS label, CAST(count(*) FILTER (WHERE scroll_pct >= {x}) AS BIGINT) AS events FROM sc" for x in engagement.DEPTHS)
    out["scroll_depth"] = _on(engagement.scroll_depth, r), f"{_scroll_sql(r)} {depths}"
    out["scroll_summary"] = _on(engagement.scroll_summary, r), f"{_scroll_sql(r)} SELECT CAST(count(*) AS BIGINT) AS views, CAST(avg(scroll_pct) AS DOUBLE) AS average_pct, CAST(quantile_disc(scroll_pct, 0.5) AS INT) AS median_pct, CAST(quantile_disc(viewport_h * 100 // doc_h, 0.5) AS INT) AS fold_pct FROM sc"
    wide = _ask("scrollDepth", path="/p/4", viewport=1440)
    out["scroll_depth_band"] = _on(engagement.scroll_depth, wide), f"{_scroll_sql(wide)} {depths}"
    out["scroll_pages"] = _on(engagement.scroll_pages, _ask("scrollPages")), _pages_sql(_ask("scrollPages"), "$scroll", "doc_h > 0")
    out["heatmap_pages"] = _on(engagement.heatmap_pages, _ask("heatmapPages")), _pages_sql(_ask("heatmapPages"), "$click", "viewport > 0")
    for name, r in {"heatmap_cells": _ask("heatmap", path="/p/3"), "heatmap_cells_variant": _ask("heatmap", page="page3", variant="a", viewport=500)}.items():
        out[name] = _on(engagement.heatmap_cells, r), f"{EV}, {_clicks_sql(r)} SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(count(*) AS BIGINT) AS clicks FROM cl GROUP BY x, y"
    r = _ask("heatmap", path="/p/3")
    out["heatmap_summary"] = _on(engagement.heatmap_summary, r), f"{EV}, {_clicks_sql(r)}, c AS (SELECT count(*) AS n FROM cl GROUP BY x, y) SELECT CAST(sum(n) AS BIGINT) AS clicks, CAST(max(n) AS BIGINT) AS max, (SELECT string_agg(DISTINCT variant, ',' ORDER BY variant) FROM cl WHERE variant <> '') AS variants, (SELECT array_to_string(list_sort(list(DISTINCT CASE WHEN viewport < 600 THEN 600 WHEN viewport < 1024 THEN 1024 ELSE 9999 END)), ',') FROM cl) AS viewports FROM c"
    r = _ask("clickFriction", path="/p/3")
    out["friction_summary"] = _on(engagement.friction_summary, r), f"{EV}, {_clicks_sql(r)} SELECT CAST(count(*) AS BIGINT) AS clicks, max(interactive) = 1 AS measured FROM cl"
    dead = f"WITH RECURSIVE {adapter.events_sql()}, {_clicks_sql(r)}, cells AS (SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(count(*) AS BIGINT) AS clicks, CAST(count(DISTINCT session) AS BIGINT) AS sessions FROM cl WHERE interactive = 0 GROUP BY x, y)"
    out["friction_dead_cells"] = _on(engagement.dead_cells, r), f"{dead} SELECT * FROM cells"
    out["friction_dead_spots"] = _on(engagement.dead_spots, r), _spots_sql(dead)
    on_bursts = lambda fn: lambda s, d, r=r: fn(adapter.bursts(s, d), r)
    out["friction_rage_cells"] = on_bursts(engagement.rage_cells), f"{_rage_sql(r)} SELECT * FROM cells"
    out["friction_spots"] = on_bursts(engagement.rage_spots), _spots_sql(_rage_sql(r))

    r = _ask("crawlerVisits")
    crawl = lambda fn, r=r: lambda s, d: fn(adapter.crawls(s, d), r)
    h = _crawl_sql(r)
    out["crawl_pages"] = crawl(assistants.crawl_pages), f"{h} SELECT label AS bot, bool_or(channel = 'ai') AS ai, path, CAST(count(*) AS BIGINT) AS hits, CAST(count(*) FILTER (WHERE status >= 400) AS BIGINT) AS errors, arg_max(status, (ts_ms - 1700000000000) * 100000 + event_id) AS status, max(ts_ms) AS last_ms FROM h GROUP BY label, path ORDER BY hits DESC, bot, path LIMIT 10"
    out["crawl_bots"] = crawl(assistants.crawl_bots), f"{h} SELECT label AS bot, bool_or(channel = 'ai') AS ai, CAST(count(*) AS BIGINT) AS hits, CAST(count(DISTINCT path) AS BIGINT) AS pages, max(ts_ms) AS last_ms FROM h GROUP BY label"
    out["crawl_days"] = crawl(assistants.crawl_days), f"{h} SELECT {_dated_sql()} AS day, CAST(count(*) AS BIGINT) AS hits, CAST(count(*) FILTER (WHERE channel = 'ai') AS BIGINT) AS ai_hits FROM h GROUP BY 1"
    r = _ask("aiReferrals")
    a = _ai_sql(r)
    out["ai_referrals_sources"] = _on(assistants.ai_sources, r), f"{a} SELECT source AS label, {COUNTS}, CAST(count(DISTINCT session) AS BIGINT) AS visits FROM s GROUP BY source"
    out["ai_referrals_landing"] = _on(assistants.ai_landing, r), f"{a} SELECT source, path, CAST(count(*) AS BIGINT) AS visits FROM s WHERE nth = 1 GROUP BY source, path ORDER BY visits DESC, source, path LIMIT 10"
    out["ai_referrals_days"] = _on(assistants.ai_days, r), f"{a} SELECT {_dated_sql()} AS day, CAST(count(*) AS BIGINT) AS visits FROM s WHERE nth = 1 GROUP BY 1"
    out["ai_referrals_totals"] = _on(assistants.ai_totals, r), f"{a} SELECT CAST(count(*) AS BIGINT) AS pageviews, CAST(count(DISTINCT visitor) AS BIGINT) AS visitors, CAST(count(DISTINCT session) AS BIGINT) AS visits FROM s"

    out["rollup_build_counts"] = _build_counts, _build_counts_sql()
    out["rollup_merge"] = partial(_two_tier, zone_shift=0), _two_tier_sql(0)
    out["two_tier_ist"] = partial(_two_tier, zone_shift=19_800_000), _two_tier_sql(19_800_000)
    out["two_tier_kathmandu"] = partial(_two_tier, zone_shift=20_700_000), _two_tier_sql(20_700_000)
    out["rollup_uniques_bound"] = _uniques_bound, f"{EV} SELECT path AS key, CAST(count(*) AS BIGINT) AS events, CAST(count(DISTINCT visitor) AS BIGINT) AS exact, true AS within_bound FROM ev GROUP BY path"
    out["rollup_audience_bound"] = _audience_rolled, f"{EV} SELECT CAST(count(*) AS BIGINT) AS views, true AS within_bound FROM ev WHERE ts_ms >= {START} AND ts_ms < {END} AND event = '$pageview'"
    for name, zone, shift in (("rollup_over_time", "UTC", 0), ("rollup_over_time_ist", IST, 19_800_000)):
        r = _ask("pageviewsOverTime", START - shift, END - shift, timezone=zone)
        out[name] = partial(_rolled_over_time, r=r), f"{EV}, {_days_sql(r.span, zone)} SELECT day AS label, CAST(count(event_id) AS BIGINT) AS events, true AS within_bound FROM days LEFT JOIN ev ON ts_ms >= a AND ts_ms < b AND {_in(r)} GROUP BY day"
    r = _ask("topEvents")
    out["rollup_top_events"] = lambda s, d, r=r: rollup.top_events(adapter.events(s, d), rollup.build(adapter.events(s, d)), r.site, r.span, 10).select("label", "events"), f"{EV} SELECT event AS label, CAST(count(*) AS BIGINT) AS events FROM ev WHERE {_in(r, None)} GROUP BY event"
    out["planner_golden"] = _spans_table, f"SELECT * FROM (VALUES ('ist_day', CAST(23 AS BIGINT), 2, CAST({IST_START - 86_400_000} AS BIGINT), 1), ('short', CAST(0 AS BIGINT), 1, CAST({START - 1_140_000} AS BIGINT), 1), ('dst', CAST(71 AS BIGINT), 0, CAST(1709701200000 AS BIGINT), 3)) t(name, full_hours, partials, previous_start, days)"

    out["fn_event_name"] = lambda s, d: _flat(s, d, "events").select("event_id", enrich.canonical_event(F.expr(_case("event_id", ("page_view", "pageView", "view", "click", "PageView")))).alias("event")), f"SELECT event_id, CASE WHEN x IN ('page_view', 'pageView', 'PageView') THEN '$pageview' ELSE x END AS event FROM (SELECT event_id, {_case('event_id', ('page_view', 'pageView', 'view', 'click', 'PageView'))} AS x FROM events)"
    out["fn_page_url"] = _fn_page_url, _FN_PAGE_URL_SQL
    out["fn_url_edges"] = _fn_url_edges, _values("url, host, path", _URL_EDGES)
    out["fn_crawl_rows"] = _fn_crawl_rows, _values("ts_ms, ts_client_ms, site, path, page, label, channel, platform, props", _CRAWL_ROWS)
    out["fn_click_id"] = lambda s, d: _flat(s, d, "pages").select("page_id", enrich.has_click_id(F.concat("url", F.when(F.col("page_id") % 2 == 0, "?gclid=1&x=2").otherwise("?gclid=&fbclidx=3"))).alias("click")), "SELECT page_id, page_id % 2 = 0 AND NOT contains(url, '#') AS click FROM pages"
    out["fn_referrer_host"] = lambda s, d: _flat(s, d, "pages").select("page_id", enrich.referrer_host(F.upper("url")).alias("host")), "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages"
    out["fn_channel"] = _fn_channel, _fn_channel_sql()
    out["fn_ai_source"] = lambda s, d: _flat(s, d, "events").select("event_id", enrich.assistant(F.expr(_case("event_id", _HOSTS)), F.expr(_case("event_id", _SOURCES))).alias("source")), f"SELECT event_id, {_source_sql()} AS source FROM (SELECT event_id, {_case('event_id', _HOSTS)} AS referrer_host, {_case('event_id', _SOURCES)} AS utm_source FROM events)"
    out["fn_user_agent"] = _fn_user_agent, _fn_user_agent_sql()
    out["fn_clamp"] = lambda s, d: _flat(s, d, "events").select("event_id", enrich.clamp(F.col("event_id") * 37 - 5000, "click_x").alias("x"), enrich.clamp(F.col("user_id") - 50, "scroll_pct").alias("pct")), "SELECT event_id, CAST(greatest(0, least(event_id * 37 - 5000, 10000)) AS INT) AS x, CAST(greatest(0, least(user_id - 50, 100)) AS INT) AS pct FROM events"
    out["fn_country"] = lambda s, d: _flat(s, d, "events").select("event_id", enrich.country(F.expr(_case("event_id", ("IN", "XX", "T1", "DE")))).alias("country")), f"SELECT event_id, CASE WHEN x IN ('XX', 'T1') THEN '' ELSE x END AS country FROM (SELECT event_id, {_case('event_id', ('IN', 'XX', 'T1', 'DE'))} AS x FROM events)"
    out["fn_site"] = lambda s, d: _flat(s, d, "pages").select("page_id", enrich.site_of(F.when(F.col("page_id") % 2 == 0, F.col("url")), F.lit("https://www.Origin.example:8080"), F.lit("")).alias("site")), "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', '') ELSE 'origin.example' END AS site FROM pages"
    out["fn_client_ip"] = lambda s, d: _flat(s, d, "events").select("event_id", enrich.client_ip(F.when(F.col("event_id") % 3 == 0, "1.2.3.4"), F.when(F.col("event_id") % 3 == 1, " 5.6.7.8 , 9.9.9.9"), F.lit("10.0.0.1:443")).alias("ip")), "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '1.2.3.4' WHEN 1 THEN '5.6.7.8' ELSE '10.0.0.1' END AS ip FROM events"
    out["fn_event_path"] = lambda s, d: _flat(s, d, "pages").select("page_id", enrich.event_path(F.expr(_case("page_id", ("", "/rel/?q=1", "https://o.example/abs/"))), F.col("url")).alias("path")), "WITH a AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS p FROM pages) SELECT page_id, CASE page_id % 3 WHEN 1 THEN '/rel/?q=1' WHEN 2 THEN '/abs' ELSE CASE WHEN p = '' THEN '/' ELSE p END END AS path FROM a"
    out["fn_crawl_clean"] = _fn_crawl_clean, "SELECT page_id, '/' || split_part(url, '/', 4) AS path, page_id % 4 <> 0 AS valid FROM pages"
    out["fn_tenant_site"] = _fn_tenant, "SELECT page_id, CASE WHEN page_id % 5 = 0 OR page_id % 3 = 0 THEN 'shop_ACME' ELSE regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', '') END AS site FROM pages"
    out["fn_visitor_id"] = _fn_visitor_id, None
    return out


def _order_retention(spark: SparkSession, d: str) -> DataFrame:
    """Months after a customer's first order in which there was another."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("v"), ((F.year("o_orderdate") - 1970) * 12 + F.month("o_orderdate") - 1).cast("long").alias("m")).distinct()
    first = o.groupBy("v").agg(F.min("m").alias("cohort"))
    return o.join(first, "v").groupBy("cohort", (F.col("m") - F.col("cohort")).alias("offset")).agg(F.count(F.lit(1)).alias("visitors"))


def queries() -> dict[str, Query]:
    return {n: q for n, (q, _) in _table().items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _table().items() if s}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ask("topPages")
    return traffic.breakdown(of_site(adapter.events(spark, sf_dir), r.site), r)
