"""The driver's ``events`` and ``pages`` tables in the canonical schema, by arithmetic that any SQL engine can repeat.

The expressions below are one text for Spark and DuckDB; only the three primitives at the top differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.schema import complete

SITE = "s.example"


def _pick(by: str, *values: str) -> str:
    return f"CASE ({by}) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


COLUMNS = {
    "site": f"'{SITE}'",
    "event": "CASE event_type WHEN 'view' THEN '$pageview' WHEN 'click' THEN '$click' WHEN 'error' THEN '$scroll' WHEN 'signup' THEN 'form_submit' ELSE event_type END",
    "path": "'/p/' || CAST(k % 10 AS VARCHAR(20))",
    "page": "CASE WHEN k % 3 = 0 THEN 'page' || CAST(k % 7 AS VARCHAR(20)) ELSE '' END",
    "label": _pick("event_id + k", "", "buy", "menu", "hero"),
    "visitor": "'v' || CAST(user_id AS VARCHAR(20))",
    "session": "'s' || CAST(user_id AS VARCHAR(20)) || '-' || CAST(FLOOR(ts_ms / 86400000) AS VARCHAR(20))",
    "referrer_host": _pick("event_id", "", "www.google.com", "chatgpt.com", "t.co", "news.example.org", "www.perplexity.ai", "bing.com"),
    "channel": _pick("event_id", "direct", "organic", "ai", "social", "referral", "paid", "email", "internal", ""),
    "utm_source": _pick("event_id + user_id", "", "newsletter", "chatgpt", "google", "gemini"),
    "utm_medium": _pick("event_id", "", "cpc", "email", "", "social"),
    "utm_campaign": _pick("user_id", "", "spring", "launch"),
    "device": _pick("user_id", "desktop", "mobile", "tablet"),
    "browser": _pick("user_id", "Chrome", "Safari", "Firefox", "Edge", ""),
    "os": _pick("user_id", "Windows", "macOS", "Android", "iOS", "Linux", "ChromeOS", ""),
    "platform": _pick("user_id", "web", "web", "web", "mobile_app"),
    "app_version": _pick("user_id", "", "", "1.0", "1.1", "2.0"),
    "country": _pick("user_id", "IN", "US", "DE", "FR", "BR", ""),
    "experiment": _pick("user_id", "", "checkout"),
    "variant": _pick("user_id", "", "a", "", "b"),
    "click_x": "CAST((event_id * 37 + k * 101) % 10001 AS INT)",
    "click_y": "CAST((event_id * 13) % 2000 AS INT)",
    "viewport": "CAST(CASE user_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 390 WHEN 2 THEN 800 ELSE 1440 END AS INT)",
    "scroll_pct": "CAST(k + 1 AS INT)",
    "viewport_h": "900",
    "doc_h": "CAST(CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1000 + (event_id % 50) * 100 END AS INT)",
    "interactive": "CAST(event_id % 2 AS INT)",
}
CRAWL_COLUMNS = {
    "event_id": "page_id",
    "ts_ms": "1704844800000 + (page_id * 7919 % 1209600) * 1000",
    "site": f"'{SITE}.crawl'",
    "event": "'$crawl'",
    "label": _pick("page_id", "GPTBot", "ClaudeBot", "Googlebot", "PerplexityBot", "bingbot"),
    "channel": _pick("page_id", "ai", "ai", "crawler", "ai", "crawler"),
    "path": "'/' || split_part(split_part(url, '/', 4), '?', 1)",
    "page": "''",
    "props": "'{\"status\":' || " + _pick("page_id", "200", "200", "404", "301", "500", "200", "200") + " || '}'",
}
SPARK_BASE = "SELECT event_id, unix_millis(CAST(ts AS TIMESTAMP)) AS ts_ms, user_id, event_type, CAST(get_json_object(props, '$.k') AS INT) AS k, props FROM {events}"
DUCK_BASE = "SELECT event_id, epoch_ms(ts) AS ts_ms, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, props FROM events"


def events_sql() -> str:
    """DuckDB's CTE of the same rows, named ``ev``."""
    return f"base AS ({DUCK_BASE}), ev AS (SELECT event_id, ts_ms, k, user_id, props, " + ", ".join(f"{e} AS {n}" for n, e in COLUMNS.items()) + " FROM base)"


def crawl_sql() -> str:
    return "cr AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in CRAWL_COLUMNS.items()) + " FROM pages)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    base = raw.selectExpr("event_id", "unix_millis(CAST(ts AS TIMESTAMP)) AS ts_ms", "user_id", "event_type", "CAST(get_json_object(props, '$.k') AS INT) AS k", "props")
    return complete(base.selectExpr("event_id", "ts_ms", "props", *(f"{e} AS {n}" for n, e in COLUMNS.items())))


def crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete(spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr(*(f"{e} AS {n}" for n, e in CRAWL_COLUMNS.items())))


def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks, each ``k % 8 + 1`` times, 200 ms and 150 units apart, for runs of them."""
    base = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'click'").selectExpr("event_id", "unix_millis(CAST(ts AS TIMESTAMP)) AS ts_ms", "user_id", "event_type", "CAST(get_json_object(props, '$.k') AS INT) AS k", "props")
    rows = base.selectExpr("event_id", "ts_ms", "k", *(f"{e} AS {n}" for n, e in COLUMNS.items())).selectExpr("*", "explode(sequence(0, k % 8)) AS i")
    return complete(rows.selectExpr("event_id * 10 + i AS event_id", "ts_ms + 200 * i AS ts_ms", "CAST(click_x + 150 * i AS INT) AS click_x", *(n for n in COLUMNS if n != "click_x")))


def bursts_sql() -> str:
    return "bu AS (SELECT event_id * 10 + i AS event_id, ts_ms + 200 * i AS ts_ms, click_x + 150 * i AS click_x, " + ", ".join(n for n in COLUMNS if n != "click_x") + " FROM ev, (SELECT unnest(range(8)) AS i) n WHERE event = '$click' AND i <= k % 8)"
