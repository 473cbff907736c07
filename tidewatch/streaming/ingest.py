"""Wire batches to both tiers by Structured Streaming.

The checkpoint's offsets are the log; a micro-batch is stamped with its receipt time and written under its id, so that
a restart repeats or completes a batch but never adds to one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions import enrich
from tidewatch.schema import CRAWL, CRAWL_SUFFIX, complete
from tidewatch.sources.store import write_batch

MAX_EVENTS, MAX_BYTES = 500, 1 << 20
BATCH_SCHEMA = "u string, r string, v string, s string, x string, n string, b array<struct<e: string, t: bigint, l: string, g: string, u: string, p: string, x: int, y: int, w: int, d: int, h: int, dh: int, i: int>>"
CRAWL_SCHEMA = "b array<struct<s: string, u: string, g: string, bot: string, ai: boolean, st: int>>"
#: What a request carries beside its body.
REQUEST = T.StructType([T.StructField(n, T.StringType()) for n in ("body", "ua", "origin", "referer", "edge_ip", "forwarded", "socket", "country", "received")])


@dataclass(frozen=True)
class Settings:
    """``secret`` salts visitor ids by day; ``sites`` is an allow-list, empty for any."""

    secret: bytes
    sites: tuple[str, ...] = ()
    app_tag: str = ""
    path_hosts: tuple[str, ...] = ()
    extra: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if not self.secret:
            raise ValueError("a secret is required: without it visitor ids change with every process")


def outcomes(requests: DataFrame, s: Settings) -> DataFrame:
    """Requests with their parsed body and their outcome: accepted, or why all of a batch is dropped."""
    parsed = requests.withColumns({"j": F.from_json("body", BATCH_SCHEMA), "agent": enrich.user_agent(F.col("ua"))})
    host_site = enrich.site_of(F.col("j.u"), F.col("origin"), F.col("referer"))
    site = enrich.tenant_site(F.col("ua"), F.col("j.u"), F.col("origin"), host_site, s.app_tag, s.path_hosts) if s.app_tag else host_site
    parsed = parsed.withColumn("site", site)
    unknown = F.col("site") == ""
    if s.sites:
        unknown = unknown | ~F.col("site").isin(*s.sites)
    bad = F.col("j.b").isNull() | (F.octet_length("body") > MAX_BYTES) | (F.size("j.b") > MAX_EVENTS)
    return parsed.withColumn("outcome", F.when(bad, "dropped_invalid").when(F.col("agent.bot"), "dropped_bot").when(unknown | (enrich.url_host(F.col("j.u")) == ""), "dropped_unresolved").otherwise("accepted"))


def counted(requests: DataFrame, s: Settings) -> DataFrame:
    """Requests by outcome; in a stream, :meth:`DataFrame.observe` of the same flags reaches a query's progress."""
    return outcomes(requests, s).groupBy("outcome").agg(F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum(F.size("j.b")), F.lit(0)).alias("events"))


def observed(requests: DataFrame, s: Settings, name: str = "ingest") -> DataFrame:
    """Requests with their outcome, whose counts are metrics of the query that reads them."""
    kinds = ("accepted", "dropped_bot", "dropped_unresolved", "dropped_invalid")
    return outcomes(requests, s).observe(name, *(F.count_if(F.col("outcome") == k).alias(k) for k in kinds))


def with_sites(requests: DataFrame, dimension: DataFrame) -> DataFrame:
    """Requests with ``host_site``, looked up by host in a (host, site) table that Spark broadcasts where it is small; '' where unknown. A streaming batch reads the table anew."""
    host = enrich.request_host(F.get_json_object("body", "$.u"), F.col("origin"), F.col("referer"))
    return requests.withColumn("host", host).join(dimension.select("host", F.col("site").alias("host_site")), "host", "left").na.fill("", ["host_site"])


def to_events(requests: DataFrame, s: Settings, received_ms: Column, salt: Column) -> DataFrame:
    """Canonical events of accepted requests. The i-th named event of a request is stamped i ms after it."""
    ok = outcomes(requests, s).where("outcome = 'accepted'")
    named = F.filter("j.b", lambda e: F.coalesce(e["e"], F.lit("")) != "")
    rows = ok.select("j.*", "agent", "site", "ua", "edge_ip", "forwarded", "socket", "country", received_ms.alias("at"), salt.alias("salt"), F.posexplode(named).alias("i", "e"))
    url, host = F.col("u"), enrich.url_host(F.col("u"))
    source, medium = enrich.url_parameter(url, "utm_source"), enrich.url_parameter(url, "utm_medium")
    referrer = enrich.referrer_host(F.col("r"))
    ip = enrich.client_ip(F.col("edge_ip"), F.col("forwarded"), F.col("socket"))
    given = F.coalesce(F.col("v"), F.lit(""))
    columns = {
        "event_id": F.xxhash64("at", "i", "s", "v", enrich.visitor_id(ip, F.col("ua"), F.col("site"), F.col("salt")), "u", "e"), "ts_ms": F.col("at") + F.col("i"), "ts_client_ms": F.col("e.t"), "site": F.col("site"),
        "event": enrich.canonical_event(F.col("e.e")), "path": enrich.event_path(F.col("e.u"), url), "page": F.col("e.g"), "label": F.col("e.l"),
        "visitor": F.when(given != "", given).otherwise(enrich.visitor_id(ip, F.col("ua"), F.col("site"), F.col("salt"))), "session": F.col("s"),
        "referrer_host": referrer, "channel": enrich.channel(referrer, host, source, medium, enrich.has_click_id(url)),
        "utm_source": source, "utm_medium": medium, **{f"utm_{k}": enrich.url_parameter(url, f"utm_{k}") for k in ("campaign", "term", "content")},
        "device": F.col("agent.device"), "browser": F.col("agent.browser"), "os": F.col("agent.os"), "platform": F.col("agent.platform"),
        "country": enrich.country(F.col("country")), "experiment": F.col("x"), "variant": F.col("n"),
        "click_x": enrich.clamp(F.col("e.x"), "click_x"), "click_y": enrich.clamp(F.col("e.y"), "click_y"), "viewport": enrich.clamp(F.col("e.w"), "viewport"),
        "scroll_pct": enrich.clamp(F.col("e.d"), "scroll_pct"), "viewport_h": enrich.clamp(F.col("e.h"), "viewport_h"), "doc_h": enrich.clamp(F.col("e.dh"), "doc_h"), "interactive": enrich.clamp(F.col("e.i"), "interactive"),
        "props": F.col("e.p"),
    }
    return complete(rows.select(*(c.alias(n) for n, c in columns.items())))


def crawl_events(requests: DataFrame, received_ms: Column) -> DataFrame:
    """Canonical events of crawl batches, filed under the site's crawl key. The i-th valid hit of a batch is stamped i ms after it."""
    valid = F.filter(F.from_json("body", CRAWL_SCHEMA)["b"], lambda h: enrich.crawl_valid(h["s"], h["bot"], h["u"]))
    rows = requests.select(received_ms.alias("at"), F.posexplode(valid).alias("i", "h")).withColumn("ts", F.col("at") + F.col("i"))
    columns = {
        "event_id": F.xxhash64("at", "i", "h"), "ts_ms": F.col("ts"), "ts_client_ms": F.col("ts"), "site": F.concat(F.trim("h.s"), F.lit(CRAWL_SUFFIX)), "event": F.lit(CRAWL),
        "path": enrich.crawl_path(F.col("h.u")), "page": F.left(F.col("h.g"), F.lit(128)), "label": F.trim("h.bot"), "channel": F.when(F.col("h.ai"), "ai").otherwise("crawler"), "platform": F.lit("web"), "props": enrich.crawl_props(F.col("h.st")),
    }
    return complete(rows.select(*(c.alias(n) for n, c in columns.items())))


def start(requests: DataFrame, root: str, checkpoint: str, s: Settings, now_ms: Callable[[], int], trigger: dict | None = None) -> StreamingQuery:
    """Writes a stream of requests to both tiers. A request without ``received`` (ms) is stamped when its batch is read."""

    def write(batch: DataFrame, batch_id: int) -> None:
        from datetime import UTC, datetime

        now = now_ms()
        stamp = F.coalesce(F.col("received").try_cast("long"), F.lit(now))
        # Ids rotate by the UTC day of receipt: one salt for each day that the batch has, a handful.
        days = [r[0] for r in batch.select(F.date_format(F.timestamp_millis(stamp), "yyyy-MM-dd")).distinct().collect()] or [datetime.fromtimestamp(now / 1000, UTC).date().isoformat()]
        salts = F.create_map(*(F.lit(x) for d in days for x in (d, enrich.daily_salt(s.secret, d))))
        salt = F.element_at(salts, F.date_format(F.timestamp_millis(stamp), "yyyy-MM-dd"))
        write_batch(to_events(batch, s, stamp, salt), root, batch_id)

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 minutes"})).start()


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """A stream of requests as JSON lines in a folder."""
    return spark.readStream.schema(REQUEST).json(path)


def sessions(events: DataFrame, idle: str = "30 minutes") -> DataFrame:
    """Events without session ids as visits of a visitor: visitor, start, end, events."""
    at = events.withColumn("at", F.timestamp_millis(F.col("ts_ms")))
    if events.isStreaming:
        at = at.withWatermark("at", idle)
    return at.groupBy(F.session_window("at", idle).alias("w"), "visitor").agg(F.count(F.lit(1)).alias("events")).select("visitor", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def deduplicated(events: DataFrame, within: str = "1 hour") -> DataFrame:
    """Drops events that a client sent again within a time; stream or table."""
    if not events.isStreaming:
        return events.dropDuplicates(["event_id"])
    return events.withColumn("at", F.timestamp_millis(F.col("ts_ms"))).withWatermark("at", within).dropDuplicatesWithinWatermark(["event_id"]).drop("at")


def hourly(events: DataFrame) -> DataFrame:
    """Running counts and sketches by tumbling hour, for an update-mode stream."""
    at = events.withColumn("at", F.timestamp_millis(F.col("ts_ms")))
    if events.isStreaming:
        at = at.withWatermark("at", "1 hour")
    return at.groupBy(F.window("at", "1 hour").alias("w"), "site", "event").agg(F.count(F.lit(1)).alias("events"), F.hll_sketch_estimate(F.hll_sketch_agg("visitor", 14)).alias("visitors")).select(F.col("w.start").alias("hour"), "site", "event", "events", "visitors")


def ingest_order(events: DataFrame) -> DataFrame:
    """Place of each event in its session by receipt."""
    return events.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy("ts_ms", "event_id")))
