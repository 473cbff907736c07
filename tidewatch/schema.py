"""The canonical event, the rollup row, and the names both tiers share."""

from __future__ import annotations

from pyspark.sql import types as T

PAGEVIEW, CLICK, SCROLL, CRAWL = "$pageview", "$click", "$scroll", "$crawl"
#: Added to a site's key for rows that crawlers made, which no traffic question may count.
CRAWL_SUFFIX = ".crawl"

STRINGS = ("site", "event", "path", "page", "label", "visitor", "session", "referrer_host", "referrer_url", "channel", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "device", "browser", "os", "platform", "app_version", "country", "experiment", "variant")
NUMBERS = ("click_x", "click_y", "viewport", "scroll_pct", "viewport_h", "doc_h", "interactive")

#: Raw tier. ``ts_ms`` is the receipt time in epoch milliseconds, by which everything is counted; ``event_id`` breaks its ties.
EVENT = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField("ts_ms", T.LongType()), T.StructField("ts_client_ms", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in STRINGS]
    + [T.StructField(n, T.IntegerType()) for n in NUMBERS]
    + [T.StructField("props", T.StringType())]
)

#: The dimensions that rollups carry and a breakdown may name.
DIMENSIONS = ("path", "page", "label", "referrer_host", "channel", "utm_source", "utm_medium", "utm_campaign", "device", "browser", "os", "platform", "app_version", "country", "experiment", "variant")

ROLLUP = T.StructType(
    [T.StructField("hour", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("site", "event", "dim", "key")]
    + [T.StructField("events", T.LongType()), T.StructField("visitors", T.BinaryType()), T.StructField("sessions", T.BinaryType())]
)


#: Columns that every row of the raw tier has, since its first version; reads leave them bare, so that filters on them reach the scan.
ALWAYS = ("event_id", "ts_ms", "site", "event")


def complete(df, bare: tuple[str, ...] = ()):
    """``df`` with every canonical column, missing ones and nulls as '' or 0; ``bare`` ones as they are."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    out = []
    for f in EVENT:
        if f.name in bare:
            out.append(F.col(f.name))
            continue
        empty = F.lit("" if isinstance(f.dataType, T.StringType) else 0).cast(f.dataType)
        out.append((F.coalesce(F.col(f.name).cast(f.dataType), empty) if f.name in have else empty).alias(f.name))
    return df.select(*out)
