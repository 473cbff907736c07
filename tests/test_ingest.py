"""Wire batches to both tiers: parsing, outcomes, replays, restarts, retention."""

import json

from pyspark.sql import functions as F

from tidewatch.functions import enrich
from tidewatch.sources import store
from tidewatch.streaming import ingest

NOW = 1_788_220_800_000
SETTINGS = ingest.Settings(b"secret")
BATCH = {"u": "https://www.Shop.example/pricing/?utm_source=chatgpt.com#x", "r": "", "s": "s1", "b": [{"e": "page_view"}, {"e": ""}, {"e": "click", "l": "buy", "x": 20000, "y": -4, "w": 1440, "i": 7, "p": '{"a":1}'}, {"e": "pageview", "u": "/rel/?q=1"}]}


def requests(spark, *bodies, ua="Mozilla/5.0 Chrome/120 Safari/537"):
    rows = [(b if isinstance(b, str) else json.dumps(b), ua, "", "", "", "1.2.3.4, 5.6.7.8", "", "XX", str(NOW)) for b in bodies]
    return spark.createDataFrame(rows, ingest.REQUEST)


def test_events_of_a_batch(spark):
    e = ingest.to_events(requests(spark, BATCH), SETTINGS, F.lit(NOW), F.lit(b"salt")).orderBy("ts_ms").collect()
    assert [(r.event, r.ts_ms - NOW, r.path) for r in e] == [("$pageview", 0, "/pricing"), ("click", 1, "/pricing"), ("$pageview", 2, "/rel/?q=1")]
    assert {r.channel for r in e} == {"ai"} and {r.site for r in e} == {"shop.example"} and {r.country for r in e} == {""}
    assert (e[1].click_x, e[1].click_y, e[1].interactive, e[1].props) == (10000, 0, 1, '{"a":1}')
    assert len({r.visitor for r in e}) == 1 and len(e[0].visitor) == 22


def test_outcomes(spark):
    many = {"u": "https://a.example/", "b": [{"e": "x"}] * 501}
    got = [r.outcome for r in ingest.outcomes(requests(spark, BATCH, "not json", many, {"u": "nowhere", "b": [{"e": "x"}]}), SETTINGS).select("outcome").collect()]
    assert got == ["accepted", "dropped_invalid", "dropped_invalid", "dropped_unresolved"]
    assert ingest.outcomes(requests(spark, BATCH, ua="Googlebot"), SETTINGS).first().outcome == "dropped_bot"
    assert ingest.outcomes(requests(spark, BATCH), ingest.Settings(b"s", sites=("other.example",))).first().outcome == "dropped_unresolved"


def test_crawl_batches(spark):
    body = {"b": [{"s": "shop.example", "u": "/a/?x", "bot": "GPTBot", "ai": True, "st": 200}, {"s": "bad site", "u": "/a", "bot": "B"}, {"s": "x.crawl", "u": "/a", "bot": "B"}, {"s": "x", "u": "a", "bot": "B"}, {"s": "x", "u": "/b", "bot": "B", "st": 9}]}
    rows = ingest.crawl_events(requests(spark, body), F.lit(NOW)).orderBy("ts_ms").collect()
    got = [(r.site, r.path, r.label, r.channel, r.props) for r in rows]
    assert [(r.ts_ms, r.ts_client_ms, r.platform) for r in rows] == [(NOW, NOW, "web"), (NOW + 1, NOW + 1, "web")]
    assert got == [("shop.example.crawl", "/a", "GPTBot", "ai", '{"status":200}'), ("x.crawl", "/b", "B", "crawler", '{"status":0}')]


def test_stream_writes_both_tiers_once(spark, tmp_path):
    src, root, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    src.mkdir()
    line = lambda b: json.dumps({"body": json.dumps(b), "ua": "Chrome/1", "socket": "1.1.1.1:5", "received": str(NOW)})
    (src / "a.json").write_text(line(BATCH) + "\n" + line(BATCH) + "\n")

    def run():
        q = ingest.start(ingest.read_requests(spark, str(src)), root, ckpt, SETTINGS, lambda: NOW, {"availableNow": True})
        q.awaitTermination(120)
        return store.raw(spark, root, "shop.example").count(), store.rollups(spark, root, "shop.example").where("dim = ''").agg(F.sum("events")).first()[0]

    assert run() == (6, 6)
    assert run() == (6, 6)  # a restart adds nothing
    (src / "b.json").write_text(line(BATCH) + "\n")
    assert run() == (9, 9)
    # Writing a batch again replaces it.
    store.write_batch(ingest.to_events(requests(spark, BATCH), SETTINGS, F.lit(NOW), F.lit(b"x")), root, 1)
    assert store.raw(spark, root).count() == 9
    assert store.prune(spark, root, "2026-09-01") == []
    assert len(store.prune(spark, root, "2026-09-02")) == 4
    assert store.raw(spark, root).count() == 0


def test_segments(spark):
    names = spark.createDataFrame([("Foo X",), ("",), ("..",), ("a/b",)], "n string")
    assert [r[0] for r in names.select(store.segment(F.col("n"))).collect()] == ["foo_x", "_", "_", "a_b"]


def test_streaming_shapes(spark, sf):
    from tidewatch.sources import adapter

    e = adapter.events(spark, sf)
    assert ingest.hourly(e).agg(F.sum("events")).first()[0] == e.count()
    assert ingest.sessions(e).agg(F.sum("events")).first()[0] == e.count()
    assert ingest.deduplicated(e.union(e)).count() == e.count()
    assert ingest.ingest_order(e).where("place = 1").count() == e.select("session").distinct().count()


def test_url_edge_cases(spark):
    urls = [("http://h/a b", "h", "/a%20b"), ("https://User@Host:8080//x//?q", "host", "//x"), ("https://h", "h", "/"), ("https://h/", "h", "/"), ("nothing", "", ""), (None, "", ""), ("https://h/é/", "h", "/%C3%A9"), ("https://h/<a>", "h", "/%3Ca%3E"), ("https://h/a%2Fb", "h", "/a%2Fb"), ("https://h/{x}+%41", "h", "/%7Bx%7D+A"), ("http://[::1]:80/x", "::1", "/x"), ("//h/p", "h", "/p"), ("http://h:abc/", "", ""), ("http://h/%zz", "", ""), ("http://a b/", "", ""), ("http://h/\n", "", ""), ("http://h/(a)*", "h", "/(a)*")]
    df = spark.createDataFrame(urls, "u string, host string, path string")
    for r in df.select("host", "path", enrich.url_host(F.col("u")).alias("h"), enrich.url_path(F.col("u")).alias("p")).collect():
        assert (r.h, r.p) == (r.host, r.path)


def test_counters_and_site_table(spark):
    from pyspark.sql import Observation

    many = requests(spark, BATCH, "not json", BATCH)
    assert {r.outcome: (r.requests, r.events) for r in ingest.counted(many, SETTINGS).collect()} == {"accepted": (2, 8), "dropped_invalid": (1, 0)}
    seen = Observation("o")
    ingest.observed(many, SETTINGS, seen).count()
    assert seen.get["accepted"] == 2 and seen.get["dropped_invalid"] == 1
    sites = spark.createDataFrame([("www.shop.example", "shop_ACME")], "host string, site string")
    assert [r.host_site for r in ingest.with_sites(many, sites).orderBy("host_site").collect()] == ["", "shop_ACME", "shop_ACME"]


def test_config_refusals():
    import pytest

    from tidewatch.config import from_env

    good = {"TIDEWATCH_DATA": "/d", "TIDEWATCH_CHECKPOINT": "/c", "TIDEWATCH_SECRET": "x" * 16, "TIDEWATCH_SITES": "a, b"}
    assert from_env(good).sites == ("a", "b") and from_env(good).ingest.secret == b"x" * 16
    for bad in ({"TIDEWATCH_DATA": ""}, {"TIDEWATCH_CHECKPOINT": "/d/"}, {"TIDEWATCH_SECRET": "short"}, {"TIDEWATCH_QUERY_SECRET": "x" * 16}, {"TIDEWATCH_KEEP_DAYS": "-1"}, {"TIDEWATCH_KEEP_DAYS": "x"}):
        with pytest.raises(ValueError):
            from_env({**good, **bad})


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    import re

    from tidewatch.operators import traffic
    from tidewatch.plans.request import Request, checked
    from tidewatch.plans.timerange import DAY_MS, Span

    root = str(tmp_path)
    store.write_batch(ingest.to_events(requests(spark, BATCH), SETTINGS, F.lit(NOW), F.lit(b"x")), root, 0)
    r = checked(Request("topPages", "shop.example", NOW, NOW + DAY_MS))
    df = traffic.breakdown(store.raw(spark, root, r.site, Span(r.start, r.end)), r)
    assert [tuple(x) for x in df.collect()] == [("/pricing", 1, 1), ("/rel/?q=1", 1, 1)]
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = spark._jvm.PythonSQLUtils.explainString(traffic.breakdown(store.raw(spark, root, r.site, Span(r.start, r.end)), r)._jdf.queryExecution(), "formatted")
    pushed, columns = re.search(r"PushedFilters: \[(.*?)\]", plan)[1], re.search(r"ReadSchema: struct<(.*?)>", plan)[1]
    assert "GreaterThanOrEqual(ts_ms" in pushed and "EqualTo(site,shop.example)" in pushed and "EqualTo(event," in pushed
    assert sorted(c.split(":")[0] for c in columns.split(",")) == ["event", "path", "site", "ts_ms", "visitor"]
    assert "date" in re.search(r"PartitionFilters: \[(.*?)\]", plan)[1]


def test_a_column_that_old_files_lack(spark, tmp_path):
    from tidewatch.schema import complete

    old = complete(spark.createDataFrame([(1, NOW, "s", "$pageview", "/")], "event_id long, ts_ms long, site string, event string, path string")).drop("doc_h", "variant")
    old.withColumns({"site_dir": F.lit("s"), "date": F.lit("2026-09-01")}).write.partitionBy("site_dir", "date").parquet(f"{tmp_path}/raw/batch=0")
    row = store.raw(spark, str(tmp_path), "s").first()
    assert (row.doc_h, row.variant, row.path) == (0, "", "/")


def test_streams_agree_with_tables(spark, sf, tmp_path):
    from tidewatch.schema import EVENT
    from tidewatch.sources import adapter

    e = adapter.events(spark, sf)
    e.repartition(3).write.parquet(str(tmp_path / "e"))

    def run(fn, mode, name):
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
        q = fn(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(180) and q.exception() is None
        return spark.table(name)

    got = run(ingest.hourly, "complete", "hours")
    assert sorted(map(tuple, got.select("hour", "site", "event", "events").collect())) == sorted(map(tuple, ingest.hourly(e).select("hour", "site", "event", "events").collect()))
    assert run(ingest.deduplicated, "append", "once").count() <= e.count()
