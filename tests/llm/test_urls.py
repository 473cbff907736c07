import re

import numpy as np

from tidewatch.llm import urls

CASES = ["https://WWW.Example.COM/en/7?x#y", "http://a.example.com/en/8", "https://example.net/de/8", "x.net/de/", "ftp://net/de/1", "http://netx/de/1", "http://a.org/es/", "http://a.org?/es/", "http://b.org#/es/", "://", "http://h://p/q", None, "", "HTTP://ÀB.com/en/1", "http://example.com", "http://example.com/en/", "a" * 5000 + "://" + "b" * 5000 + "/en/"]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def test_parts_rules_and_verdicts(spark):
    trees = urls.train(urls.labelled_urls(spark))
    df = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(CASES)], "page_id long, url string, host string, score double")
    for r in urls.judge(df.drop("host", "score"), trees).collect():
        assert (r.host, r.path) == plain(r.url)
        name, verdict = rule(r.host, r.path)
        assert r.rule == name and r.verdict in ("allow", "block")
        assert verdict is None or r.verdict == verdict


def test_sql_is_what_the_trees_say(spark):
    labelled = urls.labelled_urls(spark)
    trees = urls.train(labelled)
    features = urls.feature_sql()
    rows = urls.judge(labelled.limit(300), trees).selectExpr("score", *(f"CAST({e} AS BIGINT) AS f{i}" for i, e in enumerate(features.values()))).collect()
    x = np.array([r[1:] for r in rows], float)
    assert np.allclose(trees.score(x), [r[0] for r in rows])


def test_held_out_accuracy(spark):
    labelled = urls.labelled_urls(spark)
    odd = "abs(xxhash64(url)) % 2 = 1"
    trees = urls.train(labelled.where(f"NOT {odd}"))
    rows = urls.judge(labelled.where(odd), trees).select("label", "score").collect()
    assert np.mean([(r.score > 0) == (r.label == 1) for r in rows]) > 0.97


def test_the_longest_label_is_over_all(spark):
    import duckdb

    hosts = ["a.b.c.verylonglabel.com", "", "www.example.com", "..", "one"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert [r[0] for r in df.selectExpr(urls.feature_sql()["longest_label"]).collect()] == [13, 0, 7, 0, 3]
    con = duckdb.connect()
    assert [con.execute(f"SELECT {urls.feature_sql(duckdb=True)['longest_label']} FROM (SELECT ? AS host)", [h]).fetchone()[0] for h in hosts] == [13, 0, 7, 0, 3]


def test_no_single_sign_decides(spark):
    labelled = urls.labelled()
    hyphen = {spam: np.mean(["-" in u.split("/")[2] for u, y in labelled if y == spam]) for spam in (0, 1)}
    assert 0 < hyphen[0] < 1 and 0 < hyphen[1] < 1
    trees = urls.train(urls.labelled_urls(spark))
    assert len({int(f) for f in trees.feature if f >= 0}) >= 6
    names = ["http://my-garden.example.com/en/7", "http://garden7731qxzvbnmkjhgfdsw.river.notes.museum.xyz/en/7?id=1&ref=2&page=3&src=4&q=5"]
    df = spark.createDataFrame([(u,) for u in names], "url string")
    assert {r.url: r.verdict for r in urls.judge(df, trees).collect()} == dict(zip(names, ["allow", "block"]))


def test_sql_oracle(spark):
    from tests import oracle
    from tidewatch.llm import entry

    sf = "/root/testdata/sf0.01"
    assert oracle.differences(urls.op10_urls(spark, sf), oracle.connect(sf), entry.oracle_sql()["op10_urls"]) == ""


def test_plan_has_no_python(spark):
    df = urls.op10_urls(spark, "/root/testdata/sf0.001")
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), urls.train(urls.labelled_urls(spark))).count() == 0
