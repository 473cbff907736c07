"""Operator 10 (native): URL filter rules, then gradient-boosted trees on lexical features of the host and path.

Features are integer SQL expressions that read the same in Spark and DuckDB (all but one, on lists); the trees, fitted on the driver from a
bounded table of labelled URLs, become CASE expressions. Nothing but DataFrame operations runs on executors.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and gets the trees'
verdict on empty strings; repeated rows are judged each by itself; extra columns are not read; ties between rules
cannot occur, as the longest rule wins and two rules of one length that both fit are the same rule.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import gbdt
from tidewatch.llm.common import read_table

#: (verdict, host, path), fixed values of the contract.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789-."
MAX_LABELLED = 20_000


def split_sql(url: str = "url") -> tuple[str, str]:
    """SQL of host and path, the same text for both engines."""
    rest = f"CASE WHEN {url} IS NULL OR position('://' IN {url}) = 0 THEN '' ELSE substring({url}, position('://' IN {url}) + 3) END"
    first = lambda s, marks: f"split_part({s}, '{marks[0]}', 1)" if len(marks) == 1 else f"split_part({first(s, marks[1:])}, '{marks[0]}', 1)"
    host = first(f"({rest})", "/?#")
    path = first(f"substring(({rest}), length({host}) + 1)", "?#")
    return f"translate({host}, '{_UPPER}', '{_LOWER}')", path


def _without(s: str, letters: str) -> str:
    return f"(length({s}) - length(translate({s}, '{letters}', '')))"


def feature_sql(host: str = "host", path: str = "path", url: str = "url", duckdb: bool = False) -> dict[str, str]:
    """Integer features: rates in thousandths, entropy in thousandths of a nat."""
    size = f"greatest(length({host}), 1)"
    times = {c: f"(length({host}) - length(replace({host}, '{c}', '')))" for c in _LETTERS}
    entropy = " + ".join(f"CASE WHEN {t} > 0 THEN -1000 * ({t} * 1e0 / {size}) * ln({t} * 1e0 / {size}) ELSE 0e0 END" for t in times.values())
    suffix = f"split_part({host}, '.', -1)"
    return {
        "url_length": f"coalesce(length({url}), 0)",
        "host_length": f"length({host})",
        "host_depth": times["."],
        "path_depth": f"(length({path}) - length(replace({path}, '/', '')))",
        "path_length": f"length({path})",
        "digit_rate": f"CAST(floor(1000 * {_without(host + ' || ' + path, '0123456789')} / greatest(length({host} || {path}), 1)) AS BIGINT)",
        "host_digits": _without(host, "0123456789"),
        "hyphens": times["-"],
        "entropy": f"CAST(floor({entropy} + 1e-6) AS BIGINT)",
        "parameters": f"coalesce(length({url}) - length(translate({url}, '=', '')), 0)",
        "suffix_length": f"length({suffix})",
        "suffix_rare": f"CASE WHEN {suffix} IN ('com', 'org', 'net', 'edu', 'gov') THEN 0 ELSE 1 END",
        "longest_label": f"list_max([length(x) for x in string_split({host}, '.')])" if duckdb else f"array_max(transform(split({host}, '[.]'), x -> length(x)))",
    }


def labelled(n: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """(url, label): 1 for spam. Made from a rule over a few words; replace by own labels where there are any.

    Every sign is in both classes. Spam has at least three of hyphens, digits, a long random label, a rare suffix,
    deep hosts and many parameters; other URLs have one at most.
    """
    # Fixed words of the rule, in hosts of both classes.
    words = ["garden", "river", "cheap", "thing", "free", "weather", "notes", "museum", "track", "win", "station", "click", "deal", "kitchen"]
    r, out = random.Random(seed), []
    for _ in range(n):
        spam = r.random() < 0.33
        signs = set(r.sample(range(6), r.choice([3, 4]) if spam else r.choice([0, 0, 1])))
        name = ("-" if 0 in signs else "").join(r.sample(words, r.choice([2, 3]) if 0 in signs else r.choice([1, 2])))
        if 1 in signs:
            name += str(r.randrange(1000, 1_000_000))
        if 2 in signs:
            name += "".join(r.choice("bcdfghjklmnpqrstvwxyz") for _ in range(r.randint(14, 20)))
        suffix = r.choice([".info", ".click", ".top", ".xyz"] if 3 in signs else [".com", ".org", ".net"])
        deep = ".".join(r.sample(words, 3)) + "." if 4 in signs else r.choice(["", "", "www.", "blog.", "m."])
        query = "&".join(f"{k}={r.randrange(100)}" for k in r.sample(["id", "ref", "page", "src", "aff", "sub", "cid", "q"], r.randint(4, 6) if 5 in signs else r.choice([0, 0, 1])))
        tail = r.choice(["", "/", ".html"]) + (f"?{query}" if query else r.choice(["", "#top"]))
        out.append((f"{r.choice(['http', 'https'])}://{deep}{name}{suffix}/{r.choice(['en', 'de', 'fr', 'es'])}/{r.randrange(1000)}{tail}", int(spam)))
    return out


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled(), "url string, label int")


def with_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """``df`` with ``host`` and ``path`` of its url."""
    host, path = split_sql(f"`{url_col}`")
    return df.withColumns({"host": F.expr(host), "path": F.expr(path)})


def fit(rows: list[tuple[int, ...]]) -> gbdt.Trees:
    """Trees from rows of features and label; positive is spam. Hyphens and host digits only raise it."""
    names = list(feature_sql())
    x = np.array([r[:-1] for r in rows], float).reshape(-1, len(names))
    return gbdt.fit(x, np.array([r[-1] for r in rows], float), trees=20, monotone={names.index("hyphens"): 1, names.index("host_digits"): 1})


def train(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> gbdt.Trees:
    """Trees from at most ``max_labelled`` labelled URLs, those of least hash."""
    few = with_parts(labelled.where("label IS NOT NULL").select("url", "label")).distinct().orderBy(F.xxhash64("url"), "url", "label").limit(max_labelled)
    return fit(sorted(tuple(r) for r in few.select(*(F.expr(e).cast("long") for e in feature_sql().values()), "label").collect()))


def rule_sql(host: str = "host", path: str = "path") -> tuple[str, str]:
    """SQL of the longest fitting rule and of its verdict, null where none fits."""
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"({host} = '{h}' OR right({host}, {len(h) + 1}) = '.{h}') AND left({path}, {len(p)}) = '{p}'"
    chain = lambda pick: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{pick(v, h, p)}'" for v, h, p in ordered) + " END"
    return chain(lambda v, h, p: h + p), chain(lambda v, h, p: v)


def judge(df: DataFrame, trees: gbdt.Trees, url_col: str = "url") -> DataFrame:
    """Adds host, path, rule, score (log odds of spam) and verdict."""
    features = feature_sql(url=f"`{url_col}`")
    # Each feature is a column of its own, so that the many conditions of the trees read it and don't repeat it.
    out = with_parts(df, url_col).withColumns({f"_{n}": F.expr(e).cast("long") for n, e in features.items()})
    out = out.withColumn("score", F.expr(trees.sql([f"_{n}" for n in features])))
    rule, verdict = rule_sql()
    return out.withColumns({"rule": F.expr(rule), "verdict": F.coalesce(F.expr(verdict), F.when(F.col("score") > 0, "block").otherwise("allow"))}).drop(*(f"_{n}" for n in features))


def oracle_sql() -> str:
    """The query in DuckDB's SQL. The features are the same text; the trees are fitted on the same rows, counted there."""
    import duckdb

    host, path = split_sql()
    features = feature_sql(duckdb=True)
    columns = ", ".join(f"CAST({e} AS BIGINT) AS _{n}" for n, e in features.items())
    parts = lambda table: f"(SELECT *, {path} AS path FROM (SELECT *, {host} AS host FROM {table}))"
    con = duckdb.connect()
    con.execute("CREATE TABLE labelled (url VARCHAR, label INT)")
    con.executemany("INSERT INTO labelled VALUES (?, ?)", sorted(set(labelled())))
    trees = fit(sorted(con.execute(f"SELECT {columns}, label FROM {parts('labelled')}").fetchall()))
    rule, verdict = rule_sql()
    score = trees.sql([f"_{n}" for n in features])
    return f"WITH f AS (SELECT *, {columns} FROM {parts('pages')}) SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN {score} > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM f"


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, train(labelled_urls(spark))).select("page_id", "host", "path", "rule", "verdict")
