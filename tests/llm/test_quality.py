import collections
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import cases
from tidewatch.llm import gbdt, quality


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    lines, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\t#é日\x85\xa0\r"), max_size=60))
def test_counts(text):
    assert quality.statistics(text.encode())[0] == plain(text)


def test_query(spark, tmp_path):
    cases.save(cases.odd(spark), tmp_path)
    cases.save(spark.createDataFrame([(7, 1, 0), (7, 1, 1), (5, 0, 0), (None, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    got = quality.op5_quality(spark, str(tmp_path)).collect()
    want = sorted(((i, *plain(t or "")) for i, t in cases.ODD), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=repr) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    trees = quality.train(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.judge(docs, trees).join(labels.where("doc_id % 2 = 1"), "doc_id").select("kept", "base_failed", "quality").collect()
    judged = [r for r in rows if not r.base_failed]
    assert len(judged) > 100
    assert np.mean([r.kept == (r.quality == 1) for r in judged]) > 0.97


def test_scores_never_rise_with_symbols():
    r = np.random.default_rng(1)
    x = r.random((800, 3))
    y = (x[:, 0] + 0.3 * r.random(800) < 0.6).astype(float)
    trees = gbdt.fit(x, y, monotone={0: -1})
    for _ in range(20):
        row = np.tile(r.random(3), (50, 1))
        row[:, 0] = np.linspace(0, 1, 50)
        assert (np.diff(trees.score(row)) <= 1e-12).all()


def test_without_labels_and_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.filter_documents(cases.empty(spark), labels).count() == 0
    kept = quality.filter_documents(cases.odd(spark).withColumnRenamed("lang", "score"), labels)
    assert kept.columns == ["doc_id", "text", "score", "source", "n_chars"]
    assert {r.doc_id for r in kept.collect()} <= {6, 7, 8, 12}


def test_train_is_bounded_and_deterministic(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    a, b = quality.train(docs, labels, 40), quality.train(docs.repartition(3), labels.repartition(2), 40)
    assert (a.value == b.value).all() and (a.feature == b.feature).all()
