import collections

import corpus_pipeline
from tests.llm import cases, test_neardup, test_packing, test_spans
from tidewatch.llm import neardup, quality


def test_stages_against_plain_ones(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    one = corpus_pipeline.quality_rules(spark, docs, sf)
    assert one.columns == docs.columns
    kept = {r.doc_id for r in one.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for i, text in before.items():
        (n, _, _, _, repeated), _ = quality.statistics(text.encode())
        if quality.base_failed(n, repeated):
            assert i not in kept
        elif i in labels:
            assert (i in kept) == (labels[i] == 1)

    one = spark.createDataFrame(one.collect(), docs.schema)
    two = corpus_pipeline.near_dedup(spark, one, sf)
    words = {i: neardup.word_hashes(before[i].encode()) for i in kept}
    left = sorted(r.doc_id for r in two.collect())
    assert two.columns == docs.columns and set(left) <= kept
    for i in kept - set(left):  # what goes has a near copy before it, through others at most
        assert any(neardup.within(words[i], words[j]) for j in kept if j != i)
    assert not any(neardup.within(words[i], words[j]) for i in left for j in left if i < j)

    two = spark.createDataFrame(two.collect(), docs.schema)
    three = spark.createDataFrame(corpus_pipeline.span_dedup(spark, two, sf).collect(), docs.schema)
    assert sorted((r.doc_id, r.text) for r in three.collect()) == sorted(test_spans.brute([(i, before[i]) for i in left]))
    assert all(r.n_chars == len(r.text) for r in three.collect())

    four = corpus_pipeline.best_fit_packing(spark, three, sf).collect()
    test_packing.check(four, [(r.doc_id, r.text) for r in three.collect()], 2048)
    whole = corpus_pipeline.run(spark, sf).collect()
    same = lambda rows: collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert same(whole) == same(four)


def test_odd_and_empty_tables(spark, tmp_path):
    cases.save(spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    cases.save(cases.odd(spark), tmp_path)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {6, 7, 12} - {6}
    cases.save(cases.empty(spark), tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_in_a_crowd_go(spark, monkeypatch):
    """Near copies that meet in a few crowded buckets alone: the first stays, the other goes, and nothing else."""
    monkeypatch.setattr(neardup, "CROWD", 4)
    rows, planted = test_neardup.crowd(120, 60)
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, cases.documents(spark, rows), "").collect()}
    assert left == {i for i, _ in rows} - {own + 1 for own, shared in planted if shared}
