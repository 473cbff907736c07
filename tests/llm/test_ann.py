import numpy as np
import pytest

from tidewatch.llm import ann


def table(spark, vectors, ids=None):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in zip(ids if ids is not None else range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def exact(rows, every, k):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for q, v in rows:
        if q % every == 0:
            found = sorted(((-float(v @ w), i) for i, w in rows if i != q and len(w) == len(v)))
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_recall(spark, scale):
    r = np.random.default_rng(3)
    v = r.normal(size=(1500, 24)) + 3 * r.normal(size=(15, 24))[r.integers(0, 15, 1500)]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if scale:
        v *= r.uniform(0.2, 3, (1500, 1))
    want = exact(list(enumerate(v)), 20, 20)
    got = lists(ann.search(table(spark, v), shard=400))
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.95
    for q, found in got.items():
        scores = [s for _, s in found]
        assert scores == sorted(scores, reverse=True)


def test_copies_ties_and_what_takes_no_part(spark):
    same = [1.0, 0.0]
    vectors = [same] * 60 + [[0.5, 0.5], [0.0, 0.0], None, [None, 1.0], [float("nan"), 1.0], [float("inf"), 0.0], [], [1.0, 2.0, 3.0]]
    got = lists(ann.search(table(spark, vectors), k=20))
    assert got.keys() == {0, 20, 40, 60}
    assert [i for i, _ in got[0]] == list(range(1, 21)) and [i for i, _ in got[40]] == list(range(20))
    assert [i for i, _ in got[60]] == list(range(20))


def test_fewer_than_asked_repeats_and_null_ids(spark):
    got = lists(ann.search(table(spark, [[1.0], [2.0], [2.0], [-1.0], [5.0]], [0, 1, 1, 2, None]), k=20))
    assert got == {0: [(1, 2.0), (2, -1.0)]}
    assert ann.search(table(spark, [[1.0]]).limit(0)).count() == 0
    assert ann.search(table(spark, [[1.0]])).count() == 0
