import hashlib
import random

import numpy as np
import pytest

from tests.llm import cases
from tidewatch.llm import repeats

L = repeats.LENGTH


def brute(rows):
    first = {}
    low = lambda i: -(1 << 63) if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - L + 1):
            w = b[j : j + L]
            first[w] = min(first.get(w, low(i)), low(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - L + 1):
            if first[b[j : j + L]] < low(i):
                gone[j : j + L] = b"\1" * L
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def texts(seed):
    r = random.Random(seed)
    shared = ["".join(r.choice("ab ") for _ in range(r.randint(40, 130))) for _ in range(4)]
    return [(r.randint(0, 12), "".join(r.choice([cases.prose(r.randint(0, 10**6), r.randint(1, 12)), r.choice(shared), "aaaa" * r.randint(1, 30)]) for _ in range(r.randint(1, 5)))) for _ in range(25)]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(repeats, "BLOCK", 700)  # many blocks
    rows = texts(seed)
    assert got(repeats.dedup(cases.documents(spark, rows).repartition(3), digest=True)) == brute(rows)


def test_query_on_odd_documents(spark, tmp_path):
    rows = cases.ODD + [(30, "x" * 400), (20, cases.prose(7, 300)[:49]), (21, cases.prose(7, 300)[:50]), (22, "é" * 60), (23, "é" * 60)]
    assert got(repeats.op9_repeats(spark, cases.save(cases.documents(spark, rows), tmp_path))) == brute(rows)


def test_kept_bytes_and_empty_table(spark):
    rows = [(1, "p" + cases.prose(1, 30)), (2, "q" + cases.prose(1, 30) + "tail")]
    kept = {r.doc_id: bytes(r.kept) for r in repeats.dedup(cases.documents(spark, rows)).collect()}
    assert kept == {1: rows[0][1].encode(), 2: b"qtail"}
    assert repeats.dedup(cases.empty(spark), digest=True).count() == 0


def test_merged_order_is_that_of_one_sort():
    r = np.random.default_rng(5)
    rows = r.integers(0, 2, (12, repeats.ROW)).astype(np.uint8)
    rows[3] = np.roll(rows[1], 5)
    rows[7:9] = rows[2:4]
    rows = np.unique(rows, axis=0)
    order, bucket = repeats.merged([rows[a:b] for a, b in ((0, 3), (3, 4), (4, len(rows)))])
    rotation = lambda p: np.roll(rows[p // repeats.ROW], -(p % repeats.ROW))[:L].tobytes()
    strings = [rotation(p) for p in order]
    assert strings == sorted(strings) and sorted(order.tolist()) == list(range(rows.size))
    assert all((bucket[i] == bucket[i + 1]) == (strings[i] == strings[i + 1]) for i in range(len(strings) - 1))


def test_every_window_has_an_anchor():
    data = (cases.prose(3, 200) + "aaaa" * 40).encode()
    place, hashes, doc, windows = repeats.anchors(np.frombuffer(data, np.uint8), np.array([len(data)]))
    for j in range(len(data) - L + 1):
        assert ((place >= j) & (place <= j + L - repeats.GRAM)).any()
    index, start = windows.of(np.arange(len(place)))
    assert set(start.tolist()) == set(range(len(data) - L + 1)) and ((place[index] >= start) & (place[index] <= start + L - repeats.GRAM)).all()


@pytest.mark.parametrize("size", [60_000, 6 << 20])
def test_one_passage_in_all_documents(spark, monkeypatch, size):
    monkeypatch.setattr(repeats, "BLOCK", size)  # many blocks: its anchors are hot; few: they aren't
    rows = [(i, f"{cases.prose(i, 12)} {cases.prose(-1, 14)} {cases.prose(i + 10**6, 12)}") for i in range(5000)]
    assert got(repeats.dedup(cases.documents(spark, rows).repartition(4), digest=True)) == brute(rows)


def test_a_long_text_of_one_byte_stays_small():
    data = np.full(2_000_000, 97, np.uint8)
    row = type("Row", (), {"ids": np.array([1, 2]).tobytes(), "sizes": np.array([1_000_000, 1_000_000]).tobytes(), "data": repeats._pack(data.tobytes())})
    place, hashes, _, _ = repeats.anchors(data, np.array([1_000_000, 1_000_000]))
    right = repeats.pd.DataFrame({"part": [int(hashes[0] % 32)], "bits": [repeats._pack(b"\1")]})
    assert sum(len(p["hashes"]) for p in repeats.Regions(row, right, 32).pieces()) // 8 < 200
