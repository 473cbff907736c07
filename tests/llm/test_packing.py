import collections
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm import cases
from tidewatch.llm import packing

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = packing.WordTokenizer(PATH)


def plain(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), max_size=4))
def test_tokenizer_is_the_library(texts):
    ids, sizes = OWN.encode_all(pa.array(texts, pa.string()))
    assert sizes.tolist() == [len(plain(t)) for t in texts]
    assert ids.tolist() == [i for t in texts for i in plain(t)]


def test_words_of_odd_form():
    for t in ("İstanbul ﬁne Straße", "THE!! %%% | -", "don't 'tis A.B C,.", "Ⅷ ª º ²½", "<|endoftext|> a</w> b", "日本語 тест", "<|endoftext|> a", "a<|endoftext|>b <|startoftext|>. <|ENDOFTEXT|>", "Über! ÜBER! über", "ȺȾ ǅ ſ ŉ"):
        assert OWN.encode_all(pa.array([t]))[0].tolist() == plain(t)


def test_memory_starts_afresh():
    small = packing.WordTokenizer(PATH, 2000)
    for i in range(5):
        texts = [cases.prose(i, 200), "x" * 5000, ""]
        ids, sizes = small.encode_all(pa.array(texts))
        assert sizes.tolist() == [len(plain(t)) for t in texts] and ids.tolist() == [i for t in texts for i in plain(t)]
    assert len(small.known) < 400


def test_dominance():
    assert packing.dominates((6, 4), (6, 3)) and packing.dominates((10,), (6, 4)) and packing.dominates((5, 5), (3, 2, 5))
    assert not packing.dominates((6, 4), (5, 5)) and not packing.dominates((5, 4), (6,))


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=12))
def test_fillings_hold_every_piece_once(histogram):
    found = packing.complete(histogram, 30, 300) if histogram else []
    got = collections.Counter()
    for bag, n in found:
        assert n > 0 and sum(bag) <= 30
        for p in bag:
            got[p] += n
    assert got == histogram


def test_completion_beats_best_fit():
    # Best fit puts 6 with 4 and is left with 5 + 3 + 2 and 5; completion finds three full sequences.
    assert sum(n for _, n in packing.complete({6: 1, 5: 2, 4: 1, 3: 2, 2: 2}, 10)) == 3
    # Bins of 10 from (5, 5), (4, 4, 2) and (3, 3, 4): exactly the lower bound.
    assert sum(n for _, n in packing.complete({5: 2, 4: 3, 3: 2, 2: 1}, 10)) == 3


def exact(histogram, capacity):
    """Fewest sequences, by trying everything."""
    items = sorted((p for p, n in histogram.items() for _ in range(n)), reverse=True)
    best = len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for r in sorted({x for x in rooms if x >= items[i]}):
            left = list(rooms)
            left.remove(r)
            place(i + 1, [*left, r - items[i]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(2, 14), st.integers(1, 2), min_size=1, max_size=5))
def test_as_few_as_can_be_on_small_cases(histogram):
    assert sum(n for _, n in packing.complete(histogram, 15)) == exact(histogram, 15)


def check(got, rows, capacity):
    left = collections.defaultdict(list)
    for r in got:
        left[r.doc_id].append(r)
    want = collections.Counter()
    for i, t in rows:
        ids = plain(t or "") + [0]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want[i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query(spark, tmp_path):
    d = cases.save(cases.odd(spark).repartition(3), tmp_path)
    got = packing.op3_packing(spark, d).collect()
    sequences = check(got, cases.ODD, 2048)
    assert sequences == -(-sum(r.length for r in got) // 2048)


def test_small_capacity_and_empty_table(spark):
    rows = [(i, cases.prose(i, 5 + i * 7 % 60)) for i in range(60)] + [(3, cases.prose(3, 26))] * 4
    got = packing.packed_documents(cases.documents(spark, rows).repartition(5), PATH, 64).collect()
    assert check(got, rows, 64) <= -(-sum(r.length for r in got) // 64) + 1
    assert packing.packed_documents(cases.empty(spark), PATH).count() == 0
