import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import cases
from tidewatch.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
CODEC = bpe.Codec(PATH, P.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


def ids(text):
    return np.frombuffer(CODEC.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=80))
def test_any_text_round_trips_and_is_what_the_library_gives(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


def test_long_pieces_and_ties():
    r = random.Random(1)
    for text in ("a" * 5000, "ab" * 5000, "".join(r.choice("abc") for _ in range(5000)), " " * 5000 + "x"):
        assert ids(text) == LIBRARY.encode_ordinary(text)


def test_query(spark, tmp_path):
    d = cases.save(cases.odd(spark), tmp_path)
    got = sorted(map(tuple, bpe.op1_bpe(spark, d).collect()), key=repr)
    want = []
    for i, t in cases.ODD:
        tokens = LIBRARY.encode_ordinary(t or "")
        want.append((i, len(tokens), hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_decode_and_empty_table(spark):
    df = bpe.encode(cases.odd(spark).withColumnRenamed("lang", "token_ids"), PATH, P.PATTERN)
    assert {(r.doc_id, bytes(r.decoded)) for r in bpe.decode(df, PATH, P.PATTERN).collect()} == {(i, (t or "").encode()) for i, t in cases.ODD}
    assert bpe.encode(cases.empty(spark), PATH, P.PATTERN).count() == 0


def test_pattern_inside_brackets():
    assert bpe.unicode_pattern(r"[^\s\p{L}]+\S") == r"[^\p{White_Space}\p{L}]+[^\p{White_Space}]"


@pytest.mark.parametrize("size", [1, 3])
def test_memory_forgets_but_never_errs(size):
    from tidewatch.llm.common import Memory

    m = Memory(str.upper, size)
    assert [m[c] for c in "abcabcabd"] == list("ABCABCABD") and len(m) <= size
