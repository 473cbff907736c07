import re

import numpy as np

from tests.llm import cases
from tidewatch.llm import spans
from tidewatch.llm.common import hash_words


def word_hash(word):
    data = np.frombuffer(word, np.uint8)
    return int(hash_words(data, np.array([0]), np.array([len(data)]))[0]) >> 32


def pieces(data):
    """Words of each sentence or piece of one, with their places, one word after the other."""
    out, held = [], []
    for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", data):
        if held and (held[-1][0][-1:] in (b".", b"!", b"?") or re.search(rb"[\r\n]", data[held[-1][2] : m.start()])):
            out.append(held)
            held = []
        held.append((m[0], m.start(), m.end()))
    out += [held] if held else []
    cut = []
    for sentence in out:
        after = set()
        for i in range(len(sentence) - spans.CHUNK + 1):
            after.add(min(range(i, i + spans.CHUNK), key=lambda k: (word_hash(sentence[k][0]), -k)))
        now = []
        for k, w in enumerate(sentence):
            now.append(w)
            if k in after or k == len(sentence) - 1:
                cut.append(now)
                now = []
    return cut


def runs(found):
    """The shortest run of two pieces and 16 words from each piece on, and to each."""
    n, out = len(found), set()
    for i in range(n):
        for step in (1, -1):
            words, k = 0, i
            while 0 <= k < n and (words + len(found[k]) < spans.WORDS or abs(k - i) + 1 < spans.SENTENCES):
                words, k = words + len(found[k]), k + step
            if 0 <= k < n:
                out.add((min(i, k), max(i, k) + 1))
    return {(i, j): b" ".join(w[0] for p in found[i:j] for w in p) for i, j in sorted(out)}


def brute(rows):
    """Texts in the order of ids, each without the pieces of runs whose words one before has, or that it had before."""
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if t is None:
            out.append((i, None))
            continue
        data, found = t.encode(), pieces(t.encode())
        gone, own = set(), set()
        for (a, b), text in runs(found).items():
            if text in own or any(d != i for d in seen.get(text, ())):
                gone |= set(range(a, b))
            own.add(text)
        for text in own:
            seen.setdefault(text, set()).add(i)
        kept, at = [], 0
        for k in sorted(gone):
            kept.append(data[at : found[k][0][1]])
            at = found[k][-1][2]
            at += len(data[at:]) - len(data[at:].lstrip(b" \t\n\r\x0b\x0c"))
        out.append((i, b"".join([*kept, data[at:]]).decode()))
    return out


def got(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


PASSAGE = cases.prose(99, 60, 12)


def test_against_brute_force(spark, tmp_path):
    rows = [(i, cases.prose(i, 50) + "\n" + (PASSAGE if i % 3 == 0 else "") + " " + cases.prose(100 + i, 30)) for i in range(12)] + cases.ODD
    d = cases.save(cases.documents(spark, rows), tmp_path)
    assert got(spans.op4_spans(spark, d)) == sorted(brute(rows), key=repr)


def test_a_passage_goes_and_the_rest_stays(spark):
    first, second = cases.prose(1, 40) + "\n" + PASSAGE, cases.prose(2, 40) + "\n" + PASSAGE + "\n" + cases.prose(3, 40)
    out = dict(got(spans.dedup(cases.documents(spark, [(1, first), (2, second)]))))
    assert out[1] == first
    assert out[2] == cases.prose(2, 40) + "\n" + cases.prose(3, 40)


def test_single_sentences_and_short_runs_stay(spark):
    a, b = "Same line here. " + cases.prose(1, 40), "Same line here. " + cases.prose(2, 40)
    assert dict(got(spans.dedup(cases.documents(spark, [(1, a), (2, b)])))) == {1: a, 2: b}


def test_long_sentences_are_runs_too():
    data = (" ".join(f"w{i}" for i in range(100)) + ".").encode()
    marks = spans.sentences(data)
    assert sum(m[2] for m in marks) == 100 and max(m[2] for m in marks) <= spans.CHUNK and spans.spans(data)
    # Cuts don't hang on where the sentence starts.
    later = {data[a:b] for a, b, _ in marks[2:]}
    shifted = b"new words before " + data
    assert later <= {shifted[a:b] for a, b, _ in spans.sentences(shifted)}


def test_any_51_common_words_hold_a_span():
    """Passages glued into sentences of any length, against brute force over windows of 50 words."""
    for seed in range(200):
        sentence = (4, 9, 25, 10_000)[seed % 4]
        passage = cases.prose(5000 + seed, 51, sentence).rstrip(".").lower()
        first, second = (f"{cases.prose(k, 30, 10_000).rstrip('.')} {passage} {cases.prose(k + 1, 30, 10_000).lower()}" for k in (9000 + 4 * seed, 9002 + 4 * seed))
        windows = [{tuple(t.split()[i : i + 50]) for i in range(len(t.split()) - 49)} for t in (first, second)]
        assert windows[0] & windows[1]
        seen = set(spans.spans(first.encode()))
        left, _, removed = spans.strip(second.encode(), seen)
        words = sum(len(second.encode()[a:b].split()) for a, b in removed)
        assert 23 <= words <= 51, seed


def test_repeats_inside_a_text_and_columns(spark):
    df = cases.documents(spark, [(1, PASSAGE + " " + PASSAGE)]).withColumnRenamed("lang", "_spans")
    out = spans.dedup(df).collect()
    assert out[0].text.strip() == PASSAGE and out[0]["_spans"] == "en" and out[0].n_removed == out[0].n_sentences // 2
    assert spans.dedup(cases.empty(spark)).count() == 0
