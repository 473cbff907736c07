"""Operator 5: quality rules by gradient-boosted trees over document statistics.

The trees are fitted on at most ``max_train`` labelled documents (a documented bound: those of least
``xxhash64(doc_id)``), flattened into node arrays, sent along with the task and scored on whole Arrow batches. The
share of symbols, of repeated lines and of repeated words can only lower the score, and the number of words in
sentences only raise it (monotonic constraints).

Defined results: a null or empty text has no words and fails the base rule; repeated rows are judged each by itself;
extra columns pass through :func:`filter_documents` and are ignored by the query; without any label of both classes
the trees are a constant and only the base rule rejects.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import gbdt
from tidewatch.llm.common import batches_of, read_table, rows_of, text_bytes

SYMBOLS = b"#*$%&|<>"
_NOT_CHARS = b" \t\n\r\x0b\x0c" + bytes(range(0x80, 0xC0))
_UPPER, _DIGITS, _MARKS, _STOPS = bytes(range(65, 91)), bytes(range(48, 58)), b"!?", b".!?,;:"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "mark_rate", "stop_rate", "lone_symbol_rate", "shout_rate", "symbol_word_rate", "distinct_rate", "line_words")
#: Feature by direction: the score never falls (1) or never rises (-1) as it grows.
MONOTONE = {2: -1, 3: -1, 4: -1, 7: -1, 9: -1, 10: -1, 11: -1}
MAX_TRAIN = 6000


def statistics(data: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The contract's counts, and the features."""
    words = data.split()
    n = len(words)
    chars = len(data.translate(None, _NOT_CHARS))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = dups = 0
    seen: set[bytes] = set()
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    repeated = 0
    if n > 3:
        grams = list(zip(words, words[1:], words[2:], strict=False))
        times = Counter(grams)
        if len(times) < len(grams):
            covered = bytearray(n)
            for i, gram in enumerate(grams):
                if times[gram] > 1:
                    covered[i : i + 3] = b"\1\1\1"
            repeated = covered.count(1)
    of = lambda part: len(data) - len(data.translate(None, part))
    w, c = max(n, 1), max(chars, 1)
    upper, distinct = of(_UPPER), set(words)
    features = (
        float(np.log1p(n)), chars / w, symbols / c, dups / max(lines, 1), repeated / w, upper / c, of(_DIGITS) / c, of(_MARKS) / w, of(_STOPS) / w,
        (words.count(b"|") + words.count(b"-") + words.count(b"*")) / w, sum(word.isupper() and len(word) > 1 for word in words) / w, sum(word[-1] in SYMBOLS for word in words) / w, len(distinct) / w, n / max(lines, 1),
    )
    return (n, chars, symbols, dups, repeated), features


def base_failed(n: int, repeated: int) -> bool:
    return n < 50 or 100 * repeated > 50 * n


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts and ``features`` (array of double) of each document."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("features", pa.list_(pa.float64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(((doc, *counts, features) for doc, data in rows_of(batches, "doc_id", "text") for counts, features in [statistics(data)]), schema)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(work, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>")


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> gbdt.Trees:
    """Trees from the labelled documents of least hash, at most ``max_train``; positive is good quality."""
    few = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    of = {r[0]: r[1] for r in few.collect()}  # at most max_train rows
    if not of:
        return gbdt.fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    few = docs.sparkSession.createDataFrame(sorted(of), "long").toDF("doc_id")
    # Repeated ids count once, so what comes back is bounded by max_train as well.
    texts = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id", "left_semi")
    rows = measure(texts).groupBy("doc_id").agg(F.min("features").alias("features")).collect()
    rows = sorted((r[0], r[1]) for r in rows)
    x = np.array([f for _, f in rows]).reshape(-1, len(FEATURES))
    return gbdt.fit(x, np.array([of[d] for d, _ in rows], float), trees=60, monotone=MONOTONE)


def judge(df: DataFrame, trees: gbdt.Trees, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The counts, ``base_failed``, ``score`` (log odds of good quality) and ``kept``; with ``keep``, those columns of ``df`` too."""
    keep = keep or []
    inner = [f"_k{i}" for i in range(len(keep))]  # clashing names stay apart
    source = df.select(F.col(id_col).cast("long").alias("_doc"), text_bytes(text_col).alias("_data"), *(F.col(f"`{k}`").alias(i) for k, i in zip(keep, inner, strict=True)))
    names = ("_doc", *(f"_{c}" for c in COUNTS), "_base_failed", "_score", "_kept")
    kinds = (pa.int64(), *[pa.int64()] * len(COUNTS), pa.bool_(), pa.float64(), pa.bool_())
    types = ["long", *["long"] * len(COUNTS), "boolean", "double", "boolean"]
    ddl = ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)) + "".join(f", {i} {df.schema[k].dataType.simpleString()}" for k, i in zip(keep, inner, strict=True))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(data) for _, data in rows_of(iter([batch]), "_doc", "_data")]
            counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(COUNTS))
            score = trees.score(np.array([f for _, f in found]).reshape(-1, len(FEATURES)))
            failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            columns = [batch.column(batch.schema.get_field_index("_doc")), *(pa.array(counts[:, i]) for i in range(len(COUNTS))), pa.array(failed), pa.array(score), pa.array(~failed & (score > 0))]
            own = [batch.schema.get_field_index(i) for i in inner]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(i) for i in own)], schema=pa.schema([*map(pa.field, names, kinds), *(batch.schema.field(i) for i in own)]))

    out = source.mapInArrow(work, ddl)
    if keep:
        return out
    return out.select(*(F.col(n).alias(n[1:] if n != "_doc" else "doc_id") for n in names))


def filter_documents(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    out = judge(docs, train(docs, labels, max_train), keep=docs.columns)
    return out.where("_kept").select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(docs.columns)))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, the five counts, base_failed, kept; also score."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return judge(docs, train(docs, labels)).select("doc_id", *COUNTS, "base_failed", "kept", "score")
