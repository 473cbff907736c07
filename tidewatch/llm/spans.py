"""Operator 4: substring dedup by sliding sentence spans.

Every text is cut in sentences (after ``.!?`` before white space, and at line ends), and every sentence after the word
of least hash of each ``CHUNK`` consecutive words in it, so that pieces have at most ``CHUNK`` words and words that two
texts share are cut alike ``CHUNK`` words from their ends on: 51 of them always hold a span. A span is a run of at
least ``SENTENCES`` consecutive sentences with at least ``WORDS`` words: the shortest such run from each sentence on,
and the shortest that ends with each. Spans are hashed, by their words, and joined over all documents; the first one,
in the order of doc_id and then of place, stays, and every sentence that another one covers is removed.

Texts are worked on by the lot, with numpy. What crosses the shuffle is one row per lot and partition of hashes: its
distinct spans and their documents, in some eight bytes each. Only hashes that two documents share come back to the texts.

Defined results: null and empty texts have no sentences and stay as they are; texts whose sentences all stay are
returned unchanged to the byte; rows with one doc_id are one document, whose rows don't take from each other; a null
doc_id is a document before all others; repeated spans inside one text count like those of others; a text may be of
any length; an empty table gives an empty result; extra columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import hash_words, mixed, read_table, release, rows_of, text_bytes

SENTENCES, WORDS, CHUNK = 2, 16, 8
#: Bytes of text in a lot, and in the corpus for each partition of spans.
LOT, PART = 4 << 20, 16 << 20
_FIRST = -(1 << 63)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, out=out)


class Lot:
    """The sentences and spans of some texts.

    ``begin`` and ``end`` (bytes in the texts, joined by line ends), ``words`` and ``doc`` of each sentence (or piece of
    one); ``first``, ``last`` (the sentence after it), ``key`` and ``of`` (document) of each span, by document and place.
    """

    def __init__(self, texts: list[bytes], least: int = SENTENCES, words: int = WORDS):
        joined = b"\n".join([*texts, b""])
        data = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.starts = np.cumsum(sizes) - sizes
        gap = _SPACE[data]
        edge = np.ones(len(data), bool)
        edge[1:] = gap[1:] != gap[:-1]
        starts = np.flatnonzero(edge & ~gap)
        ends = np.flatnonzero(edge & gap)
        ends = ends[1:] if len(ends) > len(starts) else ends  # white space before the first word
        n = len(starts)
        lines = np.cumsum((data == 10) | (data == 13), dtype=np.int32)
        last = np.ones(n, bool)  # of a sentence
        if n:
            mark = data[ends - 1]
            last[:-1] = lines[starts[1:] - 1] > lines[ends[:-1] - 1]
            last |= (mark == 0x2E) | (mark == 0x21) | (mark == 0x3F)
        h = hash_words(data, starts, ends - starts)
        if n >= CHUNK:
            # The least of each CHUNK in a row, of equal ones the last.
            key = h & np.uint64(0xFFFFFFFF00000000) | np.arange(n, 0, -1).astype(np.uint64)
            sentence = np.cumsum(last) - last
            windows = np.lib.stride_tricks.sliding_window_view
            smallest = windows(key, CHUNK).min(1)
            smallest[sentence[CHUNK - 1 :] != sentence[: n - CHUNK + 1]] = 0
            pad = np.zeros(CHUNK - 1, np.uint64)
            last |= windows(np.concatenate([pad, smallest, pad]), CHUNK).max(1) == key
        to = np.flatnonzero(last)
        at = np.concatenate([[0], to[:-1] + 1]) if len(to) else to
        self.begin, self.end, self.words = starts[at], ends[to], to - at + 1
        self.doc = np.searchsorted(self.starts, self.begin, side="right") - 1
        m = len(to)
        total = np.concatenate([[0], np.cumsum(self.words)])
        i = np.arange(m)
        j = np.maximum(i + least, np.searchsorted(total, total[:-1] + words))
        ok = j <= np.searchsorted(self.doc, self.doc, side="right")
        back = np.minimum(i + 1 - least, np.searchsorted(total, total[1:] - words, side="right") - 1)
        fits = back >= np.searchsorted(self.doc, self.doc)
        runs = np.unique(np.concatenate([i[ok] << 32 | j[ok], back[fits] << 32 | i[fits] + 1]))
        self.first, self.last = runs >> 32, runs & 0xFFFFFFFF
        self.of = self.doc[self.first] if m else self.first
        # Prefix sums of the words' hashes times powers of an odd base, and that power taken back.
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, n))])
        a, b = (at[self.first], to[self.last - 1] + 1) if m else (self.first, self.first)
        self.key = mixed((sums[b] - sums[a]) * _powers(pow(_BASE, -1, 1 << 64), n)[a] + (b - a).astype(np.uint64)).view(np.int64)

    def gone(self, repeated: np.ndarray) -> np.ndarray:
        """Which sentences go: those of the spans that are marked, and of the others' places all but the first in a text."""
        order = np.lexsort((self.first, self.key, self.of))
        again = np.zeros(len(order), bool)
        again[1:] = (self.of[order][1:] == self.of[order][:-1]) & (self.key[order][1:] == self.key[order][:-1])
        gone = repeated.copy()
        gone[order[again]] = True
        cover = np.zeros(len(self.begin) + 1, np.int64)
        np.add.at(cover, self.first[gone], 1)
        np.add.at(cover, self.last[gone], -1)
        return np.cumsum(cover[:-1]) > 0


def sentences(data: bytes) -> list[tuple[int, int, int]]:
    """(start, end, words) of each piece of a sentence; ends exclude the white space after it."""
    lot = Lot([data])
    return list(zip(lot.begin.tolist(), lot.end.tolist(), lot.words.tolist(), strict=True))


def spans(data: bytes) -> dict[int, list[tuple[int, int]]]:
    """Hash of each span to its places, (first sentence, sentence after the last), in order."""
    lot, out = Lot([data]), {}
    for key, i, j in zip(lot.key.tolist(), lot.first.tolist(), lot.last.tolist(), strict=True):
        out.setdefault(key, []).append((i, j))
    return out


def strip_all(texts: list[bytes], repeated: list[set[int] | np.ndarray]) -> list[tuple[bytes, int, list[tuple[int, int]]]]:
    """Of each text what is left, the number of sentences, and the removed ones as (start, end) bytes.

    All places of the hashes in a text's ``repeated`` go, and of the other hashes all but the first place.
    """
    lot = Lot(texts)
    marked = np.zeros(len(lot.key), bool)
    bounds = np.searchsorted(lot.of, np.arange(len(texts) + 1))
    for d, keys in enumerate(repeated):
        if len(keys):
            marked[bounds[d] : bounds[d + 1]] = np.isin(lot.key[bounds[d] : bounds[d + 1]], np.fromiter(keys, np.int64, len(keys)) if isinstance(keys, set) else keys)
    gone = np.flatnonzero(lot.gone(marked))
    own = np.searchsorted(lot.doc[gone], np.arange(len(texts) + 1))
    counts = np.diff(np.searchsorted(lot.doc, np.arange(len(texts) + 1))).tolist()
    out = []
    for d, data in enumerate(texts):
        removed = [(int(a), int(b)) for a, b in zip(lot.begin[gone[own[d] : own[d + 1]]] - lot.starts[d], lot.end[gone[own[d] : own[d + 1]]] - lot.starts[d], strict=True)]
        if removed:
            kept, at = [], 0
            for a, b in removed:
                kept.append(data[at:a])
                at = b
                # The white space after it goes as well, so that no blank line is left behind.
                while at < len(data) and data[at] in b" \t\n\r\x0b\x0c":
                    at += 1
            data = b"".join([*kept, data[at:]])
        out.append((data, counts[d], removed))
    return out


def strip(data: bytes, repeated: set[int]) -> tuple[bytes, int, list[tuple[int, int]]]:
    return strip_all([data], [repeated])[0]


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id`` and ``_spans`` (array of binaries, each some hashes): the spans of a document that one with a smaller id has too."""
    schema = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("of", pa.binary()), ("keys", pa.binary())])
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    parts = max(16, size // PART)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
            distinct, at = np.unique(np.array(ids, np.int64), return_inverse=True)
            lot = Lot(texts)
            key, of = lot.key.view(np.uint64), at[lot.of].astype(np.uint32)
            part = (key % np.uint64(parts)).astype(np.uint32)
            order = np.lexsort((of, key, part))
            key, of, part = key[order], of[order], part[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
            key, of, part = key[fresh], of[fresh], part[fresh]
            present, first = np.unique(part, return_index=True)
            edges = list(zip(first, np.append(first, len(key))[1:], strict=True))
            columns = (present, [_pack(distinct)] * len(edges), [_pack(of[a:b]) for a, b in edges], [_pack(np.diff(key[a:b], prepend=np.uint64(0))) for a, b in edges])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        ids, texts, weight = [], [], 0
        for doc, data in rows_of(batches, "_id", "_data"):
            ids.append(doc)
            texts.append(data)
            weight += len(data)
            if weight >= LOT or len(ids) >= 1 << 14:
                yield rows(ids, texts)
                ids, texts, weight = [], [], 0
                release()
        if ids:
            yield rows(ids, texts)

    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in pdf["keys"]])
        ids = np.concatenate([_unpack(x, np.int64)[_unpack(of, np.uint32)] for x, of in zip(pdf["ids"], pdf["of"], strict=True)])
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        first = ids[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        own = np.flatnonzero(ids > first)
        own = own[np.argsort(ids[own], kind="stable")]
        docs, at = np.unique(ids[own], return_index=True)
        keys = keys[own]
        release()
        return pd.DataFrame({"_id": docs, "_span": [keys[a:b].tobytes() for a, b in zip(at, np.append(at, len(keys))[1:], strict=True)]})

    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)).alias("_id"), text_bytes(text_col).alias("_data"))
    own = source.mapInArrow(work, "part int, ids binary, of binary, keys binary")
    return own.groupBy("part").applyInPandas(shared, "_id long, _span binary").groupBy("_id").agg(F.collect_list("_span").alias("_spans"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its text stripped, and ``n_sentences``, ``n_removed`` and ``removed`` (array of (start, end) bytes)."""
    columns = docs.columns
    found = repeated_spans(docs, id_col, text_col)
    inner = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)).alias("_id"), *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)))
    joined = inner.join(found, "_id", "left").select("_spans", *(f"_c{i}" for i in range(len(columns))))
    text = f"_c{columns.index(text_col)}"
    at = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, total, lost = [], [], []
            for at_ in range(0, batch.num_rows, 256):
                part = batch.slice(at_, 256)
                keys, texts = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("_spans", text))
                found = strip_all([(t or "").encode() for t in texts], [np.frombuffer(b"".join(k or ()), np.int64) for k in keys])
                for t, (kept, n, removed) in zip(texts, found, strict=True):
                    new.append(None if t is None else kept.decode())
                    total.append(n)
                    lost.append([{"start": a, "end": b} for a, b in removed])
            release()
            own = [pa.array(new, pa.string()) if f.name == text else batch.column(i) for i, f in enumerate(batch.schema) if f.name != "_spans"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(total, pa.int64()), pa.array([len(x) for x in lost], pa.int64()), pa.array(lost, at)], names=[*(f.name for f in batch.schema if f.name != "_spans"), "n_sentences", "n_removed", "removed"])

    ddl = ", ".join(f"_c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns)) + ", n_sentences long, n_removed long, removed array<struct<start: long, end: long>>"
    return joined.mapInArrow(work, ddl).select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)), "n_sentences", "n_removed", "removed")


def op4_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, text (what is left), n_sentences, n_removed, removed."""
    return dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
