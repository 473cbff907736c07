"""Operator 2: language-model scores by prediction by partial matching.

A text is its tokens: words (A-Z lower-cased) with a space between two, and one end. The model is a trie of byte
contexts: a byte is predicted from up to ``ORDER`` bytes before it, across spaces and from the start of the text. At
the longest order, counts are those of all training documents; at each shorter one a byte counts once for each context
one byte longer that it was seen in (update exclusion). A context is left for the next shorter one by an escape, and a
byte that a longer context has seen is excluded from the shorter ones. What an escape costs is estimated from the
training text itself: among all contexts of one order alike in their total, their kinds of bytes and how far back
their last word starts, how often a byte, were it left out, would be new. The score is the sum of the code lengths of all
bytes, as log10 of the probability of the text.

Documents are stored once, in blocks. A block sends its distinct byte strings (context and byte) and words with their
training counts to partitions by the last three context bytes, or by the word's hash; a partition adds them up and
remembers who asked; what it finds of contexts of two bytes (2^24 cells at most, whatever the corpus) and of escapes
(some thousand states) is added up and reaches the driver; then it answers with a code length for each string and a
count for each word. Nothing that grows with the corpus is collected or broadcast. Words are told apart by 64 bits.

Defined results: a null or empty text is one end token; a null doc_id counts as an empty string for the fold (and so
is for training); repeated rows, and rows of one doc_id, count and are scored each by itself; extra columns, whatever
their names, are not read; an empty table gives an empty result; with no training document, every byte is as likely as
any other. A very long text is in one block, whole, and takes about 40 bytes of memory a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import durable, hash_words, mixed, read_table, release, rows_of, text_bytes

ORDER = 6
#: Bytes of text in a block, and in the corpus for each partition of strings.
BLOCK, PART = 8 << 20, 16 << 20
_SPACE, _END = 0x20, 0x0A  # no word has either
#: States of a context: totals (exact below 8, then two for each doubling), kinds of bytes, bytes since the last space.
_TOTALS, _KINDS, _SINCE = 40, 12, ORDER + 1


def fold(id_col: str = "doc_id"):
    """Whether a document is held out: crc32 of its id as text, mod 5, is 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _pack(x: np.ndarray) -> bytes:
    """By byte planes, which zstd shortens well for small numbers."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=x.dtype.type(0)))


def _unpack_sorted(data: bytes, kind) -> np.ndarray:
    return np.cumsum(_unpack(data, kind), dtype=kind)


def stream(data: bytes) -> bytes:
    """What is predicted of a text: its words with a space between two, and the end."""
    return b" ".join(data.lower().split()) + b"\n"


def strings(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Context (the byte before highest) and byte at each place of concatenated streams; before its start a stream has ends."""
    out = data.astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    for j in range(1, ORDER + 1):
        out[j:] |= data[:-j].astype(np.uint64) << np.uint64(8 * (ORDER + 1 - j))
    # The first places reach into the stream before: their context bytes from there are ends.
    for i in range(ORDER):
        own = starts[sizes > i] + i
        keep = sum(0xFF << 8 * (ORDER + 1 - j) for j in range(1, i + 1)) | 0xFF
        ends = sum(_END << 8 * (ORDER + 1 - j) for j in range(i + 1, ORDER + 1))
        out[own] = out[own] & np.uint64(keep) | np.uint64(ends)
    return out


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of concatenated streams, and where it starts."""
    gap = (data == _SPACE) | (data == _END)
    start = ~gap
    start[1:] &= gap[:-1]
    starts = np.flatnonzero(start)
    sizes = np.flatnonzero(gap)[np.searchsorted(np.flatnonzero(gap), starts)] - starts if len(starts) else starts
    return hash_words(data, starts, sizes), starts


def _distinct(values: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values (below 2^63) and how many are for training."""
    s = np.sort(values << np.uint64(1) | train)
    value = s >> np.uint64(1)
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(s) else np.zeros(0, np.int64)
    return value[first], np.add.reduceat(s & np.uint64(1), first).astype(np.uint32) if len(s) else np.zeros(0, np.uint32)


def _dealt(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by partition, in which what was ascending stays so; the partitions there are, and where each starts."""
    order = np.argsort(part, kind="stable")
    present, first = np.unique(part[order], return_index=True)
    return order, present, np.append(first, len(part))


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """By the last three bytes of the context."""
    return (mixed(keys >> np.uint64(32)) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.uint32)


def _word_part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (hashes % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.uint32)


def _blocks(docs: DataFrame, id_col: str, text_col: str, held, parts: int) -> DataFrame:
    """A row for each block: its documents, and by partition its distinct strings and words with their training counts."""
    source = docs.select(F.col(id_col).cast("long").alias("_id"), held.alias("_held"), text_bytes(text_col).alias("_data"))
    piece = pa.struct([("part", pa.int32()), ("keys", pa.binary()), ("times", pa.binary()), ("words", pa.binary()), ("often", pa.binary())])
    schema = pa.schema([("block", pa.int64()), ("trained", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary()), ("parts", pa.list_(piece))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, block, texts, ids, out, weight = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(t) for t in texts], np.int64)
            data, held = np.frombuffer(b"".join(texts), np.uint8), np.array(out, bool)
            texts.clear()
            train = np.repeat(~held, sizes)
            rows: dict[int, dict] = {}
            for names, (values, count), of in ((("keys", "times"), _distinct(strings(data, sizes), train), _part_of), (("words", "often"), _words(data, train), _word_part)):
                order, present, first = _dealt(of(values, parts), parts)
                values, count = values[order], count[order]
                for p, a, b in zip(present.tolist(), first[:-1], first[1:], strict=True):
                    rows.setdefault(p, {"part": p}).update({names[0]: _pack_sorted(values[a:b]), names[1]: _pack(count[a:b])})
            row = (me << 32 | block, len(held) - int(held.sum()), ids, held.tobytes(), sizes.tobytes(), zstandard.ZstdCompressor(level=1).compress(data.tobytes()), list(rows.values()))
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, schema, strict=True)], schema=schema)

        for doc, away, data in rows_of(batches, "_id", "_held", "_data"):
            texts.append(stream(data))
            ids.append(doc)
            out.append(away)
            weight += len(texts[-1])
            if weight >= BLOCK or len(ids) >= 1 << 16:
                yield flush()
                block, weight, ids, out = block + 1, 0, [], []
                release()
        if ids:
            yield flush()

    return source.mapInArrow(work, "block long, trained long, ids array<long>, held binary, sizes binary, data binary, parts array<struct<part: int, keys: binary, times: binary, words: binary, often: binary>>")


def _words(data: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, starts = words(data)
    return _distinct(hashes >> np.uint64(1), train[starts])


class Level:
    """Contexts of one order among sorted strings: the context and the (context, byte) of each string, and their statistics."""

    def __init__(self, keys: np.ndarray, order: int, above: Level | None, times: np.ndarray):
        n = len(keys)
        context = keys >> np.uint64(8 * (ORDER + 1 - order))
        change = np.ones(n, bool)
        change[1:] = context[1:] != context[:-1]
        self.order, self.of = order, np.cumsum(change) - 1
        self.context = context[change]
        if above is None:
            self.first = self.at = np.arange(n)
            self.own = times.astype(np.float64)
        else:
            _, self.first, self.at = np.unique(self.of << 8 | (keys & np.uint64(0xFF)).astype(np.int64), return_index=True, return_inverse=True)
            self.own = np.bincount(self.at[above.first], weights=above.own > 0, minlength=len(self.first))
        self.count(self.of[self.first], len(self.context))

    def count(self, of: np.ndarray, n: int) -> None:
        self.pair = of
        sums = lambda x: np.bincount(of, weights=x, minlength=n)
        self.total, self.kinds, self.once = sums(self.own), sums(self.own > 0), sums(self.own == 1)

    def since(self) -> np.ndarray:
        """Bytes after the last space (or end) of each context."""
        out = np.full(len(self.context), self.order)
        for j in range(self.order, 0, -1):
            byte = self.context >> np.uint64(8 * (self.order - j)) & np.uint64(0xFF)
            out[(byte == _SPACE) | (byte == _END)] = j - 1
        return out

    def escapes(self) -> pd.DataFrame:
        """By state: how often a byte of a training text, left out, would be new in its context, and how often not."""
        many, since = self.total > 1, self.since()
        total, kinds, once, since = self.total[many], self.kinds[many], self.once[many], since[many]
        states = np.concatenate([state(self.order, total - 1, kinds - 1, since), state(self.order, total - 1, kinds, since)])
        new, old = np.concatenate([once, np.zeros(len(once))]), np.concatenate([np.zeros(len(once)), total - once])
        kept, at = np.unique(states, return_inverse=True)
        return pd.DataFrame({"state": kept, "new": np.bincount(at, weights=new, minlength=len(kept)).astype(np.int64), "old": np.bincount(at, weights=old, minlength=len(kept)).astype(np.int64)})


def state(order: int, total: np.ndarray, kinds: np.ndarray, since: np.ndarray) -> np.ndarray:
    t = np.where(total < 8, total, 8 + np.floor(2 * np.log2(np.maximum(total, 8) / 8)))
    return (((order * _TOTALS + np.minimum(t, _TOTALS - 1)) * _KINDS + np.minimum(kinds, _KINDS - 1)) * _SINCE + since).astype(np.int64)


def levels(keys: np.ndarray, times: np.ndarray) -> list[Level]:
    """Of orders ``ORDER`` to 3, which need the strings of their own three bytes only."""
    out: list[Level] = []
    for order in range(ORDER, 2, -1):
        out.append(Level(keys, order, out[-1] if out else None, times))
    return out


class Short(Level):
    """Contexts of two, one or no bytes of the whole corpus, from the cells (context and byte) of the next order."""

    def __init__(self, order: int, cells: np.ndarray, own: np.ndarray):
        self.order, self.cells, self.own = order, cells, own.astype(np.float64)
        self.context = np.arange(1 << 8 * order, dtype=np.uint64)
        self.count(cells >> 8, len(self.context))

    def shorter(self) -> Short:
        # The byte before lies highest: the last byte of the context goes.
        cells, at = np.unique((self.cells >> 16) << 8 | self.cells & 0xFF, return_inverse=True)
        return Short(self.order - 1, cells, np.bincount(at, weights=self.own > 0, minlength=len(cells)))

    def get(self, cells: np.ndarray) -> np.ndarray:
        """Count of (context, byte)."""
        if not len(self.cells):
            return np.zeros(len(cells))
        i = np.minimum(np.searchsorted(self.cells, cells), len(self.cells) - 1)
        return np.where(self.cells[i] == cells, self.own[i], 0.0)


class Model:
    """What is known of the whole corpus: short contexts and the rate of escapes in each state."""

    def __init__(self, cells: np.ndarray, own: np.ndarray, escapes: pd.DataFrame):
        self.short = [Short(2, cells, own)]
        for _ in range(2):
            self.short.append(self.short[-1].shorter())
        new, old = np.zeros((2, (ORDER + 1) * _TOTALS * _KINDS * _SINCE))
        for table in (escapes, *(s.escapes() for s in self.short)):
            at = table["state"].to_numpy(np.int64)
            np.add.at(new, at, table["new"].to_numpy(np.float64))
            np.add.at(old, at, table["old"].to_numpy(np.float64))
        self.rate = (new + 0.5) / (new + old + 1)

    def escape(self, level: Level) -> np.ndarray:
        return self.rate[state(level.order, level.total, level.kinds, level.since())]

    def code_lengths(self, found: list[Level], keys: np.ndarray) -> np.ndarray:
        """log10 probability of each string's byte after its context."""
        n, byte = len(keys), (keys & np.uint64(0xFF)).astype(np.int64)
        log, open_ = np.zeros(n), np.ones(n, bool)
        excluded = seen = np.zeros(n)  # of this order: counts and kinds that the longer context has
        all_ = [*found, *self.short]
        own = [*(f.own[f.at] for f in found)]
        of = [*(f.of for f in found)]
        for s in self.short:
            context = (keys >> np.uint64(8 * (ORDER + 1 - s.order))).astype(np.int64)
            own.append(s.get(context << 8 | byte))
            of.append(context)
        for i, f in enumerate(all_):
            left, new, escape = f.total[of[i]] - excluded, f.kinds[of[i]] - seen, self.escape(f)[of[i]]
            live = open_ & (new > 0)
            hit = live & (own[i] > 0)
            log[hit] += np.log10((1 - escape[hit]) * own[i][hit] / left[hit])
            open_ &= ~hit
            miss = live & ~hit
            log[miss] += np.log10(escape[miss])
            if i + 1 < len(all_):
                # Of the next order: what the bytes seen in this context count there.
                if i < len(found):
                    excluded = np.bincount(f.pair, weights=own[i + 1][f.first] * (f.own > 0), minlength=len(f.context))[of[i]]
                else:
                    below = all_[i + 1].get((f.cells >> 16) << 8 | f.cells & 0xFF)
                    excluded = np.bincount(f.pair, weights=below * (f.own > 0), minlength=len(f.context))[of[i]]
                seen = f.kinds[of[i]]
        log[open_] -= np.log10(max(256 - self.short[-1].kinds[0], 1))
        return log


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one partition: its distinct strings and words with their counts, which of them each block asked for, and what it adds to the whole corpus' tables."""
    part = int(pdf["part"].iloc[0])

    def added(name: str, count: str, kind) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
        own = [i for i, x in enumerate(pdf[name]) if x is not None]
        lots = [_unpack_sorted(pdf[name].iloc[i], kind) for i in own]
        if not lots:
            return np.zeros(0, kind), np.zeros(0, np.int64), [None] * len(pdf)
        times = np.concatenate([_unpack(pdf[count].iloc[i], np.uint32) for i in own])
        values, at = np.unique(np.concatenate(lots), return_inverse=True)
        asked: list[bytes | None] = [None] * len(pdf)
        reached = 0
        for i, x in zip(own, lots, strict=True):
            asked[i] = _pack_sorted(at[reached : reached + len(x)].astype(np.uint32))
            reached += len(x)
        return values, np.bincount(at, weights=times).astype(np.int64), asked

    keys, times, asked = added("keys", "times", np.uint64)
    hashes, often, asked_words = added("words", "often", np.uint64)
    found = levels(keys, times)
    escapes = pd.concat([f.escapes() for f in found])
    cells = np.zeros(0, np.int64)
    if len(keys):
        three = found[-1]
        own = (keys[three.first] >> np.uint64(40) << np.uint64(8) | keys[three.first] & np.uint64(0xFF)).astype(np.int64)[three.own > 0]
        cells, own = np.unique(own, return_counts=True)
    else:
        own = cells
    out = {
        "part": part, "keys": _pack_sorted(keys), "times": _pack(times), "often": _pack(often), "n_words": int(often.sum()), "n_kinds": int((often > 0).sum()),
        "blocks": [{"block": b, "keys": k, "words": w} for b, k, w in zip(pdf["block"].tolist(), asked, asked_words, strict=True)],
        "cells": [{"cell": int(c), "n": int(n)} for c, n in zip(cells, own, strict=True)],
        "escapes": [{"state": int(s), "new": int(n), "old": int(o)} for s, n, o in escapes.itertuples(index=False)],
    }
    release()
    return pd.DataFrame({k: [v] for k, v in out.items()})


def _answers(model: Model):
    """Of one partition: code lengths and counts for each block that asked."""
    schema = pa.schema([("by", pa.int64()), ("part", pa.int32()), ("logs", pa.binary()), ("often", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keys, times, often, blocks in rows_of(batches, "part", "keys", "times", "often", "blocks"):
            keys, often = _unpack_sorted(keys, np.uint64), _unpack(often, np.int64)
            logs = model.code_lengths(levels(keys, _unpack(times, np.int64)), keys).astype(np.float32)
            for b in blocks:
                own = logs[_unpack_sorted(b["keys"], np.uint32)].tobytes() if b["keys"] is not None else None
                n = _pack(often[_unpack_sorted(b["words"], np.uint32)]) if b["words"] is not None else None
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((b["block"], part, own, n), schema, strict=True)], schema=schema)
            release()

    return work


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held=None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held = fold(id_col) if held is None else held
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    parts = max(8, size // PART)
    blocks = durable(_blocks(docs, id_col, text_col, held, parts), "blocks")
    ends = blocks.agg(F.coalesce(F.sum("trained"), F.lit(0))).first()[0]  # training documents
    pieces = blocks.select("block", F.explode("parts").alias("x")).select("block", "x.*")
    ddl = "part int, keys binary, times binary, often binary, n_words long, n_kinds long, blocks array<struct<block: long, keys: binary, words: binary>>, cells array<struct<cell: int, n: int>>, escapes array<struct<state: int, new: long, old: long>>"
    merged = durable(pieces.groupBy("part").applyInPandas(_merge, ddl), "merged")
    n_words, kinds = merged.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_kinds"), F.lit(0))).first()
    train_tokens, kinds = n_words + ends, kinds + (ends > 0)
    # Contexts of two bytes and a byte: 2^24 at most, whatever the corpus. States: some ten thousand at most.
    cells = merged.select(F.explode("cells").alias("x")).groupBy("x.cell").agg(F.sum("x.n").alias("n")).toArrow().to_pandas().sort_values("cell")
    escapes = merged.select(F.explode("escapes").alias("x")).groupBy("x.state").agg(F.sum("x.new").alias("new"), F.sum("x.old").alias("old")).toArrow().to_pandas()
    model = Model(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.int64), escapes)
    answers = merged.select("part", "keys", "times", "often", "blocks").mapInArrow(_answers(model), "by long, part int, logs binary, often binary")
    base = lambda c: np.log10((c + 0.5) / (train_tokens + 0.5 * (kinds + 1)))

    def total(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        (row,) = left.itertuples(index=False)
        ids, sizes = list(row.ids), np.frombuffer(row.sizes, np.int64)
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.data), np.uint8)
        doc = np.repeat(np.arange(len(ids)), sizes)

        def answered(values: np.ndarray, of, lots) -> np.ndarray:
            """For each value, what its partition answered for it."""
            order = np.argsort(values)
            s = values[order]
            change = np.ones(len(s), bool)
            change[1:] = s[1:] != s[:-1]
            distinct = s[change]
            dealt, present, first = _dealt(of(distinct, parts), parts)
            answer = np.zeros(len(distinct))
            where = dict(zip(present.tolist(), zip(first[:-1], first[1:], strict=True), strict=True))
            for p, x in lots:
                a, b = where[p]
                answer[dealt[a:b]] = x
            out = np.empty(len(values))
            out[order] = np.repeat(answer, np.diff(np.append(np.flatnonzero(change), len(s))))
            return out

        log = answered(strings(data, sizes), _part_of, ((p, np.frombuffer(x, np.float32)) for p, x in zip(right["part"], right["logs"], strict=True) if x is not None))
        add = lambda of, x=None: np.bincount(of, weights=x, minlength=len(ids))
        total_log = add(doc, log)
        del log
        hashes, starts = words(data)
        c = answered(hashes >> np.uint64(1), _word_part, ((p, _unpack(x, np.int64)) for p, x in zip(right["part"], right["often"], strict=True) if x is not None))
        at = doc[starts]
        out = {"doc_id": pd.array([None if pd.isna(x) else int(x) for x in ids], dtype="Int64"), "held_out": np.frombuffer(row.held, bool), "n_tokens": add(at) + 1, "n_known": add(at, c > 0).astype(np.int64) + (ends > 0), "train_tokens": train_tokens, "base_score": add(at, base(c)) + base(ends), "score": total_log}
        del data, doc, hashes, c
        release()
        return pd.DataFrame(out)

    return blocks.drop("parts", "trained").groupBy("block").cogroup(answers.groupBy("by")).applyInPandas(total, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return score(read_table(spark, sf_dir, "documents"))
