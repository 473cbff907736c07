"""Operator 3: best-fit packing by bin completion.

Pieces of one length are interchangeable, so a packing is decided by the histogram of lengths: at most ``capacity``
counts, whatever the corpus. The driver searches on that histogram alone (branch and bound over undominated fillings
around the largest piece left, pruned by the waste the incumbent leaves over; best fit, with and without
an exact end, gives the first incumbent; the search is limited, ``WIDTH`` and ``NODES``, as the problem is hard) and gets a table of fillings with multiplicities. Pieces are then placed in parallel: a piece's place among those of its
length, which needs only counts per (partition, length), picks its sequence and offset by binary search.

Ids are those of the library called plainly: the strings of its special tokens become those tokens.

Defined results: a null or empty text is the single end id; texts longer than ``capacity`` tokens are cut in full
pieces and a rest; repeated rows, and rows with equal or null ids, are packed each by itself; extra columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import batches_of, durable, read_table, release

CAPACITY = 2048
END = np.zeros(1, "<u4")
#: Bytes of remembered words and their ids at which a worker starts afresh, bytes of text whose words are looked up together, and words encoded together.
MEMORY, CHUNK, WORDS = 64 << 20, 4 << 20, 10_000
#: Limits of the search: fillings looked at around one piece, and nodes in all.
WIDTH, NODES = 12, 20_000


#: Words of Latin letters, of which each is one piece for the splitting pattern, with or without marks, which are one too.
_LETTERS = "[a-zA-Z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{12f}\\x{132}-\\x{24f}]+"
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LATIN = "".join(map(chr, (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x130), *range(0x132, 0x250))))


class WordTokenizer:
    """Texts to ids, by their distinct words.

    The vocabulary drops white space and its splitting pattern crosses none, so the ids of a text are those of its
    words (between ASCII white space; any other is left to the library), one after the other. A word of plain form is
    two strings with ids of their own, its letters in lower case and the marks after them; any other is one string.
    New strings of letters are encoded in one call: the last id of each, and no other, is that of a token with the
    word-end suffix. ``flat`` has the ids of all strings known, ``begin`` and ``size`` where each has its own.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.memory = memory
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.flat, self.begin, self.size, self.bytes = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64), 0

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, strings: list[str], letters: bool) -> None:
        parts, sizes = [], []
        for i in range(0, len(strings), WORDS):
            some = strings[i : i + WORDS]
            if letters:
                found = self.ids(" ".join(some))
                ends = np.flatnonzero(self.ends[found]) + 1
            if letters and len(ends) == len(some):  # else they are encoded one by one
                parts.append(found)
                sizes.append(np.diff(ends, prepend=0))
            else:
                each = [e.ids for e in self.library.encode_batch_fast(some, add_special_tokens=False)]
                parts += [np.array(e, "<u4") for e in each]
                sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
        if not strings:
            return
        self.known.update(zip(strings, range(len(self.size), len(self.size) + len(strings)), strict=True))
        size = np.concatenate([self.size, *sizes])
        self.flat, self.size, self.begin = np.concatenate([self.flat, *parts]), size, np.cumsum(size) - size
        self.bytes += sum(map(len, strings)) + 120 * len(strings) + 4 * sum(map(len, parts))

    def _places(self, strings: pa.Array, letters: bool) -> np.ndarray:
        """Where each string is among those known."""
        kinds = pc.dictionary_encode(strings)
        distinct = kinds.dictionary.to_pylist()
        self._learn([x for x in distinct if x not in self.known], letters)
        return np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[kinds.indices.to_numpy(zero_copy_only=False)]

    def _distinct(self, words: pa.Array) -> np.ndarray:
        """The two strings of each word; the second is often empty."""
        stems = pc.utf8_rtrim(words, characters=_MARKS)
        plain = pc.match_substring_regex(stems, f"^{_LETTERS}$")
        own = plain.to_numpy(zero_copy_only=False)
        out = np.zeros((len(words), 2), np.int64)
        out[own, 0] = self._places(pc.utf8_lower(stems.filter(plain)), True)
        out[own, 1] = self._places(pc.utf8_ltrim(words.filter(plain), characters=_LATIN), False)
        out[~own, 0] = self._places(words.filter(pc.invert(plain)), False)
        return out

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        if self.bytes > self.memory:
            self.forget()
        split = pc.ascii_split_whitespace(texts)
        words = pc.dictionary_encode(split.flatten())
        strings = self._distinct(pc.cast(words.dictionary, pa.string()))[words.indices.to_numpy(zero_copy_only=False)].ravel()
        offsets = split.offsets.to_numpy()
        del split, words
        each = self.size[strings]
        total = np.concatenate([[0], np.cumsum(each)])
        where = np.repeat(self.begin[strings] - total[:-1], each)
        where += np.arange(total[-1])
        return self.flat[where], np.diff(total[2 * offsets])


_held: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _held:
        _held[path] = WordTokenizer(path)
    return _held[path]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """doc_id and text of about ``CHUNK`` bytes of rows at a time."""
    held: list[pa.RecordBatch] = []
    weight = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            held.append(part)
            weight += part.nbytes
            if weight >= CHUNK:
                yield _joined(held)
                held, weight = [], 0
                release()
    if held:
        yield _joined(held)
    release()


def _joined(parts: list[pa.RecordBatch]) -> tuple[list, pa.Array]:
    whole = pa.Table.from_batches(parts).combine_chunks()
    return whole["doc_id"].to_pylist(), pa.concat_arrays(whole["text"].chunks)


def _labelled(batches: Iterator[pa.RecordBatch], capacity: int, name: str = "length") -> Iterator[pa.RecordBatch]:
    """Each row with its partition (``_part``) and its place there among rows of its length (``_place``)."""
    reached = np.zeros(capacity + 1, np.int64)
    part = TaskContext.get().partitionId()
    for batch in batches:
        length = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
        place = np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        kinds, first, n = np.unique(length[order], return_index=True, return_counts=True)
        place[order] = np.arange(len(length)) - np.repeat(first, n) + np.repeat(reached[kinds], n)
        reached[kinds] += n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(place)], schema=pa.schema([*batch.schema, ("_part", pa.int32()), ("_place", pa.int64())]))


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ``token_ids`` (binary, little-endian unsigned 32-bit), the end id included.

    With ``digest`` their ``ids_crc32`` instead of the ids, and what :func:`pack` needs to know of a row's place.
    """
    last = ("ids_crc32", pa.int64()) if digest else ("token_ids", pa.binary())
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), last])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)

        def rows():
            for docs, texts in chunks(batches):
                ids, sizes = t.encode_all(texts)
                reached = np.cumsum(sizes).tolist()
                for doc, a, b in zip(docs, [0, *reached], reached, strict=False):
                    own = np.append(ids[a:b], END)
                    for i, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        yield doc, i, at, len(part), zlib.crc32(part) if digest else part.tobytes()

        found = batches_of(rows(), schema, weigh=None if digest else lambda r: len(r[4]))
        yield from _labelled(found, capacity) if digest else found

    ddl = "doc_id long, piece int, start long, length long, " + ("ids_crc32 long, _part int, _place long" if digest else "token_ids binary")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(work, ddl)


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of ``b`` fit in rooms as large as the pieces of ``a``: then ``a`` leaves no worse a rest.

    Tried by best fit, largest first: what it says is dominated is so, and some dominated fillings may stay.
    """
    rooms = sorted(a)
    for piece in sorted(b, reverse=True):
        i = bisect.bisect_left(rooms, piece)
        if i == len(rooms):
            return False
        bisect.insort(rooms, rooms.pop(i) - piece)
    return True


def fillings(counts: list[int], present: list[int], room: int, width: int = WIDTH) -> list[tuple[int, tuple[int, ...]]]:
    """Up to ``width`` undominated fillings of ``room``, as (waste, lengths), least waste first.

    ``present`` has the lengths that are left, ascending. A filling is maximal (nothing left fits its waste), and a
    single piece that fits exactly dominates all others.
    """
    if not present or present[0] > room:
        return [(room, ())]
    if room < len(counts) and counts[room]:
        return [(0, (room,))]
    out: list[tuple[int, tuple[int, ...]]] = []
    steps = [64 * width]

    def extend(space: int, top: int, taken: tuple[int, ...]) -> None:
        i = bisect.bisect_right(present, min(space, top)) - 1
        any_fit = False
        while i >= 0 and steps[0] > 0 and sum(w == 0 for w, _ in out[-width:]) < 3 and len(out) < 4 * width:
            length = present[i]
            if counts[length] > taken.count(length):
                any_fit = True
                steps[0] -= 1
                rest = space - length
                if rest and rest < length and counts[rest]:
                    out.append((0, (*taken, length, rest)))
                elif rest and len(taken) < 40:
                    extend(rest, length, (*taken, length))
                else:
                    out.append((rest, (*taken, length)))
            i -= 1
            if len(taken) >= 3 and any_fit:  # deeper down only the largest that fits, as best fit does
                break
        if not any_fit:
            smaller = bisect.bisect_right(present, space)
            if all(counts[p] <= taken.count(p) for p in present[:smaller]):
                out.append((space, taken))

    extend(room, room, ())
    best: list[tuple[int, tuple[int, ...]]] = []
    for waste, bag in sorted(set(out), key=lambda f: (f[0], len(f[1]), tuple(-x for x in f[1]))):
        if len(best) < width and not any(dominates(other, bag) for _, other in best):
            best.append((waste, bag))
    return best or [(room, ())]


def complete(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Fillings (lengths, descending) and how many sequences have each; as few sequences as the search finds.

    It ends at the lower bound, when no node is left, or after ``nodes`` nodes.
    """
    start = [0] * (capacity + 1)
    for length, n in histogram.items():
        start[length] = n
    total = sum(length * n for length, n in histogram.items())
    least = -(-total // capacity)

    def take(counts: list[int], present: list[int], bag: tuple[int, ...], times: int) -> list[int]:
        for length in bag:
            counts[length] -= times
        return [p for p in present if counts[p]] if any(not counts[p] for p in bag) else present

    def most(counts: list[int], bag: tuple[int, ...]) -> int:
        return min(counts[p] // bag.count(p) for p in set(bag))

    def best_fit(exact: bool) -> list[tuple[tuple[int, ...], int]]:
        """The largest that fits, again and again; with ``exact`` two that fill the room, where there are such."""
        counts, out = list(start), []
        present = [p for p in range(1, capacity + 1) if counts[p]]
        while present:
            bag, room, left = [present[-1]], capacity - present[-1], dict()
            left[present[-1]] = counts[present[-1]] - 1
            if exact:
                some = np.array(counts)
                some[present[-1]] -= 1
            while True:
                if exact and room > 1 and not some[room]:
                    both = (some[1:room] > 0) & (some[room - 1 : 0 : -1] > 0)
                    if not room % 2 and some[room // 2] < 2:
                        both[room // 2 - 1] = False
                    at = np.flatnonzero(both)
                    if len(at):
                        bag += [room - int(at[0]) - 1, int(at[0]) + 1]
                        break
                i = bisect.bisect_right(present, room) - 1
                while i >= 0 and left.get(present[i], counts[present[i]]) == 0:
                    i -= 1
                if i < 0:
                    break
                p = present[i]
                n = min(room // p, left.get(p, counts[p]))
                if exact:  # one at a time: the next may have a better end
                    n = 1
                    some[p] -= 1
                bag += [p] * n
                left[p] = left.get(p, counts[p]) - n
                room -= n * p
            bag = tuple(sorted(bag, reverse=True))
            times = most(counts, bag)
            present = take(counts, present, bag, times)
            out.append((bag, times))
        return out

    best = best_fit(False)
    bound = sum(n for _, n in best)
    if bound > least:
        best = min(best, best_fit(True), key=lambda found: sum(n for _, n in found))
        bound = sum(n for _, n in best)
    if bound == least:
        return best

    # Depth first with an explicit stack: (lengths used so far, sequences so far, waste so far).
    counts, path, used, waste = list(start), [], 0, 0
    choices: list[list] = []
    present = [p for p in range(1, capacity + 1) if counts[p]]
    while nodes > 0:
        nodes -= 1
        done = not present
        if done and used < bound:
            best, bound = [(bag, n) for bag, n, _ in path], used
            if bound == least:
                break
        # One sequence fewer than the incumbent's may waste no more than this.
        allowed = (bound - 1) * capacity - total
        if not done and waste <= allowed:
            top = present[-1]
            counts[top] -= 1
            options = fillings(counts, present if counts[top] else present[:-1], capacity - top)
            counts[top] += 1
            choices.append([((top, *bag), w) for w, bag in reversed(options)])
        else:
            choices.append([])
        while choices:
            if choices[-1]:
                bag, w = choices[-1].pop()
                n = most(counts, bag)
                if w:  # what leaves waste is taken as rarely as may be, unless nothing else fits its piece
                    n = n if len(bag) == 1 else max(1, n // 2)
                allowed = (bound - 1) * capacity - total
                if waste + w * n > allowed and n > 1:
                    n = 1
                if waste + w * n > allowed:
                    continue
                present = take(counts, present, bag, n)
                path.append((bag, n, w))
                used += n
                waste += w * n
                break
            choices.pop()
            if not path:
                return best
            bag, n, w = path.pop()
            for length in bag:
                counts[length] += n
            present = [p for p in range(1, capacity + 1) if counts[p]]
            used -= n
            waste -= w * n
        else:
            return best
    return best


def placements(found: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first place, first sequence, pieces of it in a sequence, offset of the first; of each run of places."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    reached: dict[int, int] = {}
    sequence = 0
    for bag, n in found:
        offset = 0
        for length in sorted(set(bag), reverse=True):
            each = bag.count(length)
            runs.setdefault(length, []).append((reached.get(length, 0), sequence, each, offset))
            reached[length] = reached.get(length, 0) + each * n
            offset += each * length
        sequence += n
    return {length: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for length, r in runs.items()}


def pack(df: DataFrame, capacity: int = CAPACITY, length_col: str = "length", labels: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``sequence_id`` and ``offset``; lengths are from 1 to ``capacity``.

    ``df`` is written once with each row's partition and its place there among rows of its length. ``labels`` is
    ``("_part", "_place")`` where it has both already.
    """
    columns = [c for c in df.columns if c not in labels]
    inner = df.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)), F.col(f"`{length_col}`").cast("long").alias("_length"), *labels)
    if not labels:
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema)
        inner = inner.mapInArrow(lambda batches: _labelled(batches, capacity, "_length"), ddl + ", _part int, _place long")
    rows = durable(inner, "pack")
    counts = rows.groupBy("_part", "_length").agg(F.count(F.lit(1)).alias("_n"))
    # At most ``capacity`` rows reach the driver.
    histogram = {r[0]: r[1] for r in counts.groupBy("_length").agg(F.sum("_n")).collect()}
    full = histogram.pop(capacity, 0)
    found = complete(histogram, capacity) if histogram else []
    if full:
        found.append(((capacity,), full))
    tables = placements(found)
    before = Window.partitionBy("_length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", "_length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda n: batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            length, at = get("_length"), get("_start") + get("_place")
            sequence, offset = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for kind in np.unique(length):
                first, base, each, start = tables[int(kind)]
                own = np.flatnonzero(length == kind)
                i = np.searchsorted(first, at[own], side="right") - 1
                inside = at[own] - first[i]
                sequence[own] = base[i] + inside // each[i]
                offset[own] = start[i] + inside % each[i] * kind
            keep = [batch.column(batch.schema.get_field_index(f"_c{i}")) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=[*(f"_c{i}" for i in range(len(columns))), "sequence_id", "offset"])

    out = rows.join(starts, ["_part", "_length"]).mapInArrow(place, ", ".join(f"_c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(columns)) + ", sequence_id long, offset long")
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)), "sequence_id", "offset")


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, path, capacity, digest=True), capacity, labels=("_part", "_place"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    import public_tokenizers

    return packed_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
