"""Operator 9: bytes that repeat earlier documents, by merging the Burrows-Wheeler transforms of shards.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts in a document of smaller id.

Finding where to look. Each window of ``LENGTH`` bytes has an anchor, its ``GRAM``-byte string of least hash, so that
equal windows have equal anchors. Anchors that two documents share are found by a count over hashes; around each of
them the ``2 * LENGTH - GRAM`` bytes that windows with this anchor can lie in make a region. No other part of a text
can repeat. An anchor that is found ``HOT`` times or more is split: each window that has it is a region by itself, and
goes where its own hash (128 bits) says, so that what surrounds a common passage doesn't meet in one task.

Comparing. Equal regions are one, with its least document. Regions come together by anchor. Where an anchor has one
region alone, that is the answer for its windows. All others are split in shards; a shard sorts its
rotations and keeps its transform: the bytes before each rotation, in their order. The shards' order is then refined
into that of all rotations, two bytes a round: a round deals the rotations out by the bytes before them, in the order
so far (a stable counting pass; no suffix is compared or sorted anew), and only shard numbers move. Where neighbours'
bytes or old buckets differ, a bucket ends, so that after ``LENGTH`` bytes the buckets are the intervals with a common
prefix of that length. The least document of an interval decides for the windows in it.

Texts are stored once, in blocks of documents; both the regions and the last step are worked out from those blocks.
Intermediate tables lie in the shared folder; nothing that grows with the corpus reaches the driver, and no task gets
more than a block of documents or a partition of anchors, whose number grows with the corpus. Text is never cut.

Defined results: null and empty texts have no bytes; rows of one doc_id are one document, which don't take from each
other; a null doc_id is before all others; repeats inside one document stay; extra columns are not read; an empty
table gives an empty result. A long text is in one block, whatever its length; one that repeats itself (a run of one
byte, say) has an anchor at each byte, about 100 bytes of memory each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import drop_durable, durable, read_table, release, rows_of, text_bytes

LENGTH, GRAM = 50, 20
WIDTH = 2 * LENGTH - GRAM  # bytes of a region
ROW = WIDTH + 2  # with an end that no round of two bytes can straddle
#: Bytes of text in a block, anchors in a partition, regions compared at a time, shards of them, and places of an anchor that is split.
BLOCK, PART, CHUNK, SHARDS, HOT = 6 << 20, 500_000, 100_000, 3, 4096
LOT = 1 << 15
_FIRST = -(1 << 63)
_NONE = (1 << 63) - 1
_MIX = 0x9E3779B97F4A7C15
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _pack(data) -> bytes:
    """Compressed: texts cross shuffles, whose own compression hardly shortens them."""
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 32-bit numbers, by their differences."""
    return _pack(np.diff(keys, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpack(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint32)


def _power(n: int) -> np.uint32:
    return np.uint32(pow(_MIX, n, 1 << 32))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_MIX)
    return h ^ (h >> np.uint64(29))


def _wide(rows: np.ndarray) -> list[np.ndarray]:
    """128 bits for each row of ``WIDTH`` bytes, as two numbers."""
    words = np.ascontiguousarray(rows).view(np.uint64)
    out = [np.full(len(rows), base, np.uint64) for base in _BASES]
    for c in range(words.shape[1]):
        out = [_mixed(w + words[:, c]) for w in out]
    return out


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """``f`` over each ``width`` neighbours, by doubling."""
    k, out = 1, x
    while 2 * k <= width:
        out = f(out[: len(out) - k], out[k:])
        k *= 2
    return f(out[: len(out) - (width - k)], out[width - k :]) if width > k else out


def anchors(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Windows]:
    """Place, hash and document (index) of each anchor in concatenated documents; and the windows that have them."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none.astype(np.uint64), none, Windows(none, none, none)
    # Order of strings: hashes of 1, 2, 4 ... bytes; those whose sizes add up to GRAM are joined on the way, shortest first.
    h, k, tail, have = data.astype(np.uint32) + np.uint32(1), 1, None, 0
    while True:
        if GRAM & k:
            n = len(data) - have - k + 1
            tail, have = h[:n].copy() if tail is None else h[:n] * _power(have) + tail[k : k + n], have + k
        if 2 * k > GRAM:
            break
        h = h[: len(h) - k] * _power(k) + h[k:]
        k *= 2
    h = tail
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h |= np.uint32(1)  # 0 is left for windows that don't lie in one document
    span = LENGTH - GRAM + 1
    least = _sliding(h, span, np.minimum)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    inside = np.zeros(len(data) + 1, np.int8)
    full = sizes >= LENGTH
    np.add.at(inside, starts[full], 1)
    np.add.at(inside, ends[full] - LENGTH + 1, -1)
    least[np.cumsum(inside[: len(least)], dtype=np.int8) == 0] = 0
    pad = np.zeros(span - 1, np.uint32)
    padded = np.concatenate([pad, least, pad])
    # A place is an anchor if the least of some window around it is its own.
    most = _sliding(padded, span, np.maximum)
    place = np.flatnonzero(most == h)
    own = np.zeros(len(place), np.uint64)
    for j in range(GRAM):
        own = (own + data[place + j]) * np.uint64(_MIX)
        own ^= own >> np.uint64(32)
    return place, own, np.searchsorted(ends, place, side="right"), Windows(padded, h, place)


class Windows:
    """Which of the windows around anchors have them as their own."""

    def __init__(self, least: np.ndarray, hashes: np.ndarray, place: np.ndarray):
        self.least, self.hashes, self.place = least, hashes, place

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For some anchors: index of each window's anchor among those given, and where the window starts."""
        at = self.place[which]
        found = [np.flatnonzero(self.least[at + t] == self.hashes[at]) for t in range(LENGTH - GRAM + 1)]
        index = np.concatenate(found)
        return index, np.concatenate([at[f] + t - (LENGTH - GRAM) for t, f in enumerate(found)])


def _by_part(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes by partition and then hash; the partitions there are, and where each starts in them; the place of each hash given."""
    distinct, at = np.unique(hashes, return_inverse=True)
    part = (distinct % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    present, first = np.unique(part[order], return_index=True)
    return distinct[order], present, np.append(first, len(order)), back[at]


def _blocks(docs: DataFrame, parts: int) -> DataFrame:
    """A row a block: its documents, and by partition the hashes of its anchors (32 bits) and how often each is found, 0 if in one of its documents alone."""
    schema = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary()), ("parts", pa.list_(pa.struct([("part", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("many", pa.binary())])))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, block, held, weight = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            ids = np.array([i for i, _ in held], np.int64)
            sizes = np.array([len(d) for _, d in held], np.int64)
            data = b"".join(d for _, d in held)
            place, hashes, doc, _ = anchors(np.frombuffer(data, np.uint8), sizes)
            distinct, present, first, at = _by_part(hashes, parts)
            low, high = np.full(len(distinct), _NONE), np.full(len(distinct), _FIRST)
            np.minimum.at(low, at, ids[doc])
            np.maximum.at(high, at, ids[doc])
            keys = (distinct >> np.uint64(32)).astype(np.uint32)  # ascending in each partition
            many = np.where(low < high, np.minimum(np.bincount(at, minlength=len(distinct)), 255), 0).astype(np.uint8)
            rows = [{"part": p, "n": int(b - a), "keys": _pack_sorted(keys[a:b]), "many": _pack(many[a:b].tobytes())} for p, a, b in zip(present.tolist(), first[:-1], first[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((me << 32 | block, ids.tobytes(), sizes.tobytes(), _pack(data), rows), schema, strict=True)], schema=schema)

        for doc, data in rows_of(batches, "_id", "_data"):
            held.append((doc, data))
            weight += len(data)
            if weight >= BLOCK or len(held) >= 1 << 16:
                yield flush()
                block, held, weight = block + 1, [], 0
        if held:
            yield flush()

    return docs.mapInArrow(work, "block long, ids binary, sizes binary, data binary, parts array<struct<part: int, n: int, keys: binary, many: binary>>")


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one partition: for each block, which of its hashes another block or two of its documents have: 1, or 2 where they are many."""
    sizes = pdf["n"].to_numpy()
    keys = np.concatenate([_unpack_sorted(k) for k in pdf["keys"]])
    many = np.concatenate([np.frombuffer(_unpack(m), np.uint8) for m in pdf["many"]])
    _, at, times = np.unique(keys, return_inverse=True, return_counts=True)
    places = np.bincount(at, weights=np.maximum(many, 1))
    state = ((times > 1) | (np.bincount(at, weights=many) > 0)).astype(np.uint8)
    state[(state > 0) & (places >= HOT)] = 2
    hit = state[at]
    ends = np.cumsum(sizes)
    bits = [_pack(hit[e - n : e].tobytes()) if hit[e - n : e].any() else None for e, n in zip(ends, sizes, strict=True)]
    return pd.DataFrame({"by": pdf["block"], "part": pdf["part"], "bits": bits}).dropna()


class Regions:
    """The regions of a block, given which of its anchors are shared; worked out alike whenever it is asked for.

    ``key``, ``start``, ``size``, ``place`` (of the anchor in it) and ``doc`` of each occurrence; ``of``: its number
    among the distinct ones, which are ordered by partition and key; ``one``: an occurrence of each.
    """

    def __init__(self, row, right: pd.DataFrame, parts: int):
        self.parts = parts
        self.ids, self.sizes = np.frombuffer(row.ids, np.int64), np.frombuffer(row.sizes, np.int64)
        self.data = np.frombuffer(_unpack(row.data), np.uint8)
        ends = np.cumsum(self.sizes)
        starts = ends - self.sizes
        place, hashes, doc, windows = anchors(self.data, self.sizes)
        distinct, present, first, at = _by_part(hashes, parts)
        state = np.zeros(len(distinct), np.uint8)
        for part, bits in zip(right["part"], right["bits"], strict=True):
            i = np.searchsorted(present, int(part))
            state[first[i] : first[i + 1]] = np.frombuffer(_unpack(bits), np.uint8)
        state = state[at]
        self.padded = np.concatenate([self.data, np.zeros(WIDTH, np.uint8)])
        # At most LENGTH - GRAM bytes before an anchor and LENGTH from it on, in its document.
        keep = np.flatnonzero(state == 1)
        at, owner = place[keep], doc[keep]
        start = np.maximum(at - (LENGTH - GRAM), starts[owner])
        size = np.minimum(at + LENGTH, ends[owner]) - start
        hot = np.flatnonzero(state == 2)
        index, window = windows.of(hot) if len(hot) else (hot, hot)
        self.key = np.concatenate([hashes[keep], _mixed(self.wide(window, np.full(len(window), LENGTH))[0])])
        self.start, self.size = np.concatenate([start, window]), np.concatenate([size, np.full(len(window), LENGTH)])
        self.place = np.concatenate([at - start, np.full(len(window), WIDTH)])  # WIDTH: a window by itself
        self.doc = np.concatenate([owner, doc[hot][index]])
        part = (self.key % np.uint64(parts)).astype(np.int64)
        columns = (*self.wide(self.start, self.size), self.place, self.size, self.key, part)
        order = np.lexsort(columns)
        same = np.ones(len(order), bool)
        if len(order):
            for x in columns:
                x = x[order]
                same[1:] &= x[1:] == x[:-1]
            same[0] = False
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(~same) - 1
        self.one = order[~same]
        self.part = part[self.one]

    def bytes_(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = self.padded[start[:, None] + np.arange(WIDTH)]
        out[np.arange(WIDTH)[None, :] >= size[:, None]] = 0
        return out

    def wide(self, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """128 bits for each stretch of the data; some at a time, as there may be many."""
        lots = [_wide(self.bytes_(start[i : i + LOT], size[i : i + LOT])) for i in range(0, max(len(start), 1), LOT)]
        return [np.concatenate(x) for x in zip(*lots, strict=True)]

    def pieces(self) -> list[dict]:
        """By partition, the distinct regions: their bytes (of windows by themselves the hash of 128 bits), and the documents they are in."""
        one, low, high = self.one, np.full(len(self.one), _NONE), np.full(len(self.one), _FIRST)
        np.minimum.at(low, self.of, self.ids[self.doc])
        np.maximum.at(high, self.of, self.ids[self.doc])
        present, first = np.unique(self.part, return_index=True)
        out = []
        for p, a, b in zip(present.tolist(), first, np.append(first, len(one))[1:], strict=True):
            own = one[a:b]
            bytes_ = self.bytes_(self.start[own], self.size[own])
            alone = np.flatnonzero(self.place[own] == WIDTH)
            if len(alone):
                bytes_[alone] = 0
                wide = self.wide(self.start[own[alone]], self.size[own[alone]])
                bytes_[alone, :16] = np.stack(wide, 1).view(np.uint8).reshape(-1, 16)
            low_, high_ = low[a:b], high[a:b]
            out.append({"part": p, "base": int(a), "hashes": self.key[own].tobytes(), "sizes": _pack(self.size[own].astype(np.uint8).tobytes()), "places": _pack(self.place[own].astype(np.uint8).tobytes()), "bytes": _pack(bytes_.tobytes()), "low": _pack(low_.tobytes()), "high": _pack((high_ - low_).tobytes())})
        return out


def _regions(parts: int):
    """Of one block and the hashes in it that are shared: its regions, by partition."""

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        (row,) = left.itertuples(index=False)
        out = pd.DataFrame({"block": [row.block], "parts": [Regions(row, right, parts).pieces() if len(right) else []]})
        release()
        return out

    return work


def _packed(rows: np.ndarray, before: int, count: int) -> np.ndarray:
    """``count`` bytes of each rotation from ``before`` bytes before it on, as one integer."""
    out = np.zeros(rows.shape, np.uint64)
    for t in range(count):
        out |= np.roll(rows, before - t, axis=1).astype(np.uint64) << np.uint64(8 * (count - 1 - t))
    return out


def transform(rows: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted rotations of equally long rows (as places in them), and the ``step`` bytes before each. Equal rotations have equal bytes before them, so their order doesn't matter."""
    n = rows.size
    rank, k = _packed(rows, 0, 8), 8
    order = np.argsort(rank.ravel())
    while True:
        s = rank.ravel()[order]
        new = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])]) if n else np.zeros(0, np.int64)
        if k >= rows.shape[1] or n and new[-1] == n - 1:
            break
        rank = np.empty(n, np.uint64)
        rank[order] = new
        rank = rank.reshape(rows.shape)
        rank = rank << np.uint64(32) | np.roll(rank, -k, axis=1)
        order = np.argsort(rank.ravel())
        k *= 2
    return order, _packed(rows, step, step).ravel()[order]


def merge(shards: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """``shards``: the two bytes before each of a shard's sorted rotations.

    Place of each rotation in the order by ``2 * rounds`` bytes (of all shards' rotations, one shard after the other),
    and their buckets: equal where those bytes are.
    """
    n = sum(map(len, shards))
    z = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s) for s in shards])
    bucket = np.zeros(n, np.int32)
    before = np.empty(n, np.uint16)
    for _ in range(rounds):
        for i, own in enumerate(shards):
            before[z == i] = own
        source = np.argsort(before, kind="stable")  # numpy counts 16-bit numbers, byte by byte
        z, bucket, dealt = z[source], bucket[source], before[source]
        if n:
            ends = dealt[1:] != dealt[:-1]
            ends |= bucket[1:] != bucket[:-1]
            bucket[0] = 0
            np.cumsum(ends, dtype=np.int32, out=bucket[1:])
            if bucket[-1] == n - 1:  # all differ already
                break
    order = np.empty(n, np.int64)
    base = 0
    for i, own in enumerate(shards):
        order[z == i] = np.arange(base, base + len(own))
        base += len(own)
    return order, bucket


def merged(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All rotations (places in all parts' rows) by their first ``LENGTH`` bytes (or fewer, if all differ in those), and their buckets."""
    shards = [transform(p, 2) for p in parts]
    order, bucket = merge([s.astype(np.uint16) for _, s in shards], LENGTH // 2)
    base = np.cumsum([0, *(p.size for p in parts[:-1])])
    return np.concatenate([o + b for (o, _), b in zip(shards, base, strict=True)])[order], bucket


def window_owners(rows: np.ndarray, sizes: np.ndarray, low: np.ndarray, shards: int = SHARDS) -> np.ndarray:
    """Least document that has each window of each region, as a matrix; none where a window doesn't fit."""
    windows = WIDTH - LENGTH + 1
    cuts = np.linspace(0, len(rows), min(shards, max(len(rows), 1)) + 1).astype(int)
    order, bucket = merged([rows[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    region, at = order // ROW, order % ROW
    own = np.where(at <= sizes[region] - LENGTH, low[region], _NONE)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(own, first)[bucket] if len(bucket) else own
    out = np.full((len(rows), ROW), _NONE)
    out.ravel()[order] = np.where(own == _NONE, _NONE, least)
    return out[:, :windows]


def _alike(bytes_: np.ndarray, place: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether another region of the same anchor has the same half of what a window can have beside it, before or after.

    A window that two regions share reaches ``LENGTH - GRAM`` bytes beside the anchor, so half of them on one side.
    """
    half = (LENGTH - GRAM) // 2
    out = np.zeros(len(bytes_), bool)
    for shift in (-half, GRAM):
        own = group.astype(np.uint64)
        inside = place + shift >= 0
        at = np.where(inside, place + shift, 0)
        rows = np.arange(len(bytes_))
        for j in range(half):
            own = (own + bytes_[rows, at + j]) * np.uint64(_MIX)
            own ^= own >> np.uint64(32)
        # Too near to the start of a document for half of a window: nothing to go by on this side.
        own[~inside] = rows[~inside].astype(np.uint64)
        _, where, times = np.unique(own, return_inverse=True, return_counts=True)
        out |= (times[where] > 1) & inside
    return out


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one partition: for each block, the runs of windows (region, first, last, least document) that a smaller document may have."""
    join = lambda name, kind: np.frombuffer(b"".join(pdf[name] if name == "hashes" else map(_unpack, pdf[name])), kind)
    hashes, sizes, place, low, high = join("hashes", np.uint64), join("sizes", np.uint8).astype(np.int64), join("places", np.uint8), join("low", np.int64), join("high", np.int64)
    high = low + high
    counts = np.array([len(s) // 8 for s in pdf["hashes"]])
    bytes_ = join("bytes", np.uint8).reshape(-1, WIDTH)
    blocks, row = pdf["block"].to_numpy(), np.repeat(np.arange(len(pdf)), counts)
    number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(pdf["base"].to_numpy(), counts)
    # All regions of an anchor are in one lot.
    edges = np.sort(hashes)[CHUNK::CHUNK]
    lot = np.searchsorted(edges, hashes, side="left")
    out = []
    for i in range(len(edges) + 1):
        own = np.flatnonzero(lot == i)
        if not len(own):
            continue
        r, a, b, m = _runs(hashes[own], sizes[own], place[own].astype(np.int64), low[own], high[own], bytes_[own])
        r = own[r]
        order = np.argsort(row[r], kind="stable")
        r, a, b, m = r[order], a[order].astype(np.uint8), b[order].astype(np.uint8), m[order]
        kinds, first = np.unique(row[r], return_index=True)
        for k, x, y in zip(kinds, first, np.append(first, len(r))[1:], strict=True):
            out.append((blocks[k], number[r[x:y]].astype(np.int32).tobytes(), a[x:y].tobytes(), b[x:y].tobytes(), m[x:y].tobytes()))
    del bytes_
    release()
    return pd.DataFrame(out, columns=["by", "region", "a", "b", "owner"])


def _runs(hashes: np.ndarray, sizes: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, bytes_: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one owner, where a document with the region comes after it: region, first and last window, owner."""
    # Equal regions of all blocks are one.
    wide = _wide(bytes_)
    order = np.lexsort((wide[1], wide[0], place == WIDTH, sizes, hashes))
    fresh = np.ones(len(order), bool)
    anchor = np.ones(len(order), bool)
    anchor[1:] = hashes[order][1:] != hashes[order][:-1]
    fresh[1:] = anchor[1:]
    for x in (sizes, place == WIDTH, *wide):
        fresh[1:] |= x[order][1:] != x[order][:-1]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(fresh) - 1
    one = order[fresh]
    least = np.full(len(one), _NONE)
    np.minimum.at(least, of, low)
    group = np.cumsum(anchor)[fresh] - 1
    whole = place[one] != WIDTH  # windows by themselves are alike or not, by their hashes
    several = (np.bincount(group, weights=whole)[group] > 1) & whole
    several[several] = _alike(bytes_[one[several]], place[one[several]], group[several])
    windows = WIDTH - LENGTH + 1
    owners = np.where(np.arange(windows)[None, :] <= (sizes[one] - LENGTH)[:, None], least[:, None], _NONE)
    pick = np.flatnonzero(several)
    if len(pick):
        rows = np.zeros((len(pick), ROW), np.uint8)
        rows[:, :WIDTH] = bytes_[one[pick]]
        owners[pick] = window_owners(rows, sizes[one[pick]], least[pick])
    mine = owners[of]
    take = mine < high[:, None]
    edge = take.copy()
    edge[:, 1:] &= ~take[:, :-1] | (mine[:, 1:] != mine[:, :-1])
    stop = take.copy()
    stop[:, :-1] &= ~take[:, 1:] | (mine[:, 1:] != mine[:, :-1])
    r, a = np.nonzero(edge)
    return r, a, np.nonzero(stop)[1], mine[r, a]


def _finish(parts: int, digest: bool):
    """Of one block, what is known of its anchors and the runs found: a row for each of its documents."""

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        (row,) = left.itertuples(index=False)
        asked = right["bits"].notna()
        found = Regions(row, right[asked], parts) if (~asked).any() else None
        ids, sizes, data = np.frombuffer(row.ids, np.int64), np.frombuffer(row.sizes, np.int64), np.frombuffer(_unpack(row.data), np.uint8)
        marks = np.zeros(len(data) + 1, np.int32)
        if found:
            order = np.argsort(found.of, kind="stable")
            first = np.searchsorted(found.of[order], np.arange(len(found.one) + 1))
            for some in right[~asked].itertuples(index=False):
                r, a, b, m = np.frombuffer(some.region, np.int32), np.frombuffer(some.a, np.uint8), np.frombuffer(some.b, np.uint8), np.frombuffer(some.owner, np.int64)
                n = first[r + 1] - first[r]
                own = order[np.repeat(first[r], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                later = ids[found.doc[own]] > np.repeat(m, n)
                own = own[later]
                np.add.at(marks, found.start[own] + np.repeat(a, n)[later], 1)
                np.add.at(marks, found.start[own] + np.repeat(b, n)[later] + LENGTH, -1)
        gone = np.cumsum(marks[:-1], dtype=np.int32) > 0
        ends = np.cumsum(sizes)
        starts = ends - sizes
        count = lambda x: np.concatenate([np.zeros(1, np.int32), np.cumsum(x, dtype=np.int32)])
        total = count(gone)
        rise = gone.copy()
        rise[1:] &= ~gone[:-1]
        rise[starts[sizes > 0]] = gone[starts[sizes > 0]]
        spans = count(rise)
        kept = ((data[a:b][~gone[a:b]] if total[b] > total[a] else data[a:b]).tobytes() for a, b in zip(starts, ends, strict=True))
        out = pd.DataFrame({
            "doc_id": pd.array([None if i == _FIRST else int(i) for i in ids], dtype="Int64"), "n_bytes": sizes, "n_removed": total[ends] - total[starts], "n_spans": spans[ends] - spans[starts],
            "kept_sha256" if digest else "kept": [hashlib.sha256(k).hexdigest() for k in kept] if digest else list(kept),
        })
        del row, data, marks, gone, total, rise, spans, found
        release()
        return out

    return work


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept`` (binary: what is left), or with ``digest`` its ``kept_sha256``."""
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)).alias("_id"), text_bytes(text_col).alias("_data"))
    total = docs.agg(F.coalesce(F.sum(F.length("_data")), F.lit(0))).first()[0]
    parts = max(16, int(total * 2 / (LENGTH - GRAM + 2)) // PART)
    blocks = durable(_blocks(docs, parts), "blocks")
    hashes = blocks.select("block", F.explode("parts").alias("x")).select("block", "x.*")
    bits = durable(hashes.groupBy("part").applyInPandas(_shared, "by long, part int, bits binary"), "shared")
    texts = blocks.select("block", "ids", "sizes", "data")
    piece = "array<struct<part: int, base: int, hashes: binary, sizes: binary, places: binary, bytes: binary, low: binary, high: binary>>"
    regions = texts.groupBy("block").cogroup(bits.groupBy("by")).applyInPandas(_regions(parts), f"block long, parts {piece}")
    pieces = regions.select("block", F.explode("parts").alias("x")).select("block", "x.*")
    runs = durable(pieces.groupBy("part").applyInPandas(_compare, "by long, region binary, a binary, b binary, owner binary"), "runs")
    known = bits.unionByName(runs, allowMissingColumns=True)
    kind = "kept_sha256 string" if digest else "kept binary"
    return texts.groupBy("block").cogroup(known.groupBy("by")).applyInPandas(_finish(parts, digest), f"doc_id long, n_bytes long, n_removed long, n_spans long, {kind}")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return dedup(read_table(spark, sf_dir, "documents"), digest=True)
