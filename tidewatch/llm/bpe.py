"""Operator 1: byte-level BPE encoding and decoding.

A segment tree over the byte positions of a piece stores the leftmost pair of least rank. Each merge reads the
root and makes three point updates, each logarithmic in the piece, so that a piece of n bytes takes O(n log n)
even where the splitting pattern finds no boundary in a whole document.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows and rows with equal ids
are encoded each by itself; extra columns of the input are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import Memory, batches_of, read_table, rows_of, text_bytes

#: Pieces a worker remembers (up to twice as many).
MEMORY = 300_000
#: ``\s`` as Unicode's White_Space, which is what the rank files' own library takes.
WHITE = r"\p{White_Space}"
_NONE = 1 << 62


def unicode_pattern(pattern: str) -> str:
    """``pattern`` with its white space classes spelled out, outside and inside of brackets."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(WHITE if inside else f"[{WHITE}]")
            i += 2
        elif two == r"\S":
            out.append(f"[^{WHITE}]")
            i += 2
        elif two[:1] == "\\":
            out.append(two)
            i += 2
        else:
            inside = (inside or two[0] == "[") and two[0] != "]"
            out.append(two[0])
            i += 1
    return "".join(out)


def segment_tree_merge(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """The ids of one piece. A leaf holds ``rank << 32 | position`` of the pair that starts there."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1 << max(0, (n - 2).bit_length())
    tree = [_NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << 32 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n))

    def put(i: int, key: int) -> None:
        i += size
        tree[i] = key
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a < b else b
            if tree[i] == least:
                break
            tree[i] = least
            i >>= 1

    def key(i: int, end: int) -> int:
        if end - i > longest:
            return _NONE
        r = get(piece[i:end])
        return _NONE if r is None else r << 32 | i

    while tree[1] != _NONE:
        i = tree[1] & 0xFFFFFFFF
        j = after[i]
        k = after[j]
        after[i] = k
        if j < n - 1:
            put(j, _NONE)
        if k < n:
            before[k] = i
            put(i, key(i, after[k]))
        else:
            put(i, _NONE)
        p = before[i]
        if p >= 0:
            put(p, key(p, k))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Encodes to and decodes from little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.longest = max(map(len, self.ranks))
        self.vocabulary = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.vocabulary[rank] = token
        self.split = regex.compile(unicode_pattern(pattern)).findall
        self.memory = Memory(self.piece, MEMORY)

    def piece(self, word: str) -> bytes:
        piece = word.encode()
        rank = self.ranks.get(piece)
        ids = [rank] if rank is not None else segment_tree_merge(piece, self.ranks, self.longest)
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.memory.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, memoryview(ids).cast("I")))


_held: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    if (path, pattern) not in _held:
        _held[path, pattern] = Codec(path, pattern)
    return _held[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``id_col``, ``token_ids`` (binary: little-endian unsigned 32-bit) and, if asked, ``decoded`` (binary: bytes of those ids)."""
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("token_ids", pa.binary())] + [("decoded", pa.binary())] * decoded)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)

        def rows():
            for doc, text in rows_of(batches, "doc_id", "text"):
                ids = c.encode(text.decode("utf-8", "replace"))
                yield (doc, ids, c.decode(ids)) if decoded else (doc, ids)

        yield from batches_of(rows(), schema, weigh=lambda r: 2 * len(r[1]))

    return source.mapInArrow(work, "doc_id long, token_ids binary" + ", decoded binary" * decoded)


def decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``decoded`` (binary) of the ``token_ids`` that :func:`encode` made; null ids decode to no bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        yield from batches_of(((doc, c.decode(ids or b"")) for doc, ids in rows_of(batches, "doc_id", "token_ids")), schema, weigh=lambda r: len(r[1]))

    return df.select("doc_id", "token_ids").mapInArrow(work, "doc_id long, decoded binary")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    out = encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return out.select("doc_id", (F.length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
