"""What the operators share: durable intermediate tables, Arrow helpers, word splitting."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it

#: White space of the word rule ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits on exactly these.
SPACES = b" \t\n\r\x0b\x0c"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only where the session names none (tests) a local one is made."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewatch-"))
    return sc.getCheckpointDir().rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts lineage, survives lost executors.

    Shuffle files of the write go when it is done, since nothing reads them any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    # Rows can be long: small Arrow batches keep what is outside the heap small as well.
    batch, cleanup = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, clean = spark.conf.get(batch), spark.conf.get(cleanup, "false")
    spark.conf.set(batch, str(min(int(before), 1024) if int(before) > 0 else 1024))
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(batch, before)
        spark.conf.set(cleanup, clean)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text"):
    """The whole text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def release() -> None:
    """Gives what this worker has freed back to the system: workers idle on between stages, and their memory adds up."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows as tuples, a few at a time so that long texts aren't all Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True)
    release()


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048, weigh=None, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows, or about ``most`` bytes by ``weigh(row)``."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += weigh(row) if weigh else 0
        if len(held) >= size or weight >= most:
            yield to_batch(held, schema)
            held, weight = [], 0
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_MIX = np.uint64(0x9E3779B97F4A7C15)
_LONG = 64  # bytes of a word hashed by numpy


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def hash_words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bits for each stretch of the bytes."""
    out = sizes.astype(np.uint64)
    order = np.argsort(-np.minimum(sizes, _LONG + 1), kind="stable")
    long = np.count_nonzero(sizes > _LONG)
    for i in order[:long]:
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]].tobytes())
    order = order[long:]
    below = -sizes[order]
    for j in range(-int(below[0]) if len(order) else 0):
        own = order[: np.searchsorted(below, -j, side="left")]
        out[own] = mixed(out[own] ^ data[starts[own] + j] + np.uint64(1))
    return out


class Memory(dict):
    """What ``make(key)`` gave for keys, of which about the last ``size`` (and ``most`` bytes of keys) to twice as many are remembered."""

    def __init__(self, make, size: int, most: int = 24 << 20):
        super().__init__()
        self.make, self.size, self.most, self.old, self.bytes = make, size, most, {}, 0

    def __missing__(self, key):
        if not self.recall(key):
            self.put(key, self.make(key))
        return self[key]

    def recall(self, key) -> bool:
        """Whether the key is remembered; it is then among the newer ones."""
        found = self.old.get(key)
        if found is None:
            return key in self
        self.put(key, found)
        return True

    def put(self, key, value) -> None:
        self.bytes += len(key)
        if len(self) >= self.size or self.bytes > self.most:
            self.old, self.bytes = dict(self), len(key)
            self.clear()
        self[key] = value


def drop_durable(df: DataFrame) -> None:
    """Deletes the files of a durable table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

