"""Both tiers as Parquet partitioned by site and UTC date, on any file system that Spark knows.

A batch owns its files: it writes under ``batch=<id>``, which a replay overwrites, so that nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.rollup import build
from tidewatch.plans.timerange import Span, utc_dates
from tidewatch.schema import ALWAYS, EVENT, ROLLUP, complete


def segment(c: Column) -> Column:
    """A safe path segment of a name: lower case, other characters '_', at most 128, never empty or dots alone."""
    s = F.substring(F.regexp_replace(F.lower(c), "[^a-z0-9._-]", "_"), 1, 128)
    return F.when(s.rlike(r"^\.*$"), "_").otherwise(s)


def _dated(df: DataFrame, ms: str) -> DataFrame:
    return df.withColumns({"site_dir": segment(F.col("site")), "date": F.date_format(F.timestamp_millis(F.col(ms)), "yyyy-MM-dd")})


def write_batch(events: DataFrame, root: str, batch: int, rows_per_file: int = 2_000_000) -> None:
    """Raw rows and their rollups of one batch; writing it again replaces both."""
    whole = complete(events)
    out = lambda df, tier: df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).partitionBy("site_dir", "date").parquet(f"{root}/{tier}/batch={batch}")
    spread = _dated(whole, "ts_ms").repartition("site_dir", "date", F.floor(F.col("ts_ms") / 3_600_000))
    out(spread.sortWithinPartitions("site_dir", "date", "ts_ms"), "raw")
    out(_dated(build(whole), "hour"), "rollup")


def _read(spark: SparkSession, root: str, tier: str, schema, site: str | None, span: Span | None) -> DataFrame:
    from pyspark.sql import types as T

    with_dirs = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("site_dir", T.StringType()), T.StructField("date", T.StringType())])
    df = spark.read.schema(with_dirs).parquet(f"{root}/{tier}")
    if site is not None:  # the directory prunes, the column decides: names that differ by case share a directory
        df = df.where((F.col("site_dir") == segment(F.lit(site))) & (F.col("site") == site))
    if span is not None:
        a, b = utc_dates(span)
        df = df.where(F.col("date").between(a, b))
    return df.select(*schema.names)


def raw(spark: SparkSession, root: str, site: str | None = None, span: Span | None = None) -> DataFrame:
    """Raw rows; columns that old files lack read as '' or 0."""
    return complete(_read(spark, root, "raw", EVENT, site, span), ALWAYS)


def rollups(spark: SparkSession, root: str, site: str | None = None, span: Span | None = None) -> DataFrame:
    return _read(spark, root, "rollup", ROLLUP, site, span)


def prune(spark: SparkSession, root: str, before: str) -> list[str]:
    """Deletes the partitions of both tiers whose UTC date is before ``before``; what it deleted."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    gone = []
    for tier in ("raw", "rollup"):
        top = fs_path(f"{root}/{tier}")
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.globStatus(fs_path(f"{root}/{tier}/batch=*/site_dir=*/date=*")) or []:
            if status.getPath().getName().removeprefix("date=") < before:
                fs.delete(status.getPath(), True)
                gone.append(status.getPath().toString())
    return gone
