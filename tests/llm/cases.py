"""Small tables of documents with everything that may be odd about them."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in rows], SCHEMA)


def prose(seed: int, words: int, sentence: int = 9) -> str:
    r = random.Random(seed)
    out = ["".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(r.randint(1, 4))) for _ in range(words)]
    return " ".join(w.capitalize() if i % sentence == 0 else w + "." * (i % sentence == sentence - 1) for i, w in enumerate(out)) + "."


ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (None, "no id here"), (None, None), (5, "x" * 40_000), (6, "Ab " * 3000), (7, prose(7, 300)), (8, prose(7, 300)), (7, prose(7, 300)),
    (9, "é 日本語 \u2003 \x85 \x1c end \x00 nul 😀"), (10, "a\n\na\n\na\r\nb"), (11, "don't. CAN'T! 12345 ...---***"), (12, prose(12, 60) + "\n" + prose(7, 120)),
]


def odd(spark: SparkSession) -> DataFrame:
    return documents(spark, ODD)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def save(df: DataFrame, folder, name: str = "documents") -> str:
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
