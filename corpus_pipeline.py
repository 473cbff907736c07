"""A training corpus from ``documents``: quality rules, near-dedup, span dedup, packing.

Every stage takes (spark, docs, sf_dir) and is written as Parquet and read again for the next one. All but the last
return the columns of ``documents``; the last returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import neardup, packing, quality, spans
from tidewatch.llm.common import durable, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; they are fitted on the labels of the documents given."""
    return quality.filter_documents(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return neardup.filter_documents(docs)


def span_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentences that repeat earlier ones; ``n_chars`` is that of what is left. No document goes."""
    out = spans.dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    import public_tokenizers

    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("span dedup", span_dedup), ("best-fit packing", best_fit_packing)]

#: SQL can't express the stages (trees fitted by gradient boosting, sketches, alignment): they are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs, name.replace(" ", "-"))
    return docs
