"""The operators' queries and the SQL they are checked by, as __spark_entry__.py adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import ann, bpe, html, neardup, packing, quality, repeats, scoring, spans, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_scoring": scoring.op2_scoring,
        "op3_packing": packing.op3_packing,
        "op4_spans": spans.op4_spans,
        "op5_quality": quality.op5_quality,
        "op6_neardup": neardup.op6_neardup,
        "op7_ann": ann.op7_ann,
        "op8_html": html.op8_html,
        "op9_repeats": repeats.op9_repeats,
        "op10_urls": urls.op10_urls,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_urls": urls.oracle_sql()}
