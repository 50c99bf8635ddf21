"""The corpus queries and their SQL."""

from __future__ import annotations

from . import decontaminate, gif, html_text, jaccard_join, language_id, line_dedup, mixing, pii, quality, token_counts
from .common import read


def queries() -> dict:
    return {
        "op1_mixing": lambda spark, d: mixing.op1_mixing(read(spark, d, "documents")),
        "op2_pii": lambda spark, d: pii.op2_pii(read(spark, d, "documents")),
        "op3_gif": lambda spark, d: gif.op3_gif(read(spark, d, "documents")),
        "op4_jaccard_join": lambda spark, d: jaccard_join.op4_jaccard_join(read(spark, d, "documents")),
        "op5_language_id": lambda spark, d: language_id.op5_language_id(read(spark, d, "documents")),
        "op5_language_id_pages": lambda spark, d: language_id.op5_pages(read(spark, d, "pages")),
        "op6_token_counts": lambda spark, d: token_counts.op6_token_counts(read(spark, d, "documents")),
        "op7_quality": lambda spark, d: quality.op7_quality(read(spark, d, "documents"), read(spark, d, "labels")),
        "op8_html": lambda spark, d: html_text.op8_html(read(spark, d, "pages")),
        "op9_line_dedup": lambda spark, d: line_dedup.op9_line_dedup(read(spark, d, "documents")),
        "op10_decontaminate": lambda spark, d: decontaminate.op10_decontaminate(read(spark, d, "documents"), read(spark, d, "benchmark")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.SQL, "op9_line_dedup": line_dedup.SQL}
