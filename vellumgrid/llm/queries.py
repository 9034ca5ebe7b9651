"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellumgrid.llm import decontamination, language, line_templates, near_duplicates, personal_data, pieces, quality, token_counts, token_store, vector_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.query,
    "op2_token_store": token_store.query,
    "op3_line_templates": line_templates.query,
    "op4_quality": quality.query,
    "op5_vector_search": vector_search.query,
    "op6_decontamination": decontamination.query,
    "op7_near_duplicates": near_duplicates.query,
    "op8_personal_data": personal_data.query,
    "op9_pieces": pieces.query,
    "op10_language": language.query,
}

ORACLES: dict[str, str] = {"op3_line_templates": line_templates.ORACLE, "op5_vector_search": vector_search.ORACLE}
