"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), its predecessor's output as ``docs``,
and returns a DataFrame; ``run`` writes each to the shared folder and reads it
back. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumgrid.llm import common, decontamination, language, line_templates, near_duplicates, pieces

STAGES = [
    ("language", language.stage),
    ("line_dedup", line_templates.stage),
    ("near_duplicates", near_duplicates.stage),
    ("decontamination", decontamination.stage),
    ("pieces", pieces.stage),
]

#: The stages learn from the corpus and search for piece boundaries, which SQL
#: cannot say; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            common.remove(spark, before)  # the stage that read it is written
        before = path
    return docs
