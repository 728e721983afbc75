"""A training corpus in five stages: each reads what the one before it kept, written as Parquet.

Stages decide rows, not ids: null and repeated ids lose no row. Null and empty texts count as empty; of several the exact
deduplication keeps one, which becomes one piece. Ties go to the longest text, then to the smallest id, nulls last, then
to the first row. Very long texts are read whole. Further columns of the documents stay up to the last stage, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import dedup, jaccard, packing, pii, quality
from loomline.llm.common import new_folder

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("quality_classifier", quality.pipeline_stage),
    ("exact_dedup", dedup.pipeline_stage),
    ("jaccard_join", jaccard.pipeline_stage),
    ("pii_semicrf", pii.pipeline_stage),
    ("best_fit_packing", packing.pipeline_stage),
]

#: The classifier, the model of personal data and the packing can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that every stage keeps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
