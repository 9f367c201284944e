"""The training-data pipeline: documents to packed sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from footfall.llm import stages
from footfall.llm.common import table, written

STAGES = [
    ("toxicity", stages.without_toxic),
    ("line dedup", stages.without_repeated_lines),
    ("near dedup", stages.without_near_duplicates),
    ("decontamination", stages.without_benchmark),
    ("packing", stages.in_sequences),
]

# A fitted classifier, groups of near duplicates and retrieval have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to the documents of ``sf_dir``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
