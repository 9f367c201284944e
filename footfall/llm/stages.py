"""Stages of the training-data pipeline: each takes the documents that the one before kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import toxicity
from footfall.llm.common import table
from footfall.llm.decontamination import decontaminate
from footfall.llm.line_dedup import remove_repeated_runs
from footfall.llm.near_duplicates import near_duplicates
from footfall.llm.packing import pack
from footfall.llm.queries import tokenizer


def _aside(docs: DataFrame) -> DataFrame:
    """Ids and texts with all other columns in ``row``, so that none clashes with an operator's."""
    return docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c != "text")).alias("row"))


def _back(docs: DataFrame, **new: Column) -> list[Column]:
    """The columns of ``docs`` again, from rows that were put aside."""
    from_row = {c: F.col(f"row.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("text")} | new
    return [from_row[c].alias(c) for c in docs.columns]


def without_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    model = toxicity.learn(docs, table(spark, folder, "labels"))
    return toxicity.score_toxicity(_aside(docs), model).where("predicted = 0").select(*_back(docs))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without runs of lines that occur earlier; those left without a word go.

    ``n_chars`` follows the text.
    """
    left = remove_repeated_runs(_aside(docs)).where(
        (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" not in docs.columns:
        return left.select(*_back(docs))
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return left.select(*_back(docs, n_chars=chars))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8): the least id.

    Rows without an id are in no group and stay.
    """
    gone = near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate(docs, table(spark, folder, "benchmark")).select(*docs.columns)


def in_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 ids."""
    return pack(docs, tokenizer("word_bpe_49k.json"))
