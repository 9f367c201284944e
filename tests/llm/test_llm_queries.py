"""The registered queries against their SQL, and the pipeline as a whole."""

import re
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from footfall.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"create view {table.stem} as select * from '{table}'")
    return connection


def text_of(column, value):
    """A whole number with gaps beside it comes as a float from one engine."""
    if pd.isna(value):
        return ""
    return str(value)[:10] if "fetched" in column else str(int(value) if column == "parent_conv_id" else value)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(text_of, frame.columns, row)) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", SQL)
def test_same_rows(spark, database, name):
    ours, theirs = QUERIES[name](spark, FOLDER).toPandas(), database.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) and rows_of(ours) == rows_of(theirs)


def test_one_query_for_each_operator():
    assert {int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES} == set(range(1, 14))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in {*SQL, "op12_html_text"}])
def test_a_row_for_each_document(spark, name):
    found = QUERIES[name](spark, FOLDER)
    ids = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").distinct()
    assert found.select("doc_id").distinct().exceptAll(ids).count() == ids.exceptAll(found.select("doc_id").distinct()).count() == 0


def test_native_plans_hold_no_python(spark):
    for name in ("op1_secrets", "op2_decontamination", "op3_url_filters", "op5_quality_rules", "op10_line_dedup"):
        text = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept, sizes = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, FOLDER)
        assert kept.columns == docs.columns
        sizes.append(kept.count())
    assert docs.count() >= sizes[0] >= sizes[1] > sizes[2] >= sizes[3] > 0.4 * docs.count()
    packed = corpus_pipeline.run(spark, FOLDER)
    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    texts = {r.doc_id: r.text for r in kept.collect()}
    pieces = packed.orderBy("doc_id", "start").collect()
    assert {p.doc_id for p in pieces} == set(texts)
    ids = {}
    for p in pieces:
        ids.setdefault(p.doc_id, []).extend(np.frombuffer(bytes(p.ids), "<u4").tolist())
    assert all(ids[d] == [*library.encode(t, add_special_tokens=False).ids, 2] for d, t in texts.items())
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


@pytest.mark.parametrize("some", [True, False], ids=["odd", "empty"])
def test_stages_take_odd_rows(spark, some):
    rows = [(1, None, None, "a", None), (2, "", "en", None, 0), (None, "words without an id", "en", "b", 3), (4, "one", "en", "b", 3),
            (4, "one", "en", "b", 3), (5, "long " * 30_000, None, "b", 150_000), (6, "it is vile\nit is so\nand more", "en", "c", None)]
    docs = spark.createDataFrame(rows if some else [], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(7) for c in ("score", "predicted", "n_lines", "n_removed", "n", "key", "row", "spans", "label")})
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, FOLDER)
        assert kept.columns == docs.columns and kept.where("score <> 7 or n_lines <> 7 or row <> 7").count() == 0
    # A repeated id is one document; nothing else goes.
    assert kept.count() == (7 if some else 0)
    assert corpus_pipeline.STAGES[-1][1](spark, kept, FOLDER).agg(F.sum("length")).first()[0] or not some
