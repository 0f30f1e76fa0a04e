"""Every registered training-data query, and the pipeline, on tables without rows and on tables with nulls."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from booktext_spark.llm import queries

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES = queries.QUERIES | {"pipeline": corpus_pipeline.run}


@pytest.fixture(scope="module")
def empty(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def holes(spark, sf_dir, tmp_path_factory):
    """Some rows of the smallest tables twice, with a null in each column in turn, and a column that no query knows."""
    folder = tmp_path_factory.mktemp("holes")
    for t in TABLES:
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(20)
        out = df.unionByName(df)
        for c in df.columns:
            out = out.unionByName(df.limit(1).withColumn(c, F.lit(None).cast(df.schema[c].dataType)))
        out.withColumn("spans", F.lit("clash")).withColumn("score", F.lit(1)).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_rows(spark, empty, name):
    rows = QUERIES[name](spark, empty).collect()
    assert len(rows) == (name == "op9_chat_format")  # which has a conversation of its own


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nulls_repeats_and_clashing_names(spark, holes, name):
    rows = QUERIES[name](spark, holes).collect()
    documents = 20 * 2 + 5
    if name.split("_")[0] in ("op1", "op2", "op4", "op5", "op7", "op8"):
        assert len(rows) == documents
