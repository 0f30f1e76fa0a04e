"""Every registered query of the library on tables without rows, and on tables with nulls in every column."""

import pytest

from booktext_spark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries whose result has a row whatever the tables hold.
ALWAYS = {"read_books"}


@pytest.fixture(scope="module")
def empty(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_rows(spark, empty, name):
    rows = registry.QUERIES[name](spark, empty).collect()
    assert rows == [] or name in ALWAYS


@pytest.fixture(scope="module")
def holes(spark, sf_dir, tmp_path_factory):
    """Each row of the smallest tables, and for each column but keys one row more with a null there."""
    from pyspark.sql import functions as F

    folder = tmp_path_factory.mktemp("holes")
    for t in TABLES:
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(20)
        out = df
        for c in df.columns[1:]:
            out = out.unionByName(df.limit(1).withColumn(c, F.lit(None).cast(df.schema[c].dataType)))
        out.write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_nulls_in_any_column(spark, holes, name):
    registry.QUERIES[name](spark, holes).collect()
