"""Readers and registration shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Register(dict):
    """name -> query; SQL beside it in .sql."""

    def __init__(self) -> None:
        super().__init__()
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def number(of: str, at: str) -> Column:
    """One number for a row `at` of a group `of`, both 0 or more: of * 1000 + at below 1,000, which is what the SQL has.

    From 1,000 on it is negative, so that it meets no row of another group. Groups whose numbers do not fit end in an error.
    """
    far = -(F.col(of).cast("bigint") * F.lit(1 << 31) + F.col(at))
    return F.when(F.col(at) < 1000, F.col(of) * 1000 + F.col(at)).otherwise(far)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of documents as blocks: doc_id, source, lang, ordinal, text."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))


#: The same in SQL.
LINES_SQL = """lines AS (
  SELECT doc_id, source, lang, unnest(range(len(parts))) AS ordinal, unnest(parts) AS text
  FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS parts FROM documents))"""
