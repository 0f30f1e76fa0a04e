"""What the training-data operators share: columns, words, the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from booktext_spark.storage import shared_dir

#: Lower-cases A-Z and turns every ASCII byte that is not a letter or digit into a space.
WORD_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def alnum_words(data: bytes | None) -> list[bytes]:
    """Words of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased; None has none."""
    return data.translate(WORD_BYTES).split() if data else []


def space_words(data: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; None has none."""
    return data.lower().split() if data else []


def small_batches(spark: SparkSession) -> None:
    """Lets Spark hand texts to Python by the thousand: a batch of ten thousand can be most of a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the queries, whose texts then go to Python by the thousand, see small_batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that `stored` has written in this session, in order.
STORED: list[str] = []


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders that nothing reads any more, in whatever store they are."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, so that lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, what: str) -> DataFrame:
    """Like cut, as compressed columns: for tables that grow with the text."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    STORED.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(column) -> list[bytes | None]:
    """An Arrow string column as UTF-8 bytes."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def slices(batches, rows: int = 1000):
    """Arrow batches in parts of at most so many rows, so that what is made of a part at once is small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
