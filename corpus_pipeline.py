"""From raw documents to packed sequences: toxicity, near copies, repeated passages, test items, packing."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from booktext_spark.llm import decontam, packing, repeats, simhash, toxicity
from booktext_spark.llm.common import STORED, discard, small_batches, table
from booktext_spark.storage import shared_dir

#: A document of this score or more goes.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learnt from all documents with usable labels, does not call toxic."""
    lexicon = toxicity.learn_lexicon(table(spark, sf_dir, "documents").select("doc_id", "text"), toxicity.training_labels(table(spark, sf_dir, "labels")))
    scored = toxicity.score_toxicity(docs, lexicon, score_col="__toxicity")
    return scored.where(F.col("__toxicity") < TOXIC).drop("__toxicity")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of linked fingerprints."""
    small_batches(spark)
    return simhash.drop_near_copies(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that occur twice; n_chars follows the text."""
    small_batches(spark)
    return recounted(repeats.remove_repeats(docs, 200))


def remove_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the hit words of test items, where these are a twentieth of the words or more."""
    return recounted(decontam.remove_contamination(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with the checksum of their ids."""
    small_batches(spark)
    pieces = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 0, memory=48 << 20)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


def recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_dedup", remove_repeats),
    ("decontamination", remove_test_items),
    ("packing", pack),
]

#: SQL cannot express these stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again.

    Once a stage is written, what it stored on its way goes, and so does its input, unless that is the table itself.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path, first = f"{base}/{k}-{name}", len(STORED)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        discard(spark, STORED[first:] + ([before] if before else []))
        del STORED[first:]
        before = path
    return docs
