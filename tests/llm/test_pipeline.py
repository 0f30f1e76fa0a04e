"""The corpus pipeline, stage by stage, on planted documents."""

import random

import corpus_pipeline
from pyspark.sql import functions as F


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(n))


def write(spark, folder, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_stages_on_planted_rows(spark, tmp_path):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        docs.append((i, words(rng, 60) + (" scum moron " if bad else " ") + words(rng, 10), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    item = words(rng, 20)
    passage = words(rng, 80)
    clean = words(rng, 200)
    docs += [(1000, clean, "en", "s", 0), (1001, clean, "en", "s", 0), (1002, f"{words(rng, 20)} {item} {words(rng, 20)}", "en", "s", 0), (1003, f"{words(rng, 50)} {passage}", "en", "s", 0), (1004, f"{passage} {words(rng, 50)}", "en", "s", 0), (1005, None, "en", "s", 0)]
    sf = write(
        spark, tmp_path,
        documents=spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        labels=spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), benchmark=spark.createDataFrame([(1, item)], "item_id bigint, text string"),
    )
    at = spark.read.parquet(f"{sf}/documents.parquet")
    columns = at.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, sf).write.parquet(f"{sf}/{name}")
        at = spark.read.parquet(f"{sf}/{name}")
        steps[name] = at
        if name != "packing":
            assert at.columns == columns
    ids = lambda name: {r.doc_id for r in steps[name].select("doc_id").collect()}
    assert ids("toxicity") & set(range(300)) == {i for i in range(300) if i % 5}
    assert ids("toxicity") - ids("simhash_near_dedup") == {1001}
    text = lambda name, i: steps[name].where(F.col("doc_id") == i).first().text
    assert passage[10:-10] not in text("suffix_dedup", 1003) and passage[10:-10] not in text("suffix_dedup", 1004)
    assert item in text("suffix_dedup", 1002) and item not in text("decontamination", 1002)
    assert text("decontamination", 1000) == clean
    assert ids("decontamination") == ids("packing") == ids("simhash_near_dedup")


def test_run_returns_the_last_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "sequence_id", "offset", "ids_crc32"} <= set(out.columns)
    assert out.where(F.crc32("ids") != F.col("ids_crc32")).count() == 0


def test_stages_on_odd_and_empty_rows(spark, tmp_path):
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string"
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, None), (None, "no id here", "en", "s", 10, "x"), (3, "a b c", "en", "s", 5, "x"), (3, "a b c", "en", "s", 5, "x"), (4, "long " * 9000, "en", "s", 45000, "x")]
    sf = write(
        spark, tmp_path,
        documents=spark.createDataFrame(rows, kinds), labels=spark.createDataFrame([(3, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int"),
        benchmark=spark.createDataFrame([(None, "a b c"), (1, None)], "item_id bigint, text string"),
    )
    at = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for empty in (True, False):
            out = stage(spark, at.limit(0) if empty else at, sf)
            path = f"{sf}/{k}-{empty}"
            out.write.parquet(path)
            got = spark.read.schema(out.schema).parquet(path)
            if name != "packing":
                assert got.columns == at.columns
            assert got.count() == 0 if empty else got.count() > 0
        at = got
    assert {r.doc_id for r in at.collect()} == {1, 3, 4, None}
