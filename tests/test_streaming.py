"""Batch forms, and the same as streams over files."""

import time

import pytest
from pyspark.sql import functions as F

from booktext_spark.operators import search
from booktext_spark.streaming import feeds

SNAP = "job string, at timestamp, state string, progress int"
ROWS = [("a", 1, "queued", 0), ("a", 2, "queued", 0), ("a", 3, "translating", 1), ("a", 4, "completed", 9), ("a", 5, "queued", 0), ("b", 1, "failed", 0), ("b", 2, "failed", 0)]


@pytest.fixture
def keyed_state(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def run(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_job_feed(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, "job string, n int, state string, progress int").select("job", F.timestamp_seconds("n").alias("at"), "state", "progress")
    batch = feeds.job_changes(rows, "job", ["at"], "state")
    want = [("a", "completed"), ("a", "queued"), ("a", "translating"), ("b", "failed")]
    assert sorted((r.job, r.state) for r in batch.collect()) == want
    for k in (3, 7):  # two files: the state reaches over batches
        rows.limit(7).where(f"minute(at) = 0 and second(at) {'<=' if k == 3 else '>'} 2").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    got = run(spark, feeds.job_change_feed(stream, "job", "at", "state"), "feed", tmp_path)
    assert sorted((r.job, r.state) for r in got) == want


CHUNKS = [("u", 0, "k0", "aa", 1, 2), ("u", 0, "k0", "AA", 2, 2), ("u", 0, "k1", "aa", 3, 2), ("u", 1, "k0", "bb", 4, 2), ("u", 1, "k1", "bb", 5, 2), ("u", 2, "k2", "cc", 6, 2)]
OUTCOMES = ["accepted", "duplicate", "CONFLICT", "CONFLICT", "accepted", "VALIDATION_ERROR"]


def test_chunks(spark, tmp_path, keyed_state):
    df = spark.createDataFrame(CHUNKS, "upload_id string, index int, idempotency_key string, sha256 string, arrival int, n_chunks int")
    ups = spark.createDataFrame([("u", 10, 5)], "upload_id string, expected_size long, chunk_size long")
    got = feeds.check_chunks(df.drop("n_chunks"), ups).orderBy("arrival").collect()
    assert [r.outcome for r in got] == OUTCOMES
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert [r.outcome for r in run(spark, feeds.ingest_chunks(stream), "chunks", tmp_path)] == OUTCOMES


CHUNK = "upload_id string, index int, idempotency_key string, sha256 string, n_chunks int, arrival int"


def test_chunks_are_known_after_a_restart_and_forgotten_in_time(spark, tmp_path, keyed_state):
    def sent(*rows):
        spark.createDataFrame(rows, CHUNK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def ingested(ttl):
        stream = spark.readStream.schema(CHUNK).parquet(str(tmp_path / "in"))
        out = str(tmp_path / f"out{ttl}")
        query = feeds.ingest_chunks(stream, ttl).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"ck{ttl}")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted((r.index_no, r.outcome) for r in spark.read.parquet(out).collect())

    sent(("u", 0, "a", "X", 3, 1), ("u", 1, None, "y", 3, 2))
    assert ingested(None) == ingested(1000) == [(0, "accepted"), (1, "accepted")]
    time.sleep(2)
    sent(("u", 0, "a", "x", 3, 3), ("u", 2, "a", "z", 3, 4), ("u", 1, None, "y", 3, 5), ("w", 0, "a", "x", 1, 6))
    before = [(0, "accepted"), (1, "accepted")]
    assert ingested(None) == sorted([*before, (0, "duplicate"), (2, "CONFLICT"), (1, "duplicate"), (0, "accepted")])
    # forgotten: index 0 is free again, and so is its key until then
    assert ingested(1000) == sorted([*before, (0, "accepted"), (2, "CONFLICT"), (1, "accepted"), (0, "accepted")])


def test_incremental_dedup(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", "zh-CN"), ("a ", "b", "zh-cn"), ("c", "d", "zh-CN")], "source_text string, target_text string, target_locale string")
    assert feeds.incremental_dedup(df).count() == 2
    write = feeds.append_new_pairs(str(tmp_path / "pairs"))
    for _ in range(2):
        write(df, 0)
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 2
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert len(run(spark, feeds.incremental_dedup(stream), "dedup", tmp_path)) == 2


def test_resumable(spark):
    sections = spark.createDataFrame([("p", "s1"), ("p", "s2"), ("q", "s1")], "project_id string, section_id string")
    done = spark.createDataFrame([("p", ["s1"])], "project_id string, completed_section_ids array<string>")
    assert sorted(tuple(r) for r in feeds.resumable_sections(sections, done).collect()) == [("p", "s2"), ("q", "s1")]


def test_append_new_pairs_keeps_the_search_index(spark, tmp_path):
    kinds = "pair_id int, library_id string, target_locale string, source_text string, target_text string, priority int, external_allowed boolean"
    first = spark.createDataFrame([(1, "l", "zh-CN", "川沿いの道", "a", 1, True), (2, "l", "zh-CN", "川沿いの道", "a", 1, True), (3, "l", "zh-CN", "古い橋", "b", 1, True)], kinds)
    more = spark.createDataFrame([(4, "l", "zh-CN", "古い橋", "b", 1, True), (5, "l", "zh-CN", "橋の上の道", "c", 1, True)], kinds)
    write = feeds.append_new_pairs(f"{tmp_path}/pairs", f"{tmp_path}/index", order_by=["pair_id"])
    for batch in (first, first, more, more):
        write(batch, 0)
    stored, index = spark.read.parquet(f"{tmp_path}/pairs"), spark.read.parquet(f"{tmp_path}/index")
    assert sorted(r.pair_id for r in stored.collect()) == sorted(r.pair_id for r in index.collect()) == [1, 3, 5]
    asked = spark.createDataFrame([("q", "zh-CN", "橋の道")], "query_id string, target_locale string, text string")
    by_index, made = (search.search_references(asked, stored, index=i).orderBy("position").collect() for i in (index, None))
    assert by_index == made and [r.pair_id for r in made] == [5, 1]


def test_first_pair_of_a_hash_is_that_of_least_order(spark):
    rows = [(k, "s", "t", "x", f"row {k}") for k in (5, 3, 9)]
    df = spark.createDataFrame(rows, "k int, source_text string, target_text string, target_locale string, more string")
    assert [(r.k, r.more) for r in feeds.incremental_dedup(df, order_by=["k"]).collect()] == [(3, "row 3")]
    assert feeds.incremental_dedup(df.limit(0), order_by=["k"]).count() == 0


def test_many_chunks_of_one_upload_take_a_step_each(spark):
    """A hundred thousand chunks, each sent twice, and one with another hash."""
    n = 100_000
    sent = spark.range(n).select(F.lit("u").alias("upload_id"), F.col("id").alias("index"), F.concat(F.lit("k"), "id").alias("idempotency_key"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"), F.col("id").alias("arrival"))
    again = sent.withColumn("arrival", F.col("arrival") + n)
    other = sent.where("index = 7").withColumns({"sha256": F.lit("x"), "arrival": F.lit(3 * n).cast("bigint")})
    uploads = spark.createDataFrame([("u", n * 10, 10)], "upload_id string, expected_size bigint, chunk_size bigint")
    got = {r.outcome: r["count"] for r in feeds.check_chunks(sent.unionByName(again).unionByName(other), uploads).groupBy("outcome").count().collect()}
    assert got == {"accepted": n, "duplicate": n, "CONFLICT": 1}


def test_chunks_without_index_key_or_upload(spark):
    rows = [("u", None, "a", "x", 1), ("u", 0, None, "x", 2), ("u", 1, None, "x", 3), ("w", 0, "a", "x", 4), ("u", 9, "b", "x", 5), (None, 0, "c", "x", 6)]
    got = feeds.check_chunks(spark.createDataFrame(rows, "upload_id string, index int, idempotency_key string, sha256 string, arrival int"), spark.createDataFrame([("u", 50, 10)], "upload_id string, expected_size int, chunk_size int"))
    assert {r.arrival: r.outcome for r in got.collect()} == {1: "VALIDATION_ERROR", 2: "accepted", 3: "accepted", 4: "VALIDATION_ERROR", 5: "VALIDATION_ERROR", 6: "VALIDATION_ERROR"}


def test_a_batch_reads_the_buckets_of_its_own_pairs_only(spark, tmp_path):
    kinds = "k int, source_text string, target_text string, target_locale string"
    pairs = lambda low, high: spark.createDataFrame([(k, f"source {k}", f"target {k}", "zh-CN") for k in range(low, high)], kinds)
    path = f"{tmp_path}/pairs"
    write = feeds.append_new_pairs(path, order_by=["k"])
    write(pairs(0, 400), 0)
    one = feeds.incremental_dedup(pairs(7, 8), order_by=["k"]).withColumn("bucket", F.conv(F.substring("pair_hash", 1, 2), 16, 10).cast("int"))
    read = feeds.stored_rows(spark, path, one, "pair_hash")
    assert 0 < read.count() < 30
    assert {f.split("bucket=")[1].split("/")[0] for f in read.inputFiles()} >= {str(one.first().bucket)}
    assert "PartitionFilters: [" in (plan := read._jdf.queryExecution().executedPlan().toString()) and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    for batch in (pairs(7, 8), pairs(390, 410), pairs(0, 410)):
        write(batch, 1)
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == list(range(410))


def test_chunks_of_many_uploads_are_walked_in_batches(spark):
    """An upload goes on in the next Arrow batch, and no upload is a group of its own, which takes Python a call each."""
    import random

    rng = random.Random(5)
    rows = [(rng.randrange(12), rng.choice([None, *range(5)]), rng.choice([None, *"abc"]), rng.choice("xXy"), k) for k in range(400)]
    sizes = {u: 1 + u % 5 for u in range(10)}
    want = {}
    for upload in range(12):
        by_index, by_key = {}, {}
        for _, index, key, digest, k in (r for r in rows if r[0] == upload):
            want[k] = feeds.judged(index, key, digest.lower(), sizes.get(upload), by_index.get(index), by_key.get(key))
            if want[k] == "accepted":
                by_index[index] = (index, key, digest.lower())
                if key is not None:
                    by_key[key] = by_index[index]
    chunks = spark.createDataFrame(rows, "upload_id int, index int, idempotency_key string, sha256 string, arrival int").repartition(3)
    judged = feeds.check_chunks(chunks, spark.createDataFrame([(u, 8 * n - 3, 8) for u, n in sizes.items()], "upload_id bigint, expected_size int, chunk_size int"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = judged.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.arrival: r.outcome for r in got} == want and len(got) == 400
    assert judged.columns == ["upload_id", "index", "idempotency_key", "sha256", "arrival", "outcome"]
    assert "FlatMapGroups" not in judged._jdf.queryExecution().executedPlan().toString()
