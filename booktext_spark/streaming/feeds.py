"""Change feeds, chunk ingest and growing libraries: batch forms, and streams with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from booktext_spark.functions.ids import pair_hash
from booktext_spark.operators.reports import TERMINAL
from booktext_spark.operators.search import index_rows
from booktext_spark.storage import kept


def job_changes(snapshots: DataFrame, key: str, order: Sequence[str], state: str, terminal: Sequence[str] = TERMINAL) -> DataFrame:
    """Batch form: the snapshots that differ from the one before, up to the first terminal state of each job."""
    job = Window.partitionBy(key).orderBy(*order)
    body = F.struct(*[c for c in snapshots.columns if c not in (key, *order)])
    before = F.lag(F.struct(body.alias("b"))).over(job)
    ended = F.coalesce(F.max(F.col(state).isin(*terminal)).over(job.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    marked = snapshots.withColumns({"__new": before.isNull() | ~before["b"].eqNullSafe(body), "__ended": ended})
    return marked.where("__new and not __ended").drop("__new", "__ended")


def job_change_feed(snapshots: DataFrame, key: str, order: str, state: str, terminal: Sequence[str] = TERMINAL, watermark: str | None = None) -> DataFrame:
    """Stream form: emits a snapshot only when it differs from the last emitted one, and nothing after a terminal state.

    The state of a job is a digest of its last snapshot; after the end only a mark stays, and with a watermark on `order`
    it is removed once the watermark passes the job's last event.
    """
    columns = snapshots.columns
    rows = snapshots if watermark is None else snapshots.withWatermark(order, watermark)
    ends = set(terminal)
    timeout = GroupStateTimeout.NoTimeout if watermark is None else GroupStateTimeout.EventTimeTimeout

    def run(_, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        last, done = kept.get if kept.exists else ("", False)
        page = pd.concat(list(batches)).sort_values(order, kind="stable")
        out = []
        for row in page.itertuples(index=False):
            if done:
                break
            digest = repr([getattr(row, c) for c in columns if c != order])
            if digest != last:
                out.append(row)
                last = digest
            done = getattr(row, state) in ends
        kept.update((last, done))
        if watermark is not None:
            latest = int(page[order].max().timestamp() * 1000)
            kept.setTimeoutTimestamp(max(latest, kept.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=page.columns)[columns] if out else page.head(0)[columns]

    return rows.groupBy(key).applyInPandasWithState(run, rows.schema, "last string, done boolean", "append", timeout)


def judged(index: int | None, key, digest: str | None, n_chunks: int | None, held_index: tuple | None, held_key: tuple | None) -> str:
    """accepted, duplicate, CONFLICT or VALIDATION_ERROR, for a chunk and what an upload has accepted under its index and under its key."""
    if index is None or n_chunks is None or not 0 <= index < n_chunks:
        return "VALIDATION_ERROR"
    near = [c for c in (held_index, held_key) if c is not None]
    if not near:
        return "accepted"
    return "duplicate" if all(c == (index, key, digest) for c in near) else "CONFLICT"


def check_chunks(chunks: DataFrame, uploads: DataFrame) -> DataFrame:
    """Batch form: chunks with outcome: accepted, duplicate, CONFLICT or VALIDATION_ERROR, judged in order of arrival.

    The first chunk with a usable index and key is accepted; one that is equal in index, key and hash to the first holder of
    both is a duplicate. chunks: upload_id, index, idempotency_key, sha256, arrival. uploads has a row for each upload_id; of more, the least
    size holds. Both are dealt out together by upload and sorted, and a task walks its uploads one behind the other, a step for each chunk.
    """
    columns = ["upload_id", "index", "idempotency_key", "sha256", "arrival"]
    rows = chunks.withColumn("sha256", F.lower("sha256")).select(*columns)
    kinds = {c: rows.schema[c].dataType for c in columns}
    size = F.ceil(F.col("expected_size") / F.col("chunk_size")).cast("bigint")
    sizes = uploads.select(F.col("upload_id").try_cast(kinds["upload_id"]).alias("upload_id"), size.alias("n_chunks"), F.lit(False).alias("chunk")).where("upload_id is not null")
    both = rows.withColumn("chunk", F.lit(True)).unionByName(sizes, allowMissingColumns=True)
    placed = both.repartition("upload_id").sortWithinPartitions("upload_id", "chunk", *[F.col(c).asc_nulls_last() for c in ("n_chunks", "arrival", "index", "idempotency_key", "sha256")])

    def run(batches):
        import pyarrow as pa

        now, n_chunks, by_index, by_key = None, None, {}, {}
        for batch in batches:
            outcomes = []
            for upload, chunk, size, index, key, digest in zip(*(batch.column(c).to_pylist() for c in ("upload_id", "chunk", "n_chunks", "index", "idempotency_key", "sha256")), strict=True):
                if upload != now:
                    now, n_chunks, by_index, by_key = upload, None, {}, {}
                if not chunk:
                    n_chunks = size if n_chunks is None else n_chunks
                    continue
                outcomes.append(judged(index, key, digest, n_chunks, by_index.get(index), by_key.get(key)))
                if outcomes[-1] == "accepted":
                    by_index[index] = (index, key, digest)
                    if key is not None:
                        by_key[key] = (index, key, digest)
            page = batch.filter(batch.column("chunk"))
            yield pa.RecordBatch.from_arrays([*(page.column(c) for c in columns), pa.array(outcomes, pa.string())], names=[*columns, "outcome"])

    return placed.mapInArrow(run, ", ".join(f"`{c}` {kind.simpleString()}" for c, kind in kinds.items()) + ", outcome string")


class _Ingest(StatefulProcessor):
    """Two maps for each upload, by index and by key, of which a chunk reads and writes its own entries only."""

    def __init__(self, index: str, key: str, ttl: int | None):
        self.kinds, self.ttl = (index, key), ttl

    def init(self, handle) -> None:
        index, key = (f"{name} {kind}" for name, kind in zip(("index_no", "idempotency_key"), self.kinds, strict=True))
        self.by_index = handle.getMapState("by_index", index, f"{key}, sha256 string", self.ttl)
        self.by_key = handle.getMapState("by_key", key, f"{index}, sha256 string", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        page = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        outcomes = []
        for r in page.itertuples(index=False):
            index, name, digest = int(r.index_no), r.idempotency_key, r.sha256.lower()
            there, under = self.by_index.getValue((index,)), None if name is None else self.by_key.getValue((name,))
            outcomes.append(judged(index, name, digest, r.n_chunks, there and (index, *there), under and (under[0], name, under[1])))
            if outcomes[-1] == "accepted":
                self.by_index.updateValue((index,), (name, digest))
                if name is not None:
                    self.by_key.updateValue((name,), (index, digest))
        yield page.assign(outcome=outcomes)[["upload_id", "index_no", "idempotency_key", "sha256", "outcome"]]

    def close(self) -> None:
        pass


def ingest_chunks(chunks: DataFrame, ttl: int | None = None) -> DataFrame:
    """Stream form over chunks that carry n_chunks: the same outcomes.

    The state of an upload is keyed: a batch reads and writes the entries of its own chunks, however many the upload has. ttl: milliseconds after
    which an accepted chunk is forgotten. Keyed state needs spark.sql.streaming.stateStore.providerClass to be the RocksDB provider.
    """
    rows = chunks.withColumnRenamed("index", "index_no")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("upload_id", "index_no", "idempotency_key", "sha256")}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", outcome string"
    processor = _Ingest(kinds["index_no"], kinds["idempotency_key"], ttl)
    return rows.groupBy("upload_id").transformWithStateInPandas(processor, schema, "Append", "None" if ttl is None else "ProcessingTime")


def incremental_dedup(pairs: DataFrame, watermark: tuple[str, str] | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """The first pair of each hash. Batch form: the first by order_by, any where there is none. Stream form: the first to arrive, with a
    watermark (column, delay) of those within it only. An empty table gives no rows."""
    hashed = pairs.withColumn("pair_hash", pair_hash(F.col("source_text"), F.col("target_text"), F.col("target_locale")))
    if watermark is not None:
        return hashed.withWatermark(*watermark).dropDuplicatesWithinWatermark(["pair_hash"])
    if pairs.isStreaming or not order_by:
        return hashed.dropDuplicates(["pair_hash"])
    first = hashed.groupBy("pair_hash").agg(F.min_by(F.struct(*pairs.columns), F.struct(*order_by)).alias("row"))
    return first.select("row.*", "pair_hash")


#: Folders of a store of pairs.
BUCKETS = 256


def stored_rows(spark, path: str, touched: DataFrame, key: str) -> DataFrame | None:
    """key of what is stored at the path in the buckets of touched(bucket), of which there are at most BUCKETS; None before anything is stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    buckets = [r.bucket for r in touched.select("bucket").distinct().collect()]
    return spark.read.parquet(path).where(F.col("bucket").isin(buckets)).select("bucket", key)


def append_new_pairs(path: str, index_path: str | None = None, order_by: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends the pairs of a batch whose hash is not stored yet; a repeated batch adds nothing.

    The store has a folder for each of BUCKETS ranges of the hash, and a batch reads the hashes of those folders only that its own pairs fall into, so
    that the work of a small batch does not grow with the store. With index_path, the search tokens of what is new are appended there in the
    same folders, as `ranked` takes them for its index, so that no search has to make those of all pairs; what is in the index already is not added
    again. Pairs then have the columns of search_references. Both stores have the column `bucket` besides.
    """
    bucket = F.conv(F.substring("pair_hash", 1, 2), 16, 10).cast("int") % BUCKETS

    def append(rows: DataFrame, to: str) -> None:
        rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(to)

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        first = kept(incremental_dedup(batch, order_by=order_by).withColumn("bucket", bucket))
        old = stored_rows(spark, path, first, "pair_hash")
        append(kept(first if old is None else first.join(old, ["bucket", "pair_hash"], "left_anti")), path)
        if index_path is not None:
            touched = [r.bucket for r in first.select("bucket").distinct().collect()]
            mine = spark.read.parquet(path).where(F.col("bucket").isin(touched)).join(first.select("bucket", "pair_hash"), ["bucket", "pair_hash"], "left_semi")  # a batch that broke off before its index too
            old = stored_rows(spark, index_path, first, "pair_id")
            new = mine if old is None else mine.join(old, ["bucket", "pair_id"], "left_anti")
            append(index_rows(new).join(new.select("pair_id", "bucket"), "pair_id"), index_path)

    return write


def resumable_sections(sections: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Sections of each project's job that its checkpoint does not list as completed. checkpoint: project_id, completed_section_ids."""
    done = checkpoint.select("project_id", F.explode("completed_section_ids").alias("section_id")).distinct()
    return sections.join(done, ["project_id", "section_id"], "left_anti")
