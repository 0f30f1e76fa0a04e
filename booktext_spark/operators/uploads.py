"""Upload checks, chunk manifests, assembled hashes and policy scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Allowed media types of each extension, by purpose.
BOOK_TYPES = {"epub": ("application/epub+zip", "application/octet-stream"), "txt": ("text/plain", "application/octet-stream"), "pdf": ("application/pdf", "application/octet-stream")}
COVER_TYPES = {"jpg": ("image/jpeg",), "jpeg": ("image/jpeg",), "png": ("image/png",), "webp": ("image/webp",)}
#: First bytes of cover images, in hex.
COVER_MAGIC = {"image/jpeg": "^FFD8FF", "image/png": "^89504E470D0A1A0A", "image/webp": "^52494646.{8}57454250"}
MAX_BYTES = 256 << 20


def validate_upload_rows(uploads: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """uploads with error_code: null, VALIDATION_ERROR or INVALID_COVER.

    uploads has purpose, filename, media_type, expected_size and expected_sha256, and may have the first bytes as head.
    """
    extension = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))

    def listed(types: dict[str, tuple[str, ...]]):
        fits = F.lit(False)
        for ext, kinds in types.items():
            fits = fits | ((extension == ext) & F.col("media_type").isin(*kinds))
        return fits

    unsafe = F.col("filename").rlike(r"[/\\\x00-\x1f]") | F.col("filename").isin(".", "..") | (F.length(F.coalesce("filename", F.lit(""))) == 0)
    size = F.col("expected_size")
    wrong = unsafe | size.isNull() | (size < 1) | (size > max_bytes) | ~F.coalesce(F.col("expected_sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
    cover = F.col("purpose") == "cover"
    code = F.when(F.coalesce(wrong, F.lit(True)), "VALIDATION_ERROR").when(cover & ~F.coalesce(listed(COVER_TYPES), F.lit(False)), "INVALID_COVER").when(~cover & ~F.coalesce(listed(BOOK_TYPES), F.lit(False)), "VALIDATION_ERROR")
    if "head" in uploads.columns:
        magic = F.lit(False)
        for kind, pattern in COVER_MAGIC.items():
            magic = magic | ((F.col("media_type") == kind) & F.hex(F.substring("head", 1, 16)).rlike(pattern))
        code = F.coalesce(code, F.when(cover & F.col("head").isNotNull() & ~magic, "INVALID_COVER"))
    return uploads.withColumn("error_code", code)


def chunk_manifest_check(uploads: DataFrame, chunks: DataFrame) -> DataFrame:
    """upload_id, n_chunks, total_bytes, status: complete, missing, size_mismatch or hash_mismatch.

    Chunks are numbered from 0; each has min(chunk_size, what is left) bytes. computed_sha256, where chunks have it, must equal sha256.
    """
    joined = uploads.select("upload_id", "expected_size", "chunk_size").join(chunks, "upload_id", "left")
    at = F.col("index")
    want = F.least(F.col("chunk_size"), F.col("expected_size") - at * F.col("chunk_size"))
    hashes = F.col("sha256") != F.col("computed_sha256") if "computed_sha256" in chunks.columns else F.lit(False)
    per = joined.groupBy("upload_id").agg(
        F.first("expected_size").alias("expected_size"), F.first("chunk_size").alias("chunk_size"), F.count("index").alias("n_chunks"), F.countDistinct("index").alias("n_distinct"),
        F.min("index").alias("low"), F.max("index").alias("high"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.bool_or(F.col("size") != want), F.lit(False)).alias("odd"), F.coalesce(F.bool_or(hashes), F.lit(False)).alias("torn"),
    )
    needed = F.ceil(F.col("expected_size") / F.col("chunk_size"))
    whole = (F.col("n_distinct") == needed) & (F.col("n_chunks") == needed) & (F.coalesce("low", F.lit(0)) == 0) & (F.coalesce("high", F.lit(-1)) == needed - 1)
    status = F.when(~whole, "missing").when(F.col("odd") | (F.col("total_bytes") != F.col("expected_size")), "size_mismatch").when(F.col("torn"), "hash_mismatch").otherwise("complete")
    return per.select("upload_id", "n_chunks", "total_bytes", status.alias("status"))


def assembled_file_hash(uploads: DataFrame, chunks: DataFrame) -> DataFrame:
    """upload_id, sha256, n_bytes, status (ok or HASH_MISMATCH) of the chunks in index order.

    A task folds the chunks of an upload into one running hash, batch by batch, so a file is never held whole: rows
    are dealt out by a hash of the upload and sorted by upload and index. An upload without chunks has no row.
    """

    def run(batches):
        import hashlib

        import pyarrow as pa

        now, digest, size = None, None, 0
        done: list[tuple] = []
        for batch in batches:
            for upload, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if digest is None or upload != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest(), size))
                    now, digest, size = upload, hashlib.sha256(), 0
                piece = data.as_py() or b""
                digest.update(piece)
                size += len(piece)
        if digest is not None:
            done.append((now, digest.hexdigest(), size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["upload_id", "sha256", "n_bytes"])

    placed = chunks.select(F.col("upload_id").cast("string").alias("upload_id"), "content", "index").repartition("upload_id").sortWithinPartitions("upload_id", "index")
    hashes = placed.select("upload_id", "content").mapInArrow(run, "upload_id string, sha256 string, n_bytes bigint")
    wanted = uploads.select(F.col("upload_id").cast("string").alias("upload_id"), "expected_sha256", "expected_size")
    ok = (F.col("sha256") == F.lower("expected_sha256")) & (F.col("n_bytes") == F.col("expected_size"))
    return wanted.join(hashes, "upload_id", "left").select("upload_id", "sha256", "n_bytes", F.when(ok, "ok").otherwise("HASH_MISMATCH").alias("status"))


def policy_scan(df: DataFrame, rules: Sequence[tuple[str, str]], text_col: str = "text", path_col: str | None = None, suffixes: Sequence[str] = (), parts: Sequence[str] = (), max_bytes: int = 2_000_000) -> DataFrame:
    """Rows of df with a rule column: one row for each rule that a row breaks.

    rules are (name, regular expression) over the text, skipped where it has more than max_bytes or is null; suffixes and parts judge the path.
    """
    text = F.when(F.octet_length(text_col) <= max_bytes, F.col(text_col))
    broken = [F.when(text.rlike(pattern), F.lit(name)) for name, pattern in rules]
    if path_col:
        broken += [F.when(F.lower(path_col).endswith(s), F.lit(f"suffix:{s}")) for s in suffixes]
        broken += [F.when(F.array_contains(F.split(path_col, "/"), p), F.lit(f"part:{p}")) for p in parts]
    return df.withColumn("rule", F.explode(F.array_compact(F.array(*broken))))
