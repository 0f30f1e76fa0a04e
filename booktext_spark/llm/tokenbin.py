"""Fixed-width bit-packed token files with block offsets."""

from __future__ import annotations

import struct
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from booktext_spark.llm.common import cut, shared_dir

MAGIC = b"TOKBIN01"
#: magic, bits of an id, ids of a block, number of ids, number of documents
HEADER = struct.Struct("<8sIIQQ")
BLOCK = 1 << 15


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """ids as `bits` bits each, least significant bit first, padded to whole bytes."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    spread = ((ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(spread, bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


class Writer:
    """Appends documents; blocks go to the sink as they fill, the index and the footer at the end.

    Layout: header placeholder fields live in the footer, so a file is written in one pass:
    blocks | block offsets (u64 each) | doc ids (i64) | null flags (u8) | doc ends (u64) | HEADER | u64 offset of the index.
    """

    def __init__(self, sink, bits: int, block: int = BLOCK):
        self.sink, self.bits, self.block = sink, bits, block
        self.at = self.n = 0
        self.offsets: list[int] = []
        self.doc_ids: list[int | None] = []
        self.ends: list[int] = []
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.n += len(ids)
        self.ends.append(self.n)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 8 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        whole = len(flat) if last else len(flat) // self.block * self.block
        for i in range(0, whole, self.block):
            data = pack_bits(flat[i : min(i + self.block, whole)], self.bits)
            self.offsets.append(self.at)
            self.sink.write(data)
            self.at += len(data)
        self.waiting, self.held = [flat[whole:]], len(flat) - whole

    def close(self) -> None:
        self._flush(True)
        self.sink.write(np.array([*self.offsets, self.at], "<u8").tobytes())
        self.sink.write(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes())
        self.sink.write(np.array([d is None for d in self.doc_ids], np.uint8).tobytes())
        self.sink.write(np.array(self.ends, "<u8").tobytes())
        self.sink.write(HEADER.pack(MAGIC, self.bits, self.block, self.n, len(self.doc_ids)) + struct.pack("<Q", self.at))


class Reader:
    """Random access to a token file: any document's ids, by reading only its blocks."""

    def __init__(self, source, size: int):
        self.source = source
        foot = HEADER.size + 8
        source.seek(size - foot)
        tail = source.read(foot)
        magic, self.bits, self.block, self.n, docs = HEADER.unpack(tail[: HEADER.size])
        if magic != MAGIC:
            raise ValueError("not a token file")
        (index,) = struct.unpack("<Q", tail[HEADER.size :])
        blocks = -(-self.n // self.block)
        source.seek(index)
        data = source.read(8 * (blocks + 1) + 17 * docs)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1)
        data = data[8 * (blocks + 1) :]
        self.doc_ids = [None if null else int(d) for d, null in zip(np.frombuffer(data, "<i8", docs), data[8 * docs : 9 * docs], strict=True)]
        self.ends = np.frombuffer(data[9 * docs :], "<u8", docs).astype(np.int64)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first (included) to last (excluded) of the file."""
        if first >= last:
            return np.zeros(0, "<u4")
        low, high = first // self.block, (last - 1) // self.block
        self.source.seek(int(self.offsets[low]))
        data = self.source.read(int(self.offsets[high + 1] - self.offsets[low]))
        parts, at = [], 0
        for b in range(low, high + 1):
            n = min(self.block, self.n - b * self.block)
            size = int(self.offsets[b + 1] - self.offsets[b])
            parts.append(unpack_bits(data[at : at + size], self.bits, n))
            at += size
        return np.concatenate(parts)[first - low * self.block : last - low * self.block]

    def documents(self, block_docs: int = 512):
        """(doc_id, ids before it in this file, ids) in order, reading runs of documents at a time."""
        starts = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        for i in range(0, len(self.ends), block_docs):
            base = int(starts[i])
            flat = self.ids(base, int(self.ends[min(i + block_docs, len(self.ends)) - 1]))
            for k in range(i, min(i + block_docs, len(self.ends))):
                yield self.doc_ids[k], int(starts[k]), flat[starts[k] - base : self.ends[k] - base]


def _store(folder: str):
    """(file system, path) of a folder, for any scheme that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _files(rows: DataFrame, file_bytes: int) -> int:
    """Files for rows(text): one for each `file_bytes` of UTF-8, a few for each core at least."""
    found = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    return max(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-found // file_bytes))


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, end_id: int | None = 1, files: int | None = None, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = 128 << 20, memory: int = 160 << 20, specials: bool = True) -> DataFrame:
    """Encodes every text and writes the ids, in ascending doc_id order, into `files` files.

    Where `files` is None, there is a task for each `file_bytes` of text, so that files keep their size as the corpus grows; a task begins a
    new file where the next text would pass `file_bytes` characters, as ranges of ids can hold very different amounts. The order is that of a range partition by doc_id (nulls first, ties by text). Ids take the fewest
    bits that hold the vocabulary. A task writes under a name of its own and renames at its end, so a
    repeated task replaces equal bytes. memory: bytes that a worker's memory of encoded words takes. specials: whether the string
    of a special token inside a text has that token's id, as in the library's plain call (else it is ordinary text). Returns the
    manifest, one row for each file: file_no, path, n_docs, n_ids. A null or empty text has its end id alone; an
    empty table gives files without documents or no file.
    """
    spark = docs.sparkSession
    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")
    n = files or _files(rows, file_bytes)

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        from booktext_spark.llm.tokens import encoder

        enc = encoder(vocabulary, memory, specials)
        bits = max(1, (enc.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        end = [] if end_id is None else [end_id]
        tail = np.array(end, "<u4").tobytes()
        part = TaskContext.get().partitionId()
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        documents = ((doc, text.as_py() or "") for batch in batches for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        waiting, k = next(documents, None), 0
        while waiting or not k:
            path, held = f"{base}/{part:06d}-{k:04d}.tokbin", 0
            trial = f"{base}/_{part:06d}-{uuid.uuid4().hex}"
            with store.open_output_stream(trial) as sink:
                writer = Writer(sink, bits)
                while waiting and (not held or held + len(waiting[1]) <= file_bytes):
                    doc, text = waiting
                    held += len(text)
                    writer.add(doc, np.frombuffer(enc.encode(text) + tail, "<u4"))
                    waiting = next(documents, None)
                writer.close()
            if store.get_file_info(path).type != fs.FileType.NotFound:  # of a lost try of this task; not every store moves onto a file
                store.delete_file(path)
            store.move(trial, path)
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([(part << 32) + k], pa.int64()), "path": [path], "n_docs": pa.array([len(writer.ends)], pa.int64()), "n_ids": pa.array([writer.n], pa.int64())})
            k += 1

    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, "file_no bigint, path string, n_docs bigint, n_ids bigint")


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """One row for each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids.

    The manifest has one row for each file, however large the corpus, so its prefix sum is made on the
    driver. ids are little-endian unsigned 32-bit.
    """
    rows = sorted(manifest.collect(), key=lambda r: r.file_no)
    starts, at = [], 0
    for r in rows:
        starts.append((r.file_no, r.path, at))
        at += r.n_ids

    def run(batches):
        import pyarrow as pa

        store, _ = _store(folder)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for path, first in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                size = store.get_file_info(path).size
                with store.open_input_file(path) as source:
                    out = []
                    for doc, start, ids in Reader(source, size).documents():
                        out.append((doc, first + start, len(ids), ids.astype("<u4").tobytes()))
                        if len(out) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                            out = []
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    files = spark.createDataFrame(starts, "file_no bigint, path string, first bigint")
    files = files.repartition(max(1, len(starts))) if starts else files
    return files.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int | None = 1) -> DataFrame:
    """Writes the token files into the shared folder and reads them back."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = cut(write_token_files(docs, vocabulary, folder, end_id))
    return read_token_files(spark, manifest, folder)


def with_crc(read: DataFrame) -> DataFrame:
    """read with the checksum of the ids in their place; no ids have the checksum 0, and an empty table stays empty."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
