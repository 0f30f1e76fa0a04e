"""Removal of repeated byte strings: prefix doubling over sampled positions.

A name of a position at length L stands for the L bytes that start there. Names double inside the task
that holds the text (1, 2, 4, ... 64 bytes, no shuffle, as equal bytes give equal hashes). Spark then sorts and
regroups positions by name, first at 64 bytes and then by pairs of names at a growing offset up to the threshold,
and after each round drops the positions whose name is unique.

In the first round only one position of each window takes part: the smallest name of the 64-byte strings
in a window of `length` bytes (winnowing), so equal windows send equal names. That cuts the rows by a factor
of about 70, which whole suffix sorting needs to stay within the disk, and loses no repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from booktext_spark.llm.common import slices, stored, utf8

GRAM = 64
#: Positions of a text that are named at a time.
PIECE = 1 << 19
PLACE = np.uint64((1 << 20) - 1)
#: Bytes of spans that may be broadcast; beyond that they are joined by a shuffle.
BROADCAST_BYTES = 24 << 20
SHAPE = 1 << 16
#: Type of what stands for a row.
KEY = "struct<a:bigint,b:bigint>"
#: Windows of a cell: runs that differ are compared cell by cell before single windows are.
CELL = 16

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_S = np.uint64(29)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _M1
    x += b
    x ^= x >> _S
    x *= _M2
    x ^= x >> _S
    return x


_BYTE_NAMES = _mix(np.arange(1, 257, dtype=np.uint64) * _M3, np.arange(256, dtype=np.uint64))


class Names:
    """Names of all positions of a byte string, at any length up to `longest`."""

    def __init__(self, data: bytes, longest: int):
        self.levels = {1: _BYTE_NAMES[np.frombuffer(data, np.uint8)]}
        n = 1
        while 2 * n <= longest:
            h = self.levels[n]
            self.levels[2 * n] = _mix(h[:-n], h[n:]) if len(h) > n else h[:0]
            n *= 2

    def at(self, length: int) -> np.ndarray:
        if length not in self.levels:
            base = 1 << (length.bit_length() - 1)
            h, rest = self.levels[base], length - base
            self.levels[length] = _mix(h[: len(h) - rest] ^ _M3, h[rest:]) if len(h) > rest else h[:0]
        return self.levels[length]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` values."""
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def segments(data: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, shape, name, kind) of the runs of windows that share their sampled position.

    first is a window start; shape holds how far behind it the sampled position (times 65536) and the last window
    are; name is the 64-byte name sampled; kind names all bytes of the run's windows, with the shape.
    """
    for base in range(0, len(data) - length + 1, PIECE):
        names = Names(data[base : base + PIECE + length - 1], length)
        grams = names.at(GRAM)
        keys = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
        at = (_least(keys, length - GRAM + 1) & PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        place = at[first]
        whole = names.at(length)
        shape = (place - first) * SHAPE + (last - first)
        kind = _mix(_mix(whole[first], whole[last]), shape.astype(np.uint64))
        yield first + base, shape, grams[place], kind


def _key(id_col: str, text: str | Column) -> Column:
    """128 bits that stand for a row: its id and text."""
    return F.struct(F.xxhash64(id_col, text).alias("a"), F.xxhash64(F.lit(1), id_col, text).alias("b"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("row", _key("id", "text"))


def repeated_spans(rows: DataFrame, length: int = 200) -> DataFrame:
    """row, spans (array of start, stop in bytes, sorted, apart): the bytes of strings that start elsewhere too."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} or more")
    texts = rows.select("row", "text")

    def scan(only_names: bool):
        def run(batches):
            import pyarrow as pa

            for batch in slices(batches):
                out: list[list[np.ndarray]] = []
                for k, data in enumerate(utf8(batch.column(1))):
                    for first, shape, name, kind in segments(data, length) if len(data) >= length else ():
                        out.append([name] if only_names else [np.full(len(first), k), first, shape, name, kind])
                if out:
                    cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                    if only_names:
                        yield pa.RecordBatch.from_arrays([pa.array(cols[0].view(np.int64))], names=["name"])
                    else:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0])), pa.array(cols[1].astype(np.int32)), pa.array(cols[2].astype(np.int32)), pa.array(cols[3].view(np.int64)), pa.array(cols[4].view(np.int64))], names=["row", "first", "shape", "name", "kind"])

        return run

    # 64 bytes: positions of unique names go
    # (what is counted is counted in each task before it is dealt out, and stored, so that the joins after it may split hot names)
    named = stored(texts.mapInArrow(scan(True), "name bigint").groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"), "repeat-names")
    left = texts.mapInArrow(scan(False), f"row {KEY}, first int, shape int, name bigint, kind bigint").join(named, "name")
    left = stored(left, "repeat-segments")

    # all bytes of a run: runs that occur twice are repeats; where runs of a name differ, their cells are compared
    kinds = stored(left.groupBy("name", "kind").agg(F.count("*").alias("n"), F.min(F.struct("row", "first", "shape")).alias("one")), "repeat-kinds")
    whole = left.join(kinds.where("n > 1").select("name", "kind"), ["name", "kind"]).select("row", "first", (F.col("first") + F.col("shape") % SHAPE).alias("last"))
    mixed = stored(kinds.groupBy("name").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("name"), "repeat-mixed")
    runs = kinds.join(mixed, "name").select("one.*", (F.col("n") == 1).alias("single")).groupBy("row").agg(F.collect_list(F.struct("first", "shape", "single")).alias("runs"))

    # bytes that all windows of a cell share: cells of a unique core go, cells that occur twice are repeats
    cells = stored(_attach(texts, runs, "runs", "inner").mapInArrow(_cells(length), f"row {KEY}, first int, last int, low bigint, high bigint, hull bigint, single boolean"), "repeat-cells")
    hulls = stored(cells.groupBy("low", "high", "hull").agg(F.count("*").alias("n"), F.min(F.struct("row", "first", "last", "single")).alias("one")), "repeat-hulls")
    parts = cells.where("single").join(hulls.where("n > 1").select("low", "high", "hull"), ["low", "high", "hull"]).select("row", "first", "last")
    mixed = stored(hulls.groupBy("low", "high").agg(F.count("*").alias("hulls"), F.bool_or((F.col("n") == 1) & F.col("one.single")).alias("open")).where("hulls > 1 and open").select("low", "high"), "repeat-mixed")
    runs = hulls.join(mixed, ["low", "high"]).select("one.row", "one.first", "one.last", ((F.col("n") == 1) & F.col("one.single")).alias("single")).groupBy("row").agg(F.collect_list(F.struct("first", "last", "single")).alias("runs"))

    # the threshold: single windows by pairs of names at the offset; unique pairs go
    paired = stored(_attach(texts, runs, "runs", "inner").mapInArrow(_pairs(length), f"row {KEY}, at int, low bigint, high bigint, single boolean"), "repeat-windows")
    twice = stored(paired.groupBy("low", "high").agg(F.count("*").alias("n")).where("n > 1").select("low", "high"), "repeat-pairs")
    ones = paired.where("single").join(twice, ["low", "high"]).select("row", F.col("at").alias("first"), F.col("at").alias("last"))

    covered = whole.unionByName(parts).unionByName(ones).groupBy("row").agg(F.collect_list(F.struct(F.col("first").alias("start"), (F.col("last") + length).alias("stop"))).alias("spans"))

    def merge(batches):
        import pyarrow as pa

        for batch in slices(batches):
            merged = []
            for spans in batch.column(1).to_pylist():
                one: list[dict] = []
                for s in sorted(spans, key=lambda s: (s["start"], s["stop"])):
                    if one and s["start"] <= one[-1]["stop"]:
                        one[-1]["stop"] = max(one[-1]["stop"], s["stop"])
                    else:
                        one.append(s)
                merged.append(one)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(merged, batch.column(1).type)], schema=batch.schema)

    return covered.mapInArrow(merge, covered.schema)


def _cells(length: int):
    """Cells of runs: windows whose distance to the sampled position is the same, up to CELL.

    low and high name the core, the bytes that all windows of a whole cell share; hull names all bytes of the windows that the run has there.
    """
    core = length - CELL + 1
    half = core // 2

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            out = []
            for k, (data, runs) in enumerate(zip(utf8(batch.column("text")), batch.column("runs").to_pylist(), strict=True)):
                for base, some in _near(runs):
                    names = Names(data[base : base + PIECE + 2 * length], length)
                    halves, whole = names.at(half), names.at(length)
                    first, shape, single = (np.array([r[c] for r in some]) for c in ("first", "shape", "single"))
                    first, last, place = first - base, first - base + shape % SHAPE, first - base + shape // SHAPE
                    for c in range(int(((place - first) // CELL).max()) + 1):
                        low, high = np.maximum(first, place - CELL * c - CELL + 1), np.minimum(last, place - CELL * c)
                        some_here = np.flatnonzero(low <= high)
                        a, b, at = low[some_here], high[some_here], (place - CELL * c)[some_here]
                        hull = _mix(_mix(whole[a], whole[b]), ((at - a) * SHAPE + (b - a)).astype(np.uint64))
                        out.append([np.full(len(a), k), (a + base).astype(np.int32), (b + base).astype(np.int32), halves[at].view(np.int64), halves[at + core - half].view(np.int64), hull.view(np.int64), single[some_here]])
            if out:
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(cols[0])), *(pa.array(c) for c in cols[1:])], names=["row", "first", "last", "low", "high", "hull", "single"])

    return run


def _near(runs: list[dict]) -> Iterator[tuple[int, list[dict]]]:
    """The runs by the piece of the text that holds their first window, with its place."""
    pieces: dict[int, list[dict]] = {}
    for r in runs:
        pieces.setdefault(r["first"] // PIECE * PIECE, []).append(r)
    return iter(sorted(pieces.items()))


def _pairs(length: int):
    """Single windows of runs, with the names of their halves."""
    half = length // 2

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            out = []
            for k, (data, runs) in enumerate(zip(utf8(batch.column("text")), batch.column("runs").to_pylist(), strict=True)):
                for base, some in _near(runs):
                    h = Names(data[base : base + PIECE + 2 * length], half).at(half)
                    at = np.concatenate([np.arange(r["first"], r["last"] + 1) for r in some]) - base
                    single = np.repeat([r["single"] for r in some], [r["last"] - r["first"] + 1 for r in some])
                    out.append([np.full(len(at), k), (at + base).astype(np.int32), h[at].view(np.int64), h[at + length - half].view(np.int64), single])
            if out:
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(cols[0])), *(pa.array(c) for c in cols[1:])], names=["row", "at", "low", "high", "single"])

    return run


def _attach(rows: DataFrame, lists: DataFrame, column: str, how: str) -> DataFrame:
    """rows joined with lists(row, array) by row: lists of a checked size are broadcast, so the texts stay where they are."""
    lists = stored(lists, f"repeat-{column}")
    n, items = lists.agg(F.count("*"), F.sum(F.size(column))).first()
    small = 64 * n + 24 * (items or 0) <= BROADCAST_BYTES
    return rows.join(F.broadcast(lists) if small else lists, "row", how)


def cut_spans(data: bytes, spans: list[dict] | None) -> bytes:
    parts, at = [], 0
    for s in spans or ():
        parts.append(data[at : s["start"]])
        at = s["stop"]
    return b"".join([*parts, data[at:]])


def find_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (removed runs of bytes) and kept (the remaining bytes) for each row.

    Texts are UTF-8 bytes; null is empty. A byte is removed if a string of `length` bytes over it starts anywhere
    else in the table, its own text included; matches stay inside a text. Texts shorter than `length` keep all.
    Repeated rows are repeats of each other; null ids stay null; an empty table gives no rows.
    """
    rows = _rows(docs, id_col, text_col)
    joined = _attach(rows, repeated_spans(rows, length), "spans", "left").select(F.col("id").alias("doc_id"), "text", "spans")

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            data, spans = utf8(batch.column(1)), batch.column(2).to_pylist()
            kept = [cut_spans(d, s) for d, s in zip(data, spans, strict=True)]
            arrays = [batch.column(0), pa.array(map(len, data), pa.int64()), pa.array([s or [] for s in spans], batch.column(2).type), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "spans", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, spans array<struct<start:int,stop:int>>, kept binary")


def sha256_of_kept(found: DataFrame) -> DataFrame:
    """The digest columns of find_repeats: a row for each of its rows; a row without bytes has the digest of none."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated strings taken out of the texts; parts of characters that a cut leaves go too, null stays null."""
    key = _key(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    spans = repeated_spans(_rows(docs, id_col, text_col), length).withColumnsRenamed({"row": "__row", "spans": "__spans"})
    lists = stored(spans, "repeat-texts")
    n, items = lists.agg(F.count("*"), F.sum(F.size("__spans"))).first()
    small = 64 * n + 24 * (items or 0) <= BROADCAST_BYTES
    joined = docs.withColumn("__key", key).join(F.broadcast(lists) if small else lists, F.col("__key") == F.col("__row"), "left").select(*[docs[c] for c in docs.columns], "__spans")
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if spans:
                    texts[i] = cut_spans(texts[i].encode(), spans).decode(errors="ignore")
            arrays = list(batch.columns[:-1])
            arrays[at] = pa.array(texts, arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(list(batch.schema)[:-1]))

    return joined.mapInArrow(run, docs.schema)
