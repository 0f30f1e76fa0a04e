"""SimHash fingerprints, and links between near ones by pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from booktext_spark.llm.common import cut, space_words, utf8
from booktext_spark.llm.graph import components

BITS = 64
#: Reference fingerprints; distances to all of them are tabled for each print that is compared.
PIVOTS = 16
#: Blocks of a fingerprint. At most 2 differing bits leave 2 of 4 blocks as they are.
BLOCK_PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]
#: Prints that a task compares as one group; a bucket of more is dealt out by pivot distance.
GROUP = 2048
#: Pairs, and prints, that are looked at together.
PAIRS, MEMBERS = 1 << 21, 1 << 17


def fingerprint(data: bytes | None, words: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of all shingles; 0 for a text without words."""
    import xxhash

    found = space_words(data)
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    digest = xxhash.xxh64_intdigest
    ends = list(accumulate(map(len, found), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-words])]
    ones, n = np.zeros(BITS, np.int64), len(starts)
    for i in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[i : i + (1 << 16)], ends[i + words - 1 : i + words - 1 + (1 << 16)])], "<u8")  # noqa: B905
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """docs without its text, with the fingerprint as a long (the bits of the unsigned number).

    A column of that name is replaced; null and empty texts have the fingerprint 0; an empty table gives no rows.
    """
    docs = docs.drop(out_col).withColumn(out_col, F.lit(0).cast("bigint"))
    kept = [c for c in docs.columns if c != text_col]
    docs = docs.select(*kept, text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            prints = np.array([fingerprint(t) for t in utf8(batch.column(batch.num_columns - 1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(prints, pa.int64())], names=kept)

    return docs.mapInArrow(run, docs.select(*kept).schema)


def pivot(k: int) -> int:
    """Reference fingerprint k, a fixed pseudo-random number of 64 bits."""
    import xxhash

    return xxhash.xxh64_intdigest(k.to_bytes(8, "little"), 42)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_pairs(prints: np.ndarray, group: np.ndarray, bits: int = 2) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of prints of one group that differ in `bits` bits or fewer; prints are unsigned, groups ascend.

    The prints of a group go by their distance to the first pivot, so that partners lie within `bits` of it. Pairs
    whose distances to any other pivot differ by more are discarded, one coordinate after another, and the rest verified.
    """
    table = [np.bitwise_count(prints ^ np.uint64(pivot(k))).astype(np.int16) for k in range(PIVOTS)]
    key = group.astype(np.int64) * 256 + table[0]
    order = np.argsort(key, kind="stable")
    key = key[order]
    partners = np.searchsorted(key, key + bits, "right") - np.arange(len(key)) - 1
    partners = np.minimum(partners, np.searchsorted(group, group[order], "right") - np.arange(len(key)) - 1)
    ends = np.cumsum(partners)
    at = 0
    while at < len(key):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = partners[at:upto]
        i = np.repeat(np.arange(at, upto), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        i, j = order[i], order[j]
        for distance in table[1:]:
            close = np.abs(distance[i] - distance[j]) <= bits
            i, j = i[close], j[close]
        near = np.bitwise_count(prints[i] ^ prints[j]) <= bits
        yield i[near], j[near]
        at = upto


def _stars(prints: np.ndarray, group: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) that join the prints as their near pairs do: each print with the first one that it reaches here."""
    names, node = np.unique(prints, return_inverse=True)
    root = np.arange(len(names))
    for i, j in near_pairs(prints, group, bits):
        a, b = node[i], node[j]
        while len(a):
            least = np.minimum(root[a], root[b])
            if (root[a] == least).all() and (root[b] == least).all():
                break
            for side in (a, b):
                np.minimum.at(root, root[side], least)
            while (root[root] != root).any():
                root = root[root]
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[root[moved]], names[moved]


def near_links(prints: DataFrame, bits: int = 2, group: int | None = None) -> DataFrame:
    """Links (u, v) between prints(print) that join exactly those that `bits` differing bits or fewer connect.

    prints has distinct fingerprints as longs. The links have the same connected components as all pairs within the
    distance, at most 2. Prints meet in buckets of two equal 16-bit blocks; within a bucket, near_pairs
    finds the pairs by pivot distances, and a task gives the components of what it finds, not the pairs. A bucket of more
    than `group` prints is dealt out into cells by its distance to the first pivot, a crowded cell by hash, and every two
    cells whose distances differ by `bits` or less meet in a group of their own. So no group grows with the
    data, and all pairs of a bucket that pivots leave are compared whatever its size. An empty table gives no rows.
    """
    if bits != 2:
        raise ValueError("the buckets are made for 2 differing bits")
    group = group or GROUP
    block = lambda k: F.shiftrightunsigned("print", 16 * k).bitwiseAND(F.lit(0xFFFF))
    keys = F.array(*[(F.lit(t).cast("bigint") * F.lit(1 << 32)) + F.shiftleft(block(a), 16) + block(b) for t, (a, b) in enumerate(BLOCK_PAIRS)])
    placed = prints.select("print", F.explode(keys).alias("bucket"))
    placed = cut(placed.join(placed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "bucket"))
    whole = placed.where(F.col("size") <= group).select(F.struct("bucket", F.lit("").alias("cells")).alias("group"), "print")

    far = F.bit_count(F.col("print").bitwiseXOR(F.lit(_signed(pivot(0))))).alias("far")
    crowded = placed.where(F.col("size") > group).select("bucket", "print", far)
    counted = crowded.groupBy("bucket", "far").agg(F.ceil(F.count("*") / group).cast("int").alias("parts"))
    cells = counted.groupBy("bucket").agg(F.collect_list(F.struct("far", "parts")).alias("cells"))  # at most 65 of a bucket
    own = F.filter("cells", lambda c: c["far"] == F.col("far"))[0]["parts"]
    mine = F.struct("far", F.pmod(F.xxhash64("print"), own).cast("int").alias("part"))
    around = F.filter("cells", lambda c: F.abs(c["far"] - F.col("far")) <= bits)
    others = F.flatten(F.transform(around, lambda c: F.transform(F.sequence(F.lit(0), c["parts"] - 1), lambda p: F.struct(c["far"].alias("far"), p.alias("part")))))
    met = crowded.join(cells, "bucket").select("bucket", "print", mine.alias("mine"), F.explode(others).alias("other"))
    split = met.select(F.struct("bucket", F.to_json(F.array_sort(F.array("mine", "other"))).alias("cells")).alias("group"), "print")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(0)
            size = np.diff(column.offsets.to_numpy())
            ends = np.cumsum(size)
            at = 0
            while at < len(size):
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MEMBERS, "right")))
                values = column.slice(at, upto - at).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                u, v = _stars(values, np.repeat(np.arange(upto - at), size[at:upto]), bits)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])
                at = upto

    groups = whole.unionByName(split).groupBy("group").agg(F.collect_list("print").alias("prints"))  # at most twice `group`, or so
    return groups.select("prints").mapInArrow(run, "u bigint, v bigint").distinct()


def _classes(prints: DataFrame, first: Column) -> DataFrame:
    """print, root, first: the component of each fingerprint and the least `first` of its rows; a root names a component."""
    distinct = cut(prints.groupBy("print").agg(first.alias("first")))
    found = components(near_links(distinct)).select(F.col("node").alias("print"), "root")
    return distinct.join(found, "print", "left").select("print", F.coalesce("root", "print").alias("root"), "first")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id (smallest doc_id reachable) for each row.

    A text's words are its runs without ASCII white space, A-Z lower-cased; its shingles are all runs of 3
    words. Texts without words, null or empty, have fingerprint 0 and link like any other. Repeated rows and equal
    texts share a fingerprint; rows that repeat a doc_id with other texts are judged each. A null doc_id links like any other but
    names no component, unless none of its rows has an id. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = cut(with_fingerprints(rows, "text", "print"))
    classes = cut(_classes(prints, F.min("doc_id")))
    named = classes.join(classes.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("print", "component_id")
    return prints.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that of the smallest id, of several texts of this id the one of least hash.

    Of rows that repeat id and text one stays. Rows of null id stay all and take no part. An empty table gives no rows.
    """
    named = docs.where(F.col(id_col).isNotNull())
    text = F.col(text_col).cast("string")
    rows = named.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    classes = _classes(cut(with_fingerprints(rows, "text", "print")), F.min(F.struct("id", "hash")))
    kept = classes.groupBy("root").agg(F.min("first").alias("one")).select(F.col("one.id").alias("__id"), F.col("one.hash").alias("__hash"))
    hashed = named.withColumn("__text", F.xxhash64(text))
    first = hashed.join(kept, (F.col(id_col) == F.col("__id")) & (F.col("__text") == F.col("__hash")), "left_semi")
    return first.dropDuplicates([id_col, "__text"]).drop("__text").unionByName(docs.where(F.col(id_col).isNull()))
