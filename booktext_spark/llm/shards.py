"""Shards cut from a Hilbert curve through quantised metadata, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from booktext_spark.llm.common import stored

#: monotonically_increasing_id has a partition's rows in its lower bits.
ROW_BITS = 33
ROWS_MASK = (1 << ROW_BITS) - 1


def hilbert_table(dims: int) -> list[int]:
    """The curve's automaton: at state * 2^dims + cell of a half-space of each dimension, next state * 2^dims + place of that cell.

    A state is the corner where a cube's curve enters (dims bits) and its main direction; the reflected Gray code orders
    the sub-cubes, and each is entered at a corner and in a direction that follow from its place.
    """
    size = 1 << dims

    def rotated(x: int, by: int) -> int:
        by %= dims
        return (x << by | x >> (dims - by)) & (size - 1)

    def ones(x: int) -> int:  # trailing set bits
        return (x ^ (x + 1)).bit_length() - 1

    gray = [i ^ i >> 1 for i in range(size)]
    place = {g: i for i, g in enumerate(gray)}
    table = []
    for entry in range(size):
        for direction in range(dims):
            for cell in range(size):
                w = place[rotated(cell ^ entry, dims - direction - 1)]
                corner = gray[2 * ((w - 1) // 2)] if w else 0
                turn = 0 if w == 0 else ones(w if w % 2 else w - 1) % dims
                to = (entry ^ rotated(corner, direction + 1)) * dims + (direction + turn + 1) % dims
                table.append(to * size + w)
    return table


def hilbert_index(codes: Sequence[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a cell, given its codes of `bits` bits in each dimension; a bigint."""
    dims = len(codes)
    size, table = 1 << dims, F.array(*[F.lit(x) for x in hilbert_table(dims)])
    numbers = F.array(*[c.cast("int") for c in codes])

    def step(state: Column, level: Column) -> Column:
        cell = F.aggregate(F.sequence(F.lit(dims - 1), F.lit(0), F.lit(-1)), F.lit(0), lambda a, j: a * 2 + F.get(numbers, j).bitwiseAND(F.call_function("shiftleft", F.lit(1), level)).cast("boolean").cast("int"))
        found = F.get(table, state["s"] * size + cell)
        return F.struct(F.call_function("shiftright", found, F.lit(dims)).alias("s"), (state["h"] * size + found.bitwiseAND(F.lit(size - 1))).alias("h"))

    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("bigint").alias("h"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step)["h"]


def _with_before(sums: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """sums (a row for each range) with the sum of each column over the rows before, and over all."""
    before, whole = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    more = {f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in columns} | {f"{c}_total": F.sum(c).over(whole) for c in columns}
    return sums.withColumns(more).drop(*columns)


def depth_cuts(keys: DataFrame, column: str, parts: int) -> list[tuple]:
    """(least value, code) of each code of a column: code = floor(rows of smaller value * parts / rows), null first.

    Values are counted before the shuffle and summed in ranges of values, so that nothing but one row for each range and for each
    code (at most `parts`) meets. Equal values have one code, however many rows they have.
    """
    counted = keys.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    dealt = stored(counted.repartitionByRange(F.asc_nulls_first("v")).withColumn("range", F.spark_partition_id()), "shard-values")
    inside = Window.partitionBy("range").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = _with_before(dealt.groupBy("range").agg(F.sum("n").alias("rows")), "range", ["rows"])
    smaller = dealt.withColumn("here", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(ranges), "range")
    coded = smaller.select("v", F.expr(f"(rows_before + here) * {parts} div rows_total").cast("int").alias("code"))
    found = coded.groupBy("code").agg(F.min(F.struct(F.col("v").isNotNull().alias("there"), "v")).alias("least")).collect()
    return sorted(((r.least.v, r.code) for r in found), key=lambda x: x[1])


def quantised(column: Column, cuts: Sequence[tuple]) -> Column:
    """The code of a value: that of the largest least value (see depth_cuts) not above it; null has 0."""
    out = F.lit(0)
    for value, code in cuts:
        if value is not None:
            out = F.when(column >= F.lit(value), F.lit(code)).otherwise(out) if code else out
    return F.when(column.isNull(), F.lit(0)).otherwise(out)


def _sized(docs: DataFrame, dims: Sequence[str], id_col: str, text_col: str) -> DataFrame:
    """doc_id, size, text_crc32, a column d0, d1 ... for each dimension, and a number of the row; `size` as a dimension is that of the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.octet_length(text).cast("bigint") + 1
    values = [(size if d == "size" else F.col(d)).alias(f"d{i}") for i, d in enumerate(dims)]
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), *values, F.monotonically_increasing_id().alias("row"))


def shard_documents(docs: DataFrame, shards: int = 16, dims: Sequence[str] = ("lang", "source", "size"), bits: int = 5, law: str = "rows", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve of every row of docs.

    Each dimension is quantised to 2^bits codes of equal depth; rows are sorted by their cell's place on the Hilbert curve (then
    doc_id, size, checksum) and the order is cut into runs, so that a shard covers a small box of each dimension. size: UTF-8
    bytes of the text (null: none) plus 1; `size` among the dimensions is this one, other names are columns of docs.

    law `rows`: shard = floor(place * shards / rows), so that counts differ by one at most; law `bytes`: shard by the middle of the
    row's bytes among all, so that sizes differ by two rows at most. slot: place in the shard, from 0. grown_shard is null:
    neither law keeps rows where they are when shards are added. Repeated rows have slots of their own; null ids and null
    dimensions go first; an empty table gives no rows; other columns of docs are not looked at. Only keys are shuffled, by ranges of
    the full order, which tells even repeated rows apart: no source, text or id is in one task. What meets on the driver is one row for each code.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law must be rows or bytes")
    keys = stored(_sized(docs, dims, id_col, text_col), "shard-keys")
    codes = [quantised(F.col(f"d{i}"), depth_cuts(keys, f"d{i}", 1 << bits)) for i in range(len(dims))]
    order = [F.asc_nulls_first(c) for c in ("curve", "doc_id", "size", "text_crc32", "row")]
    placed = keys.withColumn("curve", hilbert_index(codes, bits)).select("doc_id", "size", "text_crc32", "curve", "row")
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("row").withColumn("at", F.monotonically_increasing_id())
    placed = stored(placed, "shard-order").withColumn("part", F.call_function("shiftright", "at", F.lit(ROW_BITS)).cast("int"))
    sums = placed.groupBy("part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    joined = placed.join(F.broadcast(_with_before(sums, "part", ["rows", "bytes"])), "part").withColumn("place", F.col("rows_before") + F.col("at").bitwiseAND(F.lit(ROWS_MASK)))
    if law == "rows":
        cut = joined.withColumn("shard", F.expr(f"place * {shards} div rows_total").cast("int"))
        first = F.expr(f"(shard * rows_total + {shards - 1}) div {shards}")
    else:
        inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        cut = joined.withColumn("bytes", F.col("bytes_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        cut = stored(cut.withColumn("shard", F.expr(f"(2 * bytes + size) * {shards} div (2 * bytes_total)").cast("int")), "shard-cut")
        firsts = cut.groupBy("shard").agg(F.min("place").alias("first"))  # a row for each shard
        cut, first = cut.join(F.broadcast(firsts), "shard"), F.col("first")
    return cut.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("place") - first).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, shards: int = 16, dims: Sequence[str] = ("lang", "source", "size"), bits: int = 5, files_of: int = 1 << 20) -> DataFrame:
    """Writes whole rows of docs under path/shard=0 ..., by cells of the curve, and returns the ranges that let a reader skip shards.

    A shard holds whole cells here (the cells between the first and last of its rows under the law `rows`), so a row's shard follows from its
    metadata alone and no text is joined. A cell of more rows than a shard fills goes to the shard of its first row. Files of a shard have
    `files_of` rows at most. Returns shard, n and least and largest value of each dimension (least_0, most_0, ...).
    """
    spark = docs.sparkSession
    keys = stored(_sized(docs, dims, "doc_id", "text"), "shard-keys")
    cuts = [depth_cuts(keys, f"d{i}", 1 << bits) for i in range(len(dims))]
    curve = lambda values: hilbert_index([quantised(v, c) for v, c in zip(values, cuts, strict=True)], bits)
    cells = depth_cuts(keys.select(curve([F.col(f"d{i}") for i in range(len(dims))]).alias("curve")), "curve", shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    values = [F.octet_length(text).cast("bigint") + 1 if d == "size" else F.col(d) for d in dims]
    sharded = docs.withColumn("__curve", curve(values)).withColumn("shard", quantised(F.col("__curve"), cells))
    ordered = sharded.repartitionByRange("shard", "__curve", "doc_id").sortWithinPartitions("shard", "__curve", "doc_id")
    ordered.drop("__curve").write.option("maxRecordsPerFile", files_of).partitionBy("shard").parquet(path)
    ranges = [f(v).alias(f"{name}_{i}") for i, v in enumerate(values) for name, f in (("least", F.min), ("most", F.max))]
    return spark.read.schema(sharded.drop("__curve").schema).parquet(path).groupBy("shard").agg(F.count("*").alias("n"), *ranges)
