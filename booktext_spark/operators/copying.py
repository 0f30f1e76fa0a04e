"""Wording that outputs share with references: n-gram candidates, longest common runs, verdicts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from booktext_spark.functions.automaton import SuffixAutomaton
from booktext_spark.functions.text import lcs_length, normalize_for_copying
from booktext_spark.storage import stored

#: Fixed values: (shorter than, least run, least share of the shorter text, least overlap or none) of the verdict.
LADDER = ((80, 28, 0.58, None), (200, 42, 0.40, 0.55), (None, 64, 0.30, 0.44))

#: Bits of a filter of grams (16 MB), a fixed size; characters of references in an automaton, of outputs that meet one at a time, and rows of a gram in a task.
FILTER_BITS, SHARD_CHARS, PORTION, HEAVY = 1 << 27, 1 << 16, 1 << 22, 20_000
#: Rows of numbers that are broadcast (8 to 24 bytes each); larger tables are shuffled.
SMALL = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def copying_texts(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, text in copying form; texts without letters and numbers go."""
    return df.select(F.col(id_col).alias("id"), normalize_for_copying(F.col(text_col)).alias("text")).where(F.length("text") > 0)


def gram_names(text: str, n: int) -> np.ndarray:
    """64-bit names of all runs of n characters of a text, in order; equal runs have equal names."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < n:
        return np.zeros(0, np.int64)
    names, size = (codes + np.uint64(1)) * _ODD, 1
    while size < n:  # a run is its first and its last part, which may overlap
        step = min(size, n - size)
        first = names[: len(names) - step]
        names = (first ^ (first >> np.uint64(31))) * _ODD + names[step:]
        names ^= names >> np.uint64(29)
        size += step
    return names.view(np.int64)


def gram_rows(texts: DataFrame, n: int, distinct: bool = True, keep=None) -> DataFrame:
    """id, gram and size: the distinct runs of n characters of each text(id, text), by name, and their number; or with `distinct` off
    id, gram and at: all runs with their places. Texts that are null or shorter have no row. keep: gram_filter of other texts,
    none of whose grams has no row; most others have none either, and do not leave the task."""
    kind = texts.schema["id"].dataType.simpleString()
    more = "size int" if distinct else "at int"
    bits = None if keep is None else texts.sparkSession.sparkContext.broadcast(keep)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for low in range(0, batch.num_rows, 100):
                part = batch.slice(low, 100)
                named = [gram_names(t or "", n) for t in part.column(1).to_pylist()]
                if distinct:
                    named = [np.unique(x) for x in named]
                size = np.array([len(x) for x in named], np.int64)
                row, grams = np.repeat(np.arange(len(size)), size), np.concatenate(named)
                last = size[row] if distinct else np.concatenate([np.arange(k) for k in size.tolist()])
                if bits is not None:
                    at = grams & (FILTER_BITS - 1)
                    some = np.flatnonzero(bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                    row, grams, last = row[some], grams[some], last[some]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(grams), pa.array(last.astype(np.int32))], names=["id", "gram", more.split()[0]])

    return texts.select("id", "text").mapInArrow(run, f"id {kind}, gram bigint, {more}")


def gram_sets(texts: DataFrame, n: int, keep=None) -> DataFrame:
    """id, grams: the distinct runs of n characters of each text(id, text), by name, in one array; with `keep` those only that gram_filter lets through. Texts without any have no row."""
    kind = texts.schema["id"].dataType.simpleString()
    bits = None if keep is None else texts.sparkSession.sparkContext.broadcast(keep)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for low in range(0, batch.num_rows, 100):
                part = batch.slice(low, 100)
                named = [gram_names(t or "", n) for t in part.column(1).to_pylist()]
                if bits is not None:
                    named = [x[bits.value[(x & (FILTER_BITS - 1)) >> 3] >> (x & 7).astype(np.uint8) & 1 > 0] for x in named]
                named = [np.unique(x) for x in named]
                ends = np.cumsum([0, *map(len, named)]).astype(np.int32)
                sets = pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(named)))], names=["id", "grams"])
                yield sets.filter(pa.array(np.diff(ends) > 0))

    return texts.select("id", "text").mapInArrow(run, f"id {kind}, grams array<bigint>")


def gram_filter(grams: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits for gram_rows: one for each name of grams(gram), by its lowest bits.

    Bits are set where the grams are, in maps of 4 KB, so that no more than the filter itself is shuffled for a task and collected.
    """
    at = F.col("gram").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    maps = grams.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(FILTER_BITS >> 3, np.uint8)
    for bucket, bits in maps.toLocalIterator():
        out[(bucket - 1) * len(bits) : bucket * len(bits)] = np.frombuffer(bits, np.uint8)
    return out


@F.pandas_udf(StructType([StructField("shared", LongType()), StructField("size", LongType())]))
def shared_grams(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Distinct n-grams that both texts have, and those that the first has."""
    rows = []
    for x, y, k in zip(a, b, n, strict=True):
        ours = np.unique(gram_names(x, k))
        rows.append((np.isin(ours, gram_names(y, k)).sum(), len(ours)))
    return pd.DataFrame(rows, columns=["shared", "size"], dtype="int64")


def copy_candidates(outputs: DataFrame, refs: DataFrame, n: int = 8) -> DataFrame:
    """output_id, ref_id, shared, size: pairs that share an n-gram. No pair without one can be suspicious for n of 28 or less.

    outputs and refs are in copying form. Grams that no reference has leave before they are joined, most of them in the task that finds
    them, and pairs are counted before they are shuffled.
    """
    theirs = stored(gram_rows(refs, n).select(F.col("id").alias("ref_id"), "gram"), "copying-grams")
    ours = gram_rows(outputs, n, keep=gram_filter(theirs)).withColumnRenamed("id", "output_id")
    met = ours.join(theirs, "gram")
    return met.groupBy("output_id", "ref_id").agg(F.count("*").alias("shared"), F.first("size").alias("size"))


def ngram_overlap(candidates: DataFrame) -> DataFrame:
    """candidates with overlap: the shared share of the output's n-grams."""
    return candidates.withColumn("overlap", F.col("shared") / F.greatest("size", F.lit(1)))


def with_texts(candidates: DataFrame, outputs: DataFrame, refs: DataFrame) -> DataFrame:
    return candidates.join(outputs.select(F.col("id").alias("output_id"), F.col("text").alias("output_text")), "output_id").join(
        refs.select(F.col("id").alias("ref_id"), F.col("text").alias("ref_text")), "ref_id"
    )


def longest_common_substring(pairs: DataFrame) -> DataFrame:
    """pairs with lcs: the length of the longest common run of output_text and ref_text."""
    return pairs.withColumn("lcs", lcs_length("output_text", "ref_text"))


def longest_common_run(outputs: DataFrame, refs: DataFrame, n: int = 8) -> DataFrame:
    """output_id, ref_id, lcs: the longest common run of each pair that shares one of n characters or more.

    References lie in shards of about SHARD_CHARS characters. A shard's suffix automaton is built in the task that needs it, and each output that
    shares an n-gram with the shard is read through it once, whatever the number of common places. Outputs of a shard that many meet go in portions of about
    PORTION characters, each with the shard's references. outputs and refs are in copying form; rows of equal ids give one row, of the longest. A task takes
    some 500 bytes for each character of a shard, so one reference should not be a whole book.
    """
    total = refs.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_CHARS))
    theirs = stored(refs.withColumn("shard", F.pmod(F.xxhash64("text", "id"), F.lit(shards)).cast("int")), "copying-shards")
    grams = gram_rows(theirs.select(F.struct("shard", "id").alias("id"), "text"), n).select("gram", "id.shard").distinct()
    grams = stored(grams, "copying-grams")
    ours = outputs.select("id", "text", F.struct("id", F.xxhash64("text").alias("name"), F.length("text").alias("chars")).alias("row")).dropDuplicates(["row"])
    met = gram_rows(ours.select(F.col("row").alias("id"), "text"), n, keep=gram_filter(grams)).join(grams, "gram").select(F.col("id").alias("row"), "shard").distinct()
    met = stored(met, "copying-met")
    crowd = met.groupBy("shard").agg(F.sum("row.chars").alias("chars"))
    parts = crowd.select("shard", F.ceil(F.col("chars") / PORTION).cast("int").alias("parts"))
    placed = met.join(parts, "shard").withColumn("portion", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    texts = placed.join(ours.select("row", "id", "text"), "row").select("shard", "portion", "id", "text")
    sources = theirs.join(parts, "shard").withColumn("portion", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("shard", "portion", "id", "text")
    kinds = [df.schema["id"].dataType.simpleString() for df in (outputs, refs)]

    def run(texts, sources):
        import pyarrow as pa

        known = SuffixAutomaton(sources.column("text").to_pylist())
        at, ref, lcs = [], [], []
        for k, text in enumerate(texts.column("text")):
            for number, size in known.common_runs(text.as_py(), n).items():
                at.append(k)
                ref.append(number)
                lcs.append(size)
        ids = [t.column("id").combine_chunks().take(pa.array(x, pa.int64())) for t, x in ((texts, at), (sources, ref))]
        return pa.table([*ids, pa.array(lcs, pa.int32())], names=["output_id", "ref_id", "lcs"])

    found = texts.groupBy("shard", "portion").cogroup(sources.groupBy("shard", "portion")).applyInArrow(run, f"output_id {kinds[0]}, ref_id {kinds[1]}, lcs int")
    return found.groupBy("output_id", "ref_id").agg(F.max("lcs").alias("lcs"))


def verdict(size: Column, lcs: Column, share: Column, overlap: Column) -> Column:
    out = F.lit(False)
    for shorter, run, least, over in reversed(LADDER):
        bad = (lcs >= run) & (share >= least)
        bad = bad if over is None else bad | (overlap >= over)
        out = bad if shorter is None else F.when(size < shorter, bad).otherwise(out)
    return out


def copying_verdict(pairs: DataFrame) -> DataFrame:
    """output_id, ref_id, lcs, shared, size, lcs_ratio, ngram_overlap_ratio, suspicious of pairs with texts, lcs and overlap."""
    size = F.length("output_text")
    share = F.col("lcs") / F.greatest(F.least(size, F.length("ref_text")), F.lit(1))
    return pairs.select("output_id", "ref_id", "lcs", "shared", "size", F.bround(share, 6).alias("lcs_ratio"), F.bround("overlap", 6).alias("ngram_overlap_ratio"), verdict(size, F.col("lcs"), share, F.col("overlap")).alias("suspicious"))


def characters(texts: DataFrame) -> int:
    return texts.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0


def small(df: DataFrame, what: str) -> DataFrame:
    """The rows, stored, and broadcast where they are few."""
    rows = stored(df, what)
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def overlap_candidates(outputs: DataFrame, refs: DataFrame, n: int, threshold: float, counted: bool = False) -> DataFrame:
    """output_id, ref_id of all pairs of which `threshold` of the output's n-grams or more are the reference's, and of some others.

    A set-similarity join. Grams are ordered by the number of references that have them, rare ones first. An output of which `need` grams must be
    common has one of these among its grams that references have, without the last need - 1 (prefix filter); the reference has
    need grams (length filter); and behind the first common gram both have need - 1 more (position filter). So frequent grams meet
    only where a text has little else. A gram that still has over HEAVY outputs is dealt out in as many parts.

    Where outputs are fewer than references, the grams that no output has do not leave the references' tasks, and a reference counts by the others: what
    is written grows with what both sides share. counted: with shared and size, from the grams; no text is shuffled for them.
    """
    keep = gram_filter(gram_rows(outputs, n)) if characters(outputs) < characters(refs) else None
    sets = stored(gram_sets(refs, n, keep).withColumnRenamed("id", "ref_id"), "copying-grams")
    theirs = sets.select("ref_id", F.explode("grams").alias("gram"), F.size("grams").alias("ref_size"))
    ours = gram_rows(outputs, n, keep=gram_filter(theirs)).withColumnRenamed("id", "output_id")
    common = small(theirs.groupBy("gram").agg(F.count("*").alias("df"), F.max("ref_size").alias("largest")), "copying-common")
    need = F.greatest(F.ceil(F.col("size") * threshold - 1e-9), F.lit(1))
    met = ours.join(common, "gram").where(F.col("largest") >= need).select("output_id", "gram", "df", need.alias("need"), "size")
    met = stored(met, "copying-grams")  # read twice, and a small part of the outputs' grams
    enough = met.groupBy("output_id").agg(F.count("*").alias("held"), F.first("need").alias("need")).where("held >= need")
    place = lambda by: F.row_number().over(Window.partitionBy(by).orderBy("df", "gram"))
    rare = met.select("output_id", "gram", "df").join(enough, "output_id").withColumn("place", place("output_id")).where("place <= held - need + 1").drop("df")
    rare = stored(rare, "copying-prefixes")
    heavy = rare.groupBy("gram").agg(F.ceil(F.count("*") / HEAVY).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    ranked = theirs.join(common, "gram").withColumn("ref_place", place("ref_id")).drop("df", "largest")
    ranked = ranked.join(small(rare.select("gram").distinct(), "copying-rare"), "gram", "left_semi")
    right = ranked.join(heavy, "gram", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    left = rare.join(heavy, "gram", "left").withColumn("part", F.pmod(F.xxhash64("output_id"), parts).cast("int")).drop("parts")
    left_over = F.least(F.col("held") - F.col("place"), F.col("ref_size") - F.col("ref_place"))
    pairs = left.join(right, ["gram", "part"]).where((F.col("ref_size") >= F.col("need")) & (left_over + 1 >= F.col("need"))).select("output_id", "ref_id").distinct()
    if not counted:
        return pairs
    mine = met.join(enough.select("output_id"), "output_id", "left_semi").groupBy("output_id").agg(F.collect_list("gram").alias("ours"), F.first("size").cast("bigint").alias("size"))
    mine = F.broadcast(mine) if met.count() <= SMALL else mine
    return stored(pairs, "copying-pairs").join(sets, "ref_id").join(mine, "output_id").select("output_id", "ref_id", F.size(F.array_intersect("grams", "ours")).cast("bigint").alias("shared"), "size")


def similar_pairs(outputs: DataFrame, refs: DataFrame, n: int = 8, threshold: float = 0.44) -> DataFrame:
    """output_id, ref_id, shared, size, overlap of all pairs of which `threshold` of the output's n-grams or more are the reference's.

    outputs and refs are in copying form, their ids told apart. Texts that are equal meet once: the join is one of different texts, whose pairs are then given to all that
    have them. threshold must be above 0; copy_candidates has the pairs with any common gram.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    named = [stored(df.select("id", "text", F.sha2("text", 256).alias("name"), F.monotonically_increasing_id().alias("row")), "copying-texts") for df in (outputs, refs)]
    members = [stored(df.select("id", "row", "name").join(df.groupBy("name").agg(F.min("row").alias("first")), "name").select("id", "row", "first"), "copying-members") for df in named]
    # texts do not leave their tasks: the copies are left out by their numbers, which are few
    ours, theirs = (df.select(F.col("row").alias("id"), "text").join(small(m.where("row <> first").select(F.col("row").alias("id")), "copying-copies"), "id", "left_anti") for df, m in zip(named, members, strict=True))
    found = ngram_overlap(overlap_candidates(ours, theirs, n, threshold, counted=True)).where(F.col("shared") >= threshold * F.col("size") - 1e-9)
    rows = [m.select(F.col("first").alias(f"{side}_id"), F.col("id").alias(f"{side}_row")) for m, side in zip(members, ("output", "ref"), strict=True)]
    return found.join(rows[0], "output_id").join(rows[1], "ref_id").select(F.col("output_row").alias("output_id"), F.col("ref_row").alias("ref_id"), "shared", "size", "overlap")


def audit(outputs: DataFrame, refs: DataFrame, output_id: str, ref_id: str, n: int = 8) -> DataFrame:
    """Findings of all outputs against all references: every pair that can be suspicious, and all with a run of 28.

    A verdict needs a common run of 28 characters, so a shared 28-gram, or an overlap of the ladder's least share. Pairs with
    neither are clean without being looked at. Null texts, and texts without letters and numbers, have no findings; repeated ids
    count as texts of their own.
    """
    # made once, so that what reads them needs no second Python worker
    ours, theirs = stored(copying_texts(outputs, output_id), "copying-outputs"), stored(copying_texts(refs, ref_id), "copying-references")
    least = min(over for *_, over in LADDER if over)
    runs = copy_candidates(ours, theirs, LADDER[0][1]).select("output_id", "ref_id", F.lit(True).alias("run"))
    near = overlap_candidates(ours.where(F.length("text") >= LADDER[0][0]), theirs, n, least).withColumn("run", F.lit(False))
    met = runs.unionByName(near).groupBy("output_id", "ref_id").agg(F.max("run").alias("run"))
    counted = with_texts(met, ours, theirs).withColumn("__n", shared_grams("output_text", "ref_text", F.lit(n)))
    counted = counted.withColumns({"shared": F.col("__n.shared"), "size": F.col("__n.size")}).drop("__n")
    counted = counted.where(F.col("run") | (F.col("shared") >= least * F.col("size")))
    return copying_verdict(longest_common_substring(ngram_overlap(counted)))


def suspicious_blocks(findings: DataFrame) -> DataFrame:
    return findings.groupBy("output_id").agg(F.bool_or("suspicious").alias("suspicious"))
