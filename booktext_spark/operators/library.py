"""Reference libraries: rights, pairs, de-duplication and style profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from booktext_spark.functions.ids import pair_hash
from booktext_spark.functions.text import PROFILE_MARKS, canonical_text, needs_review, nfkc, occurrences, strip
from booktext_spark.operators.numbering import numbered


def building_libraries(libraries: DataFrame) -> DataFrame:
    """Libraries in status building whose rights are confirmed."""
    return libraries.where((F.col("status") == "building") & F.col("rights_confirmed"))


def authorized_pairs(libraries: DataFrame, pairs: DataFrame, max_side: int = 300) -> DataFrame:
    """Pairs of libraries whose rights are confirmed and whose snippets may leave, sides cut to max_side characters.

    libraries: library_id, target_locale, priority, rights_confirmed, allows_external_snippets. Pairs empty on both sides go.
    """
    allowed = libraries.where("rights_confirmed and allows_external_snippets").select("library_id", "target_locale", "priority")
    cut = lambda c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, max_side)
    joined = pairs.join(allowed, "library_id").withColumns({"source_text": cut("source_text"), "target_text": cut("target_text")})
    return joined.where((strip(F.col("source_text")) != "") | (strip(F.col("target_text")) != ""))


def project_libraries(projects: DataFrame, libraries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(project_id, library_id of usable selections; rejects with NOT_FOUND or VALIDATION_ERROR for another locale)."""
    wanted = projects.select("project_id", "target_locale", F.explode("selected_library_ids").alias("library_id"))
    known = libraries.select("library_id", F.col("target_locale").alias("library_locale"))
    joined = wanted.join(known, "library_id", "left")
    code = F.when(F.col("library_locale").isNull(), "NOT_FOUND").when(F.col("library_locale") != F.col("target_locale"), "VALIDATION_ERROR")
    joined = joined.withColumn("error_code", code)
    return joined.where("error_code is null").select("project_id", "library_id"), joined.where("error_code is not null").select("project_id", "library_id", "error_code")


def library_documents(specs: DataFrame, docs: DataFrame) -> DataFrame:
    """specs with the paragraphs of both sides; a spec with a missing side keeps a null there."""
    side = lambda s: docs.select(F.col("upload_id").alias(f"{s}_upload_id"), F.col("paragraphs").alias(f"{s}_paragraphs"))
    return specs.join(side("source"), "source_upload_id", "left").join(side("target"), "target_upload_id", "left")


def library_text_union(sources: DataFrame, blocks: DataFrame) -> DataFrame:
    """library_id, text: the distinct block texts of all source uploads of each library."""
    return sources.select("library_id", "upload_id").distinct().join(blocks, "upload_id").select("library_id", F.col("source_text").alias("text")).distinct()


def dedup_pairs(pairs: DataFrame, order_by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(first row of each pair hash by order_by, counts of inserted and duplicate pairs).

    Only hash and order are compared; the first row comes from a partial minimum, not from a sorted window.
    """
    hashed = pairs.withColumn("pair_hash", pair_hash(F.col("source_text"), F.col("target_text"), F.col("target_locale")))
    columns = [c for c in hashed.columns if c != "pair_hash"]
    first = hashed.groupBy("pair_hash").agg(F.min_by(F.struct(*columns), F.struct(*order_by)).alias("row"), F.count("*").alias("n"))
    counts = first.agg(F.count("*").alias("inserted"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    return first.select("pair_hash", "row.*"), counts


def first_occurrence_distinct(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """by, value, position: the distinct values of each group in order of their first occurrence.

    Only the first place of a value is kept before groups are ordered; a group may be in many tasks. A null value is one value; values
    that share their first place go in no fixed order. For an array column, array_distinct does the same.
    """
    first = rows.groupBy(by, value).agg(F.min(order).alias("__at"))
    return numbered(first, by, ["__at"]).drop("__at")


def dedup_stats(texts: DataFrame, by: str, text_col: str = "text") -> DataFrame:
    """by, total_blocks, unique_blocks, deduplicated_blocks and, of the distinct texts, one hash over their sorted hashes."""
    distinct = texts.where(F.col(text_col).isNotNull()).groupBy(by, F.sha2(text_col, 256).alias("h")).agg(F.count("*").alias("n"))
    return distinct.groupBy(by).agg(F.sum("n").alias("total_blocks"), F.count("*").alias("unique_blocks"), (F.sum("n") - F.count("*")).alias("deduplicated_blocks"))


def content_hashes(texts: DataFrame, by: str, text_col: str = "text") -> DataFrame:
    """by, content_hash: one row for each distinct text."""
    return texts.where(F.col(text_col).isNotNull()).select(by, F.sha2(text_col, 256).alias("content_hash")).distinct()


def style_profile(texts: DataFrame, by: str, text_col: str = "text", normal: bool = False) -> DataFrame:
    """by, sample_count, total_chars, average_length, dialogue_marks, dialogue_ratio, punctuation of non-blank texts.

    normal: the texts are in NFKC already. NFKC rewrites three of the counted marks, so that they count 0.
    """
    text = F.col(text_col)
    rows = texts.where(text.isNotNull() & (strip(text) != "")).select(by, canonical_text(text if normal else nfkc(text)).alias("t"))
    marks: dict[str, Column] = {f"m{i}": F.sum(occurrences(F.col("t"), m)) for i, m in enumerate(PROFILE_MARKS)}
    sums = rows.groupBy(by).agg(F.count("*").alias("sample_count"), F.sum(F.length("t").cast("bigint")).alias("total_chars"), F.sum(occurrences(F.col("t"), "「") + occurrences(F.col("t"), "『")).alias("dialogue_marks"), *[c.alias(n) for n, c in marks.items()])
    punctuation = F.create_map(*[x for i, m in enumerate(PROFILE_MARKS) for x in (F.lit(m), F.col(f"m{i}"))])
    return sums.select(
        by, "sample_count", "total_chars", F.bround(F.col("total_chars") / F.col("sample_count"), 2).alias("average_length"), "dialogue_marks",
        F.bround(F.col("dialogue_marks") / F.greatest("total_chars", F.lit(1)), 6).alias("dialogue_ratio"), punctuation.alias("punctuation"),
    )


def review_flags(aligned: DataFrame, by: str = "library_id") -> DataFrame:
    """by, status: review_required where any group has low confidence, else ready."""
    return aligned.groupBy(by).agg(F.when(F.bool_or(needs_review(F.col("confidence"))), "review_required").otherwise("ready").alias("status"))


def project_status(results: DataFrame) -> DataFrame:
    """project_id, status: awaiting_review where any block carries a quality flag, else completed."""
    return results.groupBy("project_id").agg(F.when(F.bool_or(F.size("quality_flags") > 0), "awaiting_review").otherwise("completed").alias("status"))


def library_updates(aligned: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, review, replace): replace(library_id, pairings, alignment_review) tells which stored lists a run replaces.

    The review list always is replaced, the pairings only where a library has accepted groups.
    """
    low = needs_review(F.col("confidence"))
    replace = aligned.groupBy("library_id").agg(F.bool_or(~low).alias("pairings"), F.lit(True).alias("alignment_review"))
    return aligned.where(~low), aligned.where(low), replace
