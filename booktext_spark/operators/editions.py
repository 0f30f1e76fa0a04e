"""Ordered blocks, review pages and guards of editions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from booktext_spark.functions.text import strip
from booktext_spark.operators.numbering import numbered
from booktext_spark.operators.revisions import candidates_per_segment

LARGEST_PAGE = 200


def ordered_blocks(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """blocks with section_ordinal and position in the book, by section and block ordinals; a book may be in many tasks.

    Blocks of unknown sections go; blocks that share both ordinals go in no fixed order; an empty table stays empty.
    """
    rows = blocks.drop("section_ordinal").join(sections.select("book_id", "section_id", F.col("ordinal").alias("section_ordinal")), ["book_id", "section_id"])
    return numbered(rows, "book_id", ["section_ordinal", "ordinal"])


def section_title(blocks: DataFrame) -> DataFrame:
    """section_id, title: the first heading's text, stripped; empty without one."""
    heading = F.col("kind") == "heading"
    return blocks.groupBy("section_id").agg(F.coalesce(F.min_by(strip(F.col("source_text")), F.when(heading, F.col("ordinal"))), F.lit("")).alias("title"))


def parse_counts(blocks: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """book_id, n_sections, n_blocks and, with assets, n_assets."""
    counts = blocks.groupBy("book_id").agg(F.countDistinct("section_id").alias("n_sections"), F.count("*").alias("n_blocks"))
    if assets is None:
        return counts
    return counts.join(assets.groupBy("book_id").agg(F.count("*").alias("n_assets")), "book_id", "left").fillna(0, ["n_assets"])


def segment_page(blocks: DataFrame, effective: DataFrame, revisions: DataFrame | None, page: int, size: int) -> DataFrame:
    """The rows of one page of every book: position, total, source, text, status and candidates.

    blocks: book_id, section_ordinal, ordinal, stable_id (its own for each block), source_text; effective: block_id, revision_kind, locked, text.
    Pages count from 1; a page beyond the end has no rows; blocks that share both ordinals go by stable_id.
    """
    if not 1 <= size <= LARGEST_PAGE or page < 1:
        raise ValueError(f"page must be 1 or more and size from 1 to {LARGEST_PAGE}")
    # ids and ordinals are ranked, the last wanted place first, so that each task leaves no more than these; texts are joined to the page's rows only
    book = Window.partitionBy("book_id").orderBy("section_ordinal", "ordinal", "stable_id")
    ranked = blocks.select("book_id", "section_ordinal", "ordinal", "stable_id").withColumn("position", F.row_number().over(book)).where(F.col("position") <= page * size)
    totals = blocks.groupBy("book_id").agg(F.count("*").alias("total"))
    rows = ranked.where(F.col("position") > (page - 1) * size).join(totals, "book_id").join(blocks.select("stable_id", "source_text"), "stable_id")
    shown = effective.select(F.col("block_id").alias("stable_id"), F.col("text").alias("translation"), "revision_kind", "locked")
    rows = rows.join(shown, "stable_id", "left").withColumn("status", segment_status())
    if revisions is None:
        return rows
    more = candidates_per_segment(revisions).select(F.col("block_id").alias("stable_id"), "candidates")
    return rows.join(more, "stable_id", "left")


def segment_status():
    """pending, reviewed (human or locked) or translated."""
    human = (F.col("revision_kind") == "human") | F.coalesce("locked", F.lit(False))
    return F.when(F.col("translation").isNull(), "pending").when(human, "reviewed").otherwise("translated")


def stale_jobs(jobs: DataFrame, projects: DataFrame) -> DataFrame:
    """Jobs whose checkpoint holds another context version than the project: job_id, error_code."""
    version = F.get_json_object("checkpoint", "$.context_version").cast("int")
    now = projects.select("project_id", F.col("context_version").alias("now"))
    return jobs.join(now, "project_id").where(~version.eqNullSafe(F.col("now"))).select("job_id", F.lit("INVALID_STATE").alias("error_code"))


def stale_exports(exports: DataFrame, books: DataFrame) -> DataFrame:
    """Exports of another version than the book's: export_id, error_code."""
    now = books.select("book_id", F.col("source_version").alias("now"))
    return exports.join(now, "book_id").where(~F.col("source_version").eqNullSafe(F.col("now"))).select("export_id", F.lit("INVALID_STATE").alias("error_code"))
