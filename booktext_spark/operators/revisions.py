"""Revision history: effective texts, locks, numbering and new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("project_id", "block_id")
SOURCE_CHARS = 64


def block_revisions(blocks: DataFrame, revisions: DataFrame, project_id: str | None = None) -> DataFrame:
    """Revisions with section and order of their block, of one project or of all."""
    rows = revisions if project_id is None else revisions.where(F.col("project_id") == project_id)
    return rows.join(blocks.select(F.col("stable_id").alias("block_id"), "book_id", "section_id", "section_ordinal", "ordinal"), "block_id")


def effective_revision(revisions: DataFrame) -> DataFrame:
    """The shown revision of each (project, block): a locked human one before a human before a model one, then the newest; never a candidate.

    A maximum by (rank, number), so that a task sends one row for each block.
    """
    human = F.col("revision_kind") == "human"
    rank = F.when(human & F.coalesce("locked", F.lit(False)), 3).when(human, 2).otherwise(1)
    rest = [c for c in revisions.columns if c not in KEY]
    best = revisions.where("revision_kind <> 'model_candidate'").groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct(rank, "revision_no")).alias("r"))
    return best.select(*KEY, "r.*")


def next_revision_no(revisions: DataFrame) -> DataFrame:
    return revisions.groupBy(*KEY).agg((F.max("revision_no") + 1).alias("next_no"))


def candidates_per_segment(revisions: DataFrame) -> DataFrame:
    """project_id, block_id, candidates: newest first."""
    item = F.struct("revision_no", "text", "source")
    return revisions.where("revision_kind = 'model_candidate'").groupBy(*KEY).agg(F.sort_array(F.collect_list(item), asc=False).alias("candidates"))


def locked_blocks(revisions: DataFrame) -> DataFrame:
    """(project, block) with any locked human revision."""
    return revisions.where("revision_kind = 'human' and locked").select(*KEY).distinct()


def already_saved(rows: DataFrame, revisions: DataFrame) -> DataFrame:
    """Rows that no stored revision of the same project, block and source (and kind, for candidates) makes superfluous."""
    old = revisions.select(*KEY, "source", F.when(F.col("revision_kind") == "model_candidate", "model_candidate").otherwise("").alias("k")).distinct()
    kind = F.when(F.col("revision_kind") == "model_candidate", "model_candidate").otherwise("")
    return rows.withColumn("k", kind).join(old, [*KEY, "source", "k"], "left_anti").drop("k")


def revision_rows(results: DataFrame, revisions: DataFrame, job_id: str, context_version: int, model: str, single_block: bool = False) -> DataFrame:
    """New revisions for results(project_id, block_id, draft, final).

    A locked block gets one candidate; any other a draft and a final row, which is a candidate where one block was run again. Blocks that this job
    has saved before get none, so that a repeated run adds nothing.
    """
    final_kind = "model_candidate" if single_block else "model_review"
    candidate, review, draft = f"worker:{job_id}:model={model}"[:SOURCE_CHARS], f"job:{job_id}:review", f"job:{job_id}:draft"
    rows = results.join(locked_blocks(revisions).withColumn("is_locked", F.lit(True)), list(KEY), "left").join(next_revision_no(revisions), list(KEY), "left")
    rows = rows.withColumns({"is_locked": F.coalesce("is_locked", F.lit(False)), "n": F.coalesce("next_no", F.lit(1))})
    rows = rows.withColumns({"source": F.when(F.col("is_locked"), candidate).otherwise(review), "revision_kind": F.when(F.col("is_locked"), "model_candidate").otherwise("")})
    old = revisions.select(*KEY, "source", F.col("revision_kind").alias("old_kind")).distinct()
    fresh = rows.join(old, [*[rows[k] == old[k] for k in KEY], rows["source"] == old["source"], (rows["revision_kind"] == "") | (rows["revision_kind"] == old["old_kind"])], "left_anti")
    new = lambda offset, kind, text, source: F.struct((F.col("n") + offset).alias("revision_no"), F.lit(kind).alias("revision_kind"), F.col(text).alias("text"), F.lit(source).alias("source"))
    made = F.when(F.col("is_locked"), F.array(new(0, "model_candidate", "final", candidate))).otherwise(F.array(new(0, "model_draft", "draft", draft), new(1, final_kind, "final", review)))
    return fresh.select(*KEY, F.explode(made).alias("r")).select(*KEY, "r.*", F.lit(False).alias("locked"), F.lit(context_version).alias("context_version"))


def apply_translations(blocks: DataFrame, effective: DataFrame) -> DataFrame:
    """blocks with text: the effective one, else the source. effective: block_id, text."""
    new = effective.select(F.col("block_id").alias("stable_id"), F.col("text").alias("translated"))
    return blocks.join(new, "stable_id", "left").withColumn("text", F.coalesce("translated", "source_text"))
