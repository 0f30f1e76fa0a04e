"""Queries of revisions and pages. Conversations stand for projects: each role is a block, each turn a revision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from booktext_spark.functions.text import text_for
from booktext_spark.operators import editions, revisions
from booktext_spark.plans.base import LINES_SQL, Register, lines, number, table

register = Register()
#: system: locked human, user: human; assistant: by turn, a model draft, review or candidate.
REV_SQL = """rev AS (SELECT conv_id AS project_id, conv_id * 10 + turn % 3 AS block_id, turn::INT AS revision_no, text, role = 'system' AS locked, 'job:' || (turn % 4) AS source,
  CASE WHEN role IN ('system', 'user') THEN 'human' WHEN turn % 5 = 1 THEN 'model_candidate' WHEN turn % 2 = 1 THEN 'model_draft' ELSE 'model_review' END AS revision_kind FROM conversations)"""


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    kind = F.when(F.col("role").isin("system", "user"), "human").when(turn % 5 == 1, "model_candidate").when(turn % 2 == 1, "model_draft").otherwise("model_review")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("project_id"), (F.col("conv_id") * 10 + turn % 3).alias("block_id"), turn.cast("int").alias("revision_no"), "text",
        (F.col("role") == "system").alias("locked"), F.concat(F.lit("job:"), turn % 4).alias("source"), kind.alias("revision_kind"),
    )


EFFECTIVE_SQL = f"""WITH {REV_SQL}, eff AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, block_id ORDER BY
  CASE WHEN revision_kind = 'human' AND locked THEN 3 WHEN revision_kind = 'human' THEN 2 ELSE 1 END DESC, revision_no DESC) AS r FROM rev WHERE revision_kind <> 'model_candidate') WHERE r = 1)"""


@register(EFFECTIVE_SQL + " SELECT project_id, block_id, revision_no, revision_kind, locked, sha256(text) AS h FROM eff")
def effective_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.effective_revision(_revisions(spark, sf_dir)).select("project_id", "block_id", "revision_no", "revision_kind", "locked", F.sha2("text", 256).alias("h"))


@register(f"WITH {REV_SQL} SELECT project_id, block_id, (max(revision_no) + 1)::INT AS next_no FROM rev GROUP BY ALL")
def next_revision_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.next_revision_no(_revisions(spark, sf_dir))


@register(f"WITH {REV_SQL} SELECT project_id, block_id, count(*) AS n, string_agg(revision_no::VARCHAR, ',' ORDER BY revision_no DESC) AS numbers FROM rev WHERE revision_kind = 'model_candidate' GROUP BY ALL")
def candidates_per_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = revisions.candidates_per_segment(_revisions(spark, sf_dir))
    return c.select("project_id", "block_id", F.size("candidates").cast("bigint").alias("n"), F.array_join(F.transform("candidates", lambda x: x["revision_no"].cast("string")), ",").alias("numbers"))


@register(f"WITH {REV_SQL} SELECT DISTINCT project_id, block_id FROM rev WHERE revision_kind = 'human' AND locked")
def locked_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.locked_blocks(_revisions(spark, sf_dir))


@register(EFFECTIVE_SQL + " SELECT b.doc_id AS stable_id, sha256(coalesce(e.text, b.text)) AS h FROM documents b LEFT JOIN eff e ON e.block_id = b.doc_id")
def apply_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stable_id"), F.col("text").alias("source_text"))
    return revisions.apply_translations(blocks, revisions.effective_revision(_revisions(spark, sf_dir))).select("stable_id", F.sha2("text", 256).alias("h"))


@register(f"WITH {REV_SQL} SELECT project_id, block_id, revision_no, ordinal, section_id FROM rev JOIN (SELECT doc_id AS block_id, source AS section_id, doc_id::INT AS ordinal FROM documents) USING (block_id)")
def block_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stable_id"), F.lit(1).alias("book_id"), F.col("source").alias("section_id"), F.lit(0).alias("section_ordinal"), F.col("doc_id").cast("int").alias("ordinal"))
    return revisions.block_revisions(blocks, _revisions(spark, sf_dir)).select("project_id", "block_id", "revision_no", "ordinal", "section_id")


@register(
    f"""WITH {REV_SQL}, old AS (SELECT DISTINCT project_id, block_id, source, revision_kind = 'model_candidate' AS c FROM rev WHERE revision_no < 4)
SELECT project_id, block_id, revision_no FROM rev r WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.project_id = r.project_id AND o.block_id = r.block_id AND o.source = r.source AND o.c = (r.revision_kind = 'model_candidate'))"""
)
def already_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the first four turns do not hold already."""
    rows = _revisions(spark, sf_dir)
    return revisions.already_saved(rows, rows.where("revision_no < 4")).select("project_id", "block_id", "revision_no")


@register(
    f"""WITH {REV_SQL}, b AS (SELECT project_id, block_id, max(revision_no) + 1 AS n, bool_or(revision_kind = 'human' AND locked) AS l FROM rev GROUP BY ALL)
SELECT project_id, block_id, n::INT AS revision_no, 'model_candidate' AS revision_kind, 'worker:j1:model=m' AS source FROM b WHERE l
UNION ALL SELECT project_id, block_id, n::INT, 'model_draft', 'job:j1:draft' FROM b WHERE NOT l UNION ALL SELECT project_id, block_id, (n + 1)::INT, 'model_review', 'job:j1:review' FROM b WHERE NOT l"""
)
def revision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _revisions(spark, sf_dir)
    results = rows.groupBy("project_id", "block_id").agg(F.max("text").alias("draft"), F.min("text").alias("final"))
    return revisions.revision_rows(results, rows, "j1", 1, "m").select("project_id", "block_id", "revision_no", "revision_kind", "source")


@register(f"WITH {LINES_SQL} SELECT source AS book_id, doc_id, ordinal::INT AS ordinal, row_number() OVER (PARTITION BY source ORDER BY doc_id, ordinal)::INT AS position FROM lines")
def ordered_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = lines(spark, sf_dir).select(F.col("source").alias("book_id"), F.col("doc_id").alias("section_id"), "ordinal")
    sections = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("section_id"), F.col("doc_id").cast("int").alias("ordinal"))
    return editions.ordered_blocks(sections, blocks).select("book_id", F.col("section_id").alias("doc_id"), "ordinal", "position")


@register(
    f"""WITH {REV_SQL}, {LINES_SQL}, eff AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY CASE WHEN revision_kind = 'human' AND locked THEN 3 WHEN revision_kind = 'human' THEN 2 ELSE 1 END DESC, revision_no DESC) AS r
  FROM rev WHERE revision_kind <> 'model_candidate') WHERE r = 1),
p AS (SELECT source AS book_id, doc_id * 1000 + ordinal AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id, ordinal) AS position, count(*) OVER (PARTITION BY source) AS total FROM lines)
SELECT book_id, id, position::INT AS position, total, CASE WHEN e.text IS NULL THEN 'pending' WHEN e.revision_kind = 'human' OR e.locked THEN 'reviewed' ELSE 'translated' END AS status
FROM p LEFT JOIN eff e ON e.block_id = p.id WHERE position BETWEEN 51 AND 100"""
)
def segment_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 50 lines of every source."""
    blocks = lines(spark, sf_dir).select(F.col("source").alias("book_id"), F.col("doc_id").cast("int").alias("section_ordinal"), "ordinal", number("doc_id", "ordinal").alias("stable_id"), F.col("text").alias("source_text"))
    effective = revisions.effective_revision(_revisions(spark, sf_dir))
    return editions.segment_page(blocks, effective, None, 2, 50).select("book_id", F.col("stable_id").alias("id"), "position", "total", "status")


@register("SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN text WHEN role = 'system' THEN '' ELSE 'source' END AS t FROM conversations")
def text_for_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.when(F.col("role") == "assistant", F.create_map(F.lit("zh-CN"), F.col("text"))).when(F.col("role") == "system", F.create_map(F.lit("zh-CN"), F.lit(""))).otherwise(F.create_map(F.lit("zh-TW"), F.col("text")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text_for(made, "zh-CN", F.lit("source")).alias("t"))


@register("SELECT o_orderkey AS job_id FROM orders WHERE (o_orderkey % 5) <> (o_custkey % 3)")
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    jobs = orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("project_id"), F.to_json(F.struct((F.col("o_orderkey") % 5).alias("context_version"))).alias("checkpoint"))
    projects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), (F.col("c_custkey") % 3).cast("int").alias("context_version"))
    return editions.stale_jobs(jobs, projects).select("job_id")


@register("SELECT DISTINCT o_orderkey AS export_id FROM orders WHERE (o_orderkey % 5) <> (o_custkey % 3)")
def stale_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    exports = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("export_id"), F.col("o_custkey").alias("book_id"), (F.col("o_orderkey") % 5).alias("source_version"))
    books = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book_id"), (F.col("c_custkey") % 3).alias("source_version"))
    return editions.stale_exports(exports, books).select("export_id")


QUERIES, ORACLE_SQL = register, register.sql
