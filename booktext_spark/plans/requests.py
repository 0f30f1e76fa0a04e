"""Queries of model requests and answers. Conversations stand for sections, turns for blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from booktext_spark.operators import library, requests
from booktext_spark.plans.base import Register, table

register = Register()


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("section_id"), F.col("turn").cast("int").alias("ordinal"), F.concat_ws(":", "conv_id", "turn").alias("stable_id"), F.col("text").alias("source_text"), "role")


@register("SELECT conv_id || ':' || turn AS stable_id FROM conversations WHERE trim(text) <> ''")
def active_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.active_blocks(_blocks(spark, sf_dir)).select("stable_id")


@register("SELECT conv_id || ':' || turn AS stable_id FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 5)")
def pending_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    return requests.pending_sections(blocks, blocks.where("ordinal = 5")).select("stable_id")


BATCH_SQL = """WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
b AS (SELECT conv_id, r, turn, n AS used, n, 0 AS batch FROM o WHERE r = 1
  UNION ALL SELECT o.conv_id, o.r, o.turn, CASE WHEN b.used + o.n > 600 THEN o.n ELSE b.used + o.n END, o.n, CASE WHEN b.used + o.n > 600 THEN b.batch + 1 ELSE b.batch END FROM b JOIN o ON o.conv_id = b.conv_id AND o.r = b.r + 1)
"""


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.pack_batches(_blocks(spark, sf_dir), 600).withColumn("batch_id", F.concat_ws("/", "section_id", "batch_no"))


@register(BATCH_SQL + "SELECT conv_id AS section_id, batch::INT AS batch_no, string_agg(conv_id || ':' || turn, ',' ORDER BY r) AS ids, sum(n)::BIGINT AS n_chars FROM b GROUP BY ALL")
def pack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir).select("section_id", "batch_no", F.array_join("block_ids", ",").alias("ids"), "n_chars")


def _listed(field: str):
    """A digest of the ids and texts that a payload lists, in order."""
    blocks = F.from_json(F.get_json_object("payload", "$.blocks"), f"array<struct<block_id:string,{field}:string>>")
    return F.sha2(F.array_join(F.transform(blocks, lambda b: F.concat_ws("\n", b["block_id"], b[field])), "\n"), 256)


@register(BATCH_SQL + "SELECT conv_id || '/' || batch AS batch_id, count(*)::INT AS n, 'zh-TW' AS locale, sha256(string_agg(conv_id || ':' || turn || chr(10) || text, chr(10) ORDER BY b.r)) AS texts, 't' AS reference, true AS told FROM b JOIN conversations USING (conv_id, turn) GROUP BY ALL")
def build_translation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = _batches(spark, sf_dir)
    references = batches.select("batch_id", F.array(F.struct(F.lit("s").alias("source"), F.lit("t").alias("target"))).alias("pairs"))
    made = requests.build_translation_requests(batches, _blocks(spark, sf_dir), references, "zh-TW")
    return made.select("batch_id", F.size("expected_ids").alias("n"), F.get_json_object("payload", "$.locale").alias("locale"), _listed("source").alias("texts"), F.get_json_object("payload", "$.reference_pairs[0].target").alias("reference"), F.contains("system", F.lit("Traditional Chinese")).alias("told"))


@register(BATCH_SQL + "SELECT conv_id || '/' || batch AS batch_id, count(*)::INT AS n, sha256(string_agg(conv_id || ':' || turn || chr(10) || text, chr(10) ORDER BY b.r)) AS texts, sha256(string_agg(conv_id || ':' || turn || chr(10) || 'draft of ' || text, chr(10) ORDER BY b.r)) AS drafts FROM b JOIN conversations USING (conv_id, turn) GROUP BY ALL")
def build_review_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    draft = blocks.select("stable_id", F.concat(F.lit("draft of "), "source_text").alias("text"))
    made = requests.build_review_requests(_batches(spark, sf_dir), blocks, draft, "zh-CN")
    return made.select("batch_id", F.size("expected_ids").alias("n"), _listed("japanese").alias("texts"), _listed("draft").alias("drafts"))


@register(BATCH_SQL + "SELECT conv_id || '/' || batch AS batch_id, count(*)::INT AS n, sha256(string_agg(conv_id || ':' || turn || chr(10) || text, chr(10) ORDER BY b.r)) AS texts FROM b JOIN conversations USING (conv_id, turn) WHERE role = 'assistant' GROUP BY ALL")
def build_rewrite_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    current = blocks.select("stable_id", F.col("source_text").alias("text"))
    made = requests.build_rewrite_requests(_batches(spark, sf_dir), blocks, current, blocks.where("role = 'assistant'"), "zh-CN")
    return made.select("batch_id", F.size("expected_ids").alias("n"), _listed("current").alias("texts"))


def _responses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Answers for whole conversations; by conv_id modulo 7 some are broken in a known way."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").cast("string").alias("block_id"), "text"))).alias("t"))
    good = F.to_json(F.struct(F.col("t").alias("translations")))
    way = F.col("conv_id") % 7
    repeated = F.to_json(F.struct(F.concat("t", F.slice("t", 1, 1)).alias("translations")))
    short = F.to_json(F.struct(F.slice("t", 2, 1000).alias("translations")))
    number = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["block_id"].alias("block_id"), F.lit(1).alias("text"))).alias("translations")))
    raw = (
        F.when(way == 1, F.concat(F.lit("\n```json\n"), good, F.lit("\n```\n"))).when(way == 2, "not json").when(way == 3, repeated).when(way == 4, short).when(way == 5, number)
        .when(way == 6, F.concat(F.lit("["), good, F.lit("]"))).otherwise(good)
    )
    rows = turns.select(F.col("conv_id").alias("batch_id"), F.lit(0).alias("attempt"), raw.alias("raw"), F.transform("t", lambda x: x["block_id"]).alias("expected_ids"))
    return rows.select("batch_id", "attempt", "raw"), rows.select("batch_id", "expected_ids")


REASON_SQL = """CASE conv_id % 7 WHEN 2 THEN 'response is not valid JSON' WHEN 3 THEN 'duplicate block_id' WHEN 4 THEN 'block IDs differ' WHEN 5 THEN 'block_id and text must be strings' ELSE 'response root must be an object' END"""


@register(f"""SELECT conv_id AS batch_id, turn::VARCHAR AS stable_id, sha256(text) AS h, '' AS reason FROM conversations WHERE conv_id % 7 < 2
UNION ALL SELECT DISTINCT conv_id, '', '', {REASON_SQL} FROM conversations WHERE conv_id % 7 >= 2""")
def parse_structured_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, rejects = requests.parse_structured_output(*_responses(spark, sf_dir))
    good = ok.select("batch_id", "stable_id", F.sha2("text", 256).alias("h"), F.lit("").alias("reason"))
    return good.unionByName(rejects.select("batch_id", F.lit("").alias("stable_id"), F.lit("").alias("h"), F.substring_index("reason", ";", 1).alias("reason")))


@register(f"SELECT conv_id AS batch_id, 1 AS attempt, {REASON_SQL} AS reason, count(*)::INT AS n_expected FROM conversations WHERE conv_id % 7 >= 2 GROUP BY 1")
def build_repair_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses, batches = _responses(spark, sf_dir)
    rejects = requests.parse_structured_output(responses, batches)[1]
    return requests.build_repair_requests(rejects, batches.select("batch_id", F.to_json("expected_ids").alias("payload"))).select("batch_id", "attempt", F.substring_index("reason", ";", 1).alias("reason"), F.json_array_length("payload").alias("n_expected"))


@register(
    """WITH t AS (SELECT conv_id, list(turn::VARCHAR ORDER BY turn) AS e, list(CASE WHEN turn = 1 THEN 'x' ELSE turn::VARCHAR END ORDER BY turn) AS g FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN len(e) > 1 THEN '1' ELSE '' END AS missing, CASE WHEN len(e) > 1 THEN 'x' ELSE '' END AS unexpected FROM t"""
)
def id_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.col("turn").cast("string")).alias("e"), F.collect_list(F.when(F.col("turn") == 1, "x").otherwise(F.col("turn").cast("string"))).alias("g"))
    d = requests.id_set_diff(F.col("e"), F.col("g"))
    return sets.select("conv_id", F.array_join(d["missing"], ",").alias("missing"), F.array_join(d["unexpected"], ",").alias("unexpected"))


@register(
    """SELECT conv_id || ':' || turn AS stable_id, sha256(CASE WHEN role = 'system' THEN 'rewritten' WHEN turn % 2 = 0 THEN 'reviewed' ELSE text END) AS h, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS n_flags FROM conversations"""
)
def merge_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    draft = blocks.select("stable_id", F.col("source_text").alias("text"))
    reviewed = blocks.where("ordinal % 2 = 0").select("stable_id", F.lit("reviewed").alias("text"))
    rewritten = blocks.where("role = 'system'").select("stable_id", F.lit("rewritten").alias("text"))
    verdicts = blocks.select("stable_id", (F.col("role") == "assistant").alias("suspicious"))
    merged = requests.merge_passes(blocks, draft, reviewed, rewritten, verdicts)
    return merged.select("stable_id", F.sha2("final", 256).alias("h"), F.size("quality_flags").alias("n_flags"))


@register("SELECT conv_id AS project_id, CASE WHEN bool_or(role = 'system') THEN 'awaiting_review' ELSE 'completed' END AS status FROM conversations GROUP BY 1")
def project_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.when(F.col("role") == "system", F.array(F.lit("REFERENCE_OVERLAP"))).otherwise(F.array().cast("array<string>"))
    return library.project_status(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("project_id"), flags.alias("quality_flags")))


@register(
    """WITH l AS (SELECT source AS library_id, count(*) AS n FROM documents GROUP BY 1)
SELECT doc_id AS project_id, l.n AS first_profile, 2 AS n FROM documents JOIN l ON l.library_id = source WHERE 'src' || (doc_id % 3) IN (SELECT library_id FROM l) AND source IS NOT NULL"""
)
def context_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    libraries = docs.groupBy(F.col("source").alias("library_id")).agg(F.count("*").alias("profile")).withColumns({"name": F.col("library_id"), "priority": F.lit(20), "mode": F.lit("paired")})
    projects = docs.select(F.col("doc_id").alias("project_id"), F.array("source", F.concat(F.lit("src"), F.col("doc_id") % 3)).alias("selected_library_ids"))
    made = requests.context_profiles(projects, libraries)
    return made.select("project_id", F.element_at("profiles", 1)["profile"].alias("first_profile"), F.size("profiles").alias("n")).where("n = 2")


QUERIES, ORACLE_SQL = register, register.sql
