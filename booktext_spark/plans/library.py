"""Queries of reference libraries, profiles and search. Sources stand for libraries, languages for locales, labels for rights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from booktext_spark.functions.ids import stable_identifier
from booktext_spark.operators import align, library, search
from booktext_spark.operators.numbering import numbered
from booktext_spark.plans.base import LINES_SQL, Register, lines, number, table
from booktext_spark.streaming import feeds

register = Register()
NORMAL = r"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


@register(
    f"""WITH {LINES_SQL}, j AS (SELECT source, translate(text, '.,!?"', '。、！？「') AS t, text FROM lines), n AS (SELECT source, {NORMAL.format(t="translate(t, '！？', '!?')")} AS t FROM j WHERE trim(text) <> '')
SELECT source, count(*) AS sample_count, sum(length(t))::BIGINT AS total_chars, sum(length(t) - length(replace(t, '「', '')))::BIGINT AS dialogue_marks,
  floor(100 * sum(length(t)) / count(*))::BIGINT AS centi_length, floor(1e6 * sum(length(t) - length(replace(t, '「', ''))) / greatest(sum(length(t)), 1) + 1e-6)::BIGINT AS dialogue_millionths,
  sum(length(t) - length(replace(t, '。', '')))::BIGINT AS stops, sum(length(t) - length(replace(t, '、', '')))::BIGINT AS commas, 0::BIGINT AS others FROM n GROUP BY 1"""
)
def style_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with Japanese marks in place of Western ones; NFKC makes two of these Western again, so they count 0."""
    rows = lines(spark, sf_dir).withColumn("text", F.translate("text", '.,!?"', "。、！？「"))
    p = library.style_profile(rows, "source")
    mark = lambda m: F.element_at("punctuation", m)
    return p.select(
        "source", "sample_count", "total_chars", "dialogue_marks", F.floor(100 * F.col("total_chars") / F.col("sample_count")).alias("centi_length"),
        F.floor(F.lit(1e6) * F.col("dialogue_marks") / F.greatest("total_chars", F.lit(1)) + 1e-6).alias("dialogue_millionths"),
        mark("。").alias("stops"), mark("、").alias("commas"), (mark("！") + mark("？") + mark("……") + mark("——")).alias("others"),
    )


@register(f"WITH {LINES_SQL} SELECT source, count(*) AS total_blocks, count(DISTINCT text) AS unique_blocks, count(*) - count(DISTINCT text) AS deduplicated_blocks FROM lines WHERE text IS NOT NULL GROUP BY 1")
def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = library.dedup_stats(lines(spark, sf_dir), "source")
    return s.select("source", F.col("total_blocks").cast("bigint").alias("total_blocks"), "unique_blocks", F.col("deduplicated_blocks").cast("bigint").alias("deduplicated_blocks"))


@register(
    f"""WITH {LINES_SQL}, f AS (SELECT source, text, min((doc_id, ordinal)) AS pos FROM lines GROUP BY ALL)
SELECT source, sha256(text) AS h, row_number() OVER (PARTITION BY source ORDER BY pos)::INT AS position FROM f"""
)
def first_occurrence_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("at", F.struct("doc_id", "ordinal"))
    return library.first_occurrence_distinct(rows, "source", "text", "at").select("source", F.sha2("text", 256).alias("h"), "position")


@register(f"WITH {LINES_SQL} SELECT DISTINCT source, sha256(text) AS content_hash FROM lines WHERE text IS NOT NULL")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.content_hashes(lines(spark, sf_dir), "source")


@register(f"WITH {LINES_SQL} SELECT source AS library_id, count(DISTINCT text) AS n, bit_xor(('0x' || substring(sha256(text), 1, 15))::BIGINT) AS x FROM (SELECT DISTINCT source, text FROM lines) GROUP BY 1")
def library_text_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "documents").select(F.col("source").alias("library_id"), F.col("doc_id").alias("upload_id"))
    blocks = lines(spark, sf_dir).select(F.col("doc_id").alias("upload_id"), F.col("text").alias("source_text"))
    union = library.library_text_union(sources, blocks)
    return union.groupBy("library_id").agg(F.count("*").alias("n"), F.bit_xor(F.conv(F.substring(F.sha2("text", 256), 1, 15), 16, 10).cast("bigint")).alias("x"))


def _turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the one before: conversations as libraries of pairs."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("text").over(w).alias("source_text"), F.col("text").alias("target_text"))
    return rows.where("source_text is not null").select(number("conv_id", "turn").alias("pair_id"), "conv_id", "turn", F.concat(F.lit("lib"), F.col("conv_id") % 7).alias("library_id"), "source_text", "target_text", F.lit("zh-CN").alias("target_locale"))


PAIRS_SQL = """pairs AS (SELECT conv_id * 1000 + turn AS pair_id, conv_id, 'lib' || (conv_id % 7) AS library_id, s AS source_text, t AS target_text
  FROM (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS s, text AS t FROM conversations) WHERE s IS NOT NULL)"""


@register(
    f"""WITH {PAIRS_SQL}, h AS (SELECT *, sha256('zh-cn' || chr(31) || {NORMAL.format(t="source_text")} || chr(31) || {NORMAL.format(t="target_text")}) AS pair_hash FROM pairs)
SELECT pair_hash, min(pair_id) AS pair_id, arg_min(library_id, pair_id) AS library_id FROM h GROUP BY 1"""
)
def dedup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.dedup_pairs(_turn_pairs(spark, sf_dir), ["conv_id", "turn"])[0].select("pair_hash", "pair_id", "library_id")


@register(
    f"""WITH {PAIRS_SQL}, h AS (SELECT *, sha256('zh-cn' || chr(31) || {NORMAL.format(t="source_text")} || chr(31) || {NORMAL.format(t="target_text")}) AS pair_hash FROM pairs)
SELECT pair_hash, min(pair_id) AS pair_id, sha256(arg_min(source_text, pair_id)) AS h FROM h GROUP BY 1"""
)
def incremental_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.incremental_dedup(_turn_pairs(spark, sf_dir), order_by=["conv_id", "turn"]).select("pair_hash", "pair_id", F.sha2("source_text", 256).alias("h"))


def _rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as libraries of one pair: quality 1 confirms the rights, not toxic lets snippets out."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("library_id"), F.col("lang").alias("target_locale"), F.lit(20).alias("priority"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("x"))
    rows = docs.join(labels, docs["library_id"] == labels["doc_id"], "left")
    return rows.select("library_id", "target_locale", "priority", (F.coalesce("q", F.lit(0)) == 1).alias("rights_confirmed"), (F.coalesce("x", F.lit(1)) == 0).alias("allows_external_snippets"))


@register(
    """SELECT d.doc_id AS library_id, lang AS target_locale, length(substring(text, 1, 300))::INT AS n, sha256(substring(text, 1, 300)) AS h FROM documents d
JOIN (SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY 1) USING (doc_id) WHERE q = 1 AND x = 0 AND trim(text) <> ''"""
)
def authorized_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("library_id"), F.lit(0).alias("pos"), F.col("text").alias("source_text"), F.lit("").alias("target_text"))
    found = library.authorized_pairs(_rights(spark, sf_dir), pairs)
    return found.select("library_id", "target_locale", F.length("source_text").alias("n"), F.sha2("source_text", 256).alias("h"))


TOKENS = """list_distinct(list_concat(list_concat(list_transform(range(1, length(k)), lambda i: substring(k, i, 2)), list_transform(range(1, length(k) - 1), lambda i: substring(k, i, 3))),
  regexp_extract_all(t, '[a-z0-9_]{2,}')))"""
POST_SQL = f"""{PAIRS_SQL}, c AS (SELECT pair_id, library_id, lower(source_text) AS t, regexp_replace(lower(source_text), '[\\s\\p{{P}}]', '', 'g') AS k FROM pairs),
l AS (SELECT pair_id, library_id, {TOKENS} AS tokens FROM c), post AS (SELECT pair_id, len(tokens) AS n_tokens, unnest(tokens) AS token FROM l)"""


@register(f"WITH {POST_SQL} SELECT token, count(*) AS df FROM post GROUP BY 1")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _turn_pairs(spark, sf_dir)
    return search.corpus_stats(search.postings(pairs), pairs)[0]


SEARCH_SQL = f"""WITH {POST_SQL}, df AS (SELECT token, count(*) AS df FROM post GROUP BY 1),
stats AS (SELECT (SELECT count(*) FROM pairs) AS n, (SELECT count(*) FROM post) / (SELECT count(*) FROM pairs) AS mean),
qc AS (SELECT item_id, lower(text) AS t, regexp_replace(lower(text), '[\\s\\p{{P}}]', '', 'g') AS k FROM benchmark),
ql AS (SELECT item_id, list_concat(list_concat(list_transform(range(1, length(k)), lambda i: substring(k, i, 2)), list_transform(range(1, length(k) - 1), lambda i: substring(k, i, 3))), regexp_extract_all(t, '[a-z0-9_]{{2,}}')) AS tokens FROM qc),
qu AS (SELECT item_id, token, min(pos) AS pos FROM (SELECT item_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM ql) GROUP BY 1, 2),
q AS (SELECT item_id, token FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS r FROM qu) WHERE r <= 96),
w AS (SELECT item_id, pair_id, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * 2.2 / (1 + 1.2 * (0.25 + 0.75 * n_tokens / mean)) AS x
  FROM q JOIN post USING (token) JOIN df USING (token), stats),
s AS (SELECT item_id, pair_id, sum(x) AS bm25, count(*) AS matched FROM w GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25, 9) DESC, pair_id) AS position FROM s)
"""


@register(SEARCH_SQL + "SELECT item_id AS query_id, pair_id, matched, floor(bm25 * 1000 + 1e-6)::BIGINT AS milli FROM o WHERE position <= 32 AND item_id >= 0")
def ranked_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked candidates of each test item among the conversation pairs."""
    pairs = _turn_pairs(spark, sf_dir).withColumns({"priority": F.lit(20), "external_allowed": F.lit(True)})
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("zh-CN").alias("target_locale"), "text")
    return search.ranked(queries, pairs).select("query_id", "pair_id", "matched", F.floor(F.col("bm25") * 1000 + 1e-6).alias("milli"))


REFERENCES_SQL = SEARCH_SQL.replace(
    "FROM q JOIN post USING (token) JOIN df USING (token), stats)", "FROM q JOIN (SELECT p.* FROM post p WHERE (pair_id // 1000) % 5 <> 0) USING (token) JOIN df USING (token), stats)"
) + """, cand AS (SELECT s.*, (s.pair_id // 1000) % 3 AS priority, library_id, substring(source_text, 1, 300) AS st, substring(coalesce(target_text, ''), 1, 300) AS tt FROM s JOIN pairs USING (pair_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY priority DESC, round(bm25, 9) DESC, pair_id) AS place FROM cand),
t AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY place) AS position FROM r WHERE place <= 32 AND length(st) + length(tt) > 0)
SELECT item_id AS query_id, position::INT AS position, pair_id, library_id, sha256(st || chr(31) || tt) AS h, priority::INT AS priority, floor((priority * 1000 + bm25) * 1000 + 1e-6)::BIGINT AS milli
FROM t WHERE position <= 4"""


@register(REFERENCES_SQL)
def search_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The references of each test item among the pairs that may leave: four pairs of 600 characters always fit the budget of 2,400."""
    pairs = _turn_pairs(spark, sf_dir).withColumns({"priority": (F.col("conv_id") % 3).cast("int"), "external_allowed": F.col("conv_id") % 5 != 0})
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("zh-CN").alias("target_locale"), "text")
    found = search.search_references(queries, pairs)
    return found.select("query_id", "position", "pair_id", "library_id", F.sha2(F.concat_ws("\u001f", "source_text", "target_text"), 256).alias("h"), "priority", F.floor(F.col("score") * 1000 + 1e-6).alias("milli"))


@register(
    """WITH q AS (SELECT conv_id AS query_id, turn, length(substring(text, 1, 300)) AS n FROM conversations WHERE length(text) > 0),
c AS (SELECT query_id, turn, n, sum(n) OVER (PARTITION BY query_id ORDER BY turn) AS total, row_number() OVER (PARTITION BY query_id ORDER BY turn) AS r FROM q)
SELECT query_id, r::INT AS position, least(n, 700 - (total - n))::INT AS n FROM c WHERE r <= 4 AND total - n < 700"""
)
def fill_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as candidates of their conversation, within 700 characters."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("position"), F.col("turn").alias("pair_id"), F.lit("lib").alias("library_id"), F.col("text").alias("source_text"), F.lit("").alias("target_text"), F.lit(1).alias("priority"), F.lit(1.0).alias("score"))
    return search.fill_budget(rows.withColumn("position", F.col("position").cast("int")), 4, 300, 700).select("query_id", "position", F.length("source_text").alias("n"))


def _pairings(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    side = lambda role: F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    return turns.groupBy(F.col("conv_id").alias("pairing_id")).agg(side("user").alias("source_paragraphs"), side("assistant").alias("target_paragraphs"))


def _features_sql(text: str) -> str:
    bare = f"trim({text}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return f"""greatest(length(regexp_replace({text}, '\\s', '', 'g')), 1)::DOUBLE AS n, regexp_matches({bare}, '^[「『“"]')::INT AS opens, regexp_matches({bare}, '[」』”"]$')::INT AS closes, regexp_matches({bare}, '[。！？!?]$')::INT AS ends"""


#: All monotone paths of a pairing, a move at a time; the one of least cost, ties by the order of moves from its end. Costs add up in the order of the path.
PATHS_SQL = f"""WITH RECURSIVE turns AS (SELECT conv_id, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations WHERE role IN ('user', 'assistant')),
c AS (SELECT conv_id, count(*) FILTER (role = 'user') AS n, count(*) FILTER (role = 'assistant') AS m FROM turns GROUP BY 1),
one AS (SELECT conv_id, role, k, 1 AS size, text FROM turns UNION ALL SELECT a.conv_id, a.role, b.k, 2, a.text || chr(10) || b.text FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND a.role = b.role AND b.k = a.k + 1),
f AS (SELECT *, {_features_sql("text")} FROM one),
g AS (SELECT s.conv_id, s.k AS i, t.k AS j, s.size AS a, t.size AS b, s.text AS x, t.text AS y,
  least(abs(ln(t.n / greatest(s.n * 0.72, 1.0))), 2.5) + CASE WHEN (s.opens, s.closes) = (t.opens, t.closes) THEN 0.0 ELSE 0.28 END + CASE WHEN s.ends = t.ends THEN 0.0 ELSE 0.12 END AS cost
  FROM f s JOIN f t ON s.conv_id = t.conv_id AND s.role = 'user' AND t.role = 'assistant' AND s.size + t.size < 4),
moves AS (SELECT * FROM (VALUES (0, 2, 1, 0.22::DOUBLE), (1, 1, 2, 0.22::DOUBLE), (2, 1, 1, 0.0::DOUBLE), (3, 1, 0, 1.35::DOUBLE), (4, 0, 1, 1.35::DOUBLE)) AS v(move, a, b, penalty)),
p AS (SELECT conv_id, n, m, 0 AS i, 0 AS j, 0.0::DOUBLE AS total, []::INT[] AS back FROM c
  UNION ALL SELECT p.conv_id, n, m, p.i + v.a, p.j + v.b, total + coalesce(g.cost, 0.0) + v.penalty, list_prepend(v.move, back) FROM p JOIN moves v ON p.i + v.a <= n AND p.j + v.b <= m
    LEFT JOIN g ON g.conv_id = p.conv_id AND g.i = p.i + v.a AND g.j = p.j + v.b AND g.a = v.a AND g.b = v.b),
best AS (SELECT conv_id, list_reverse(arg_min(back, (total, back))) AS path FROM p WHERE i = n AND j = m GROUP BY 1),
steps AS (SELECT conv_id, unnest(range(len(path))) AS k, path FROM best),
placed AS (SELECT conv_id, k, path[k + 1] AS move, list_sum(list_transform(path[:k + 1], lambda q: CASE q WHEN 0 THEN 2 WHEN 4 THEN 0 ELSE 1 END))::INT AS i, list_sum(list_transform(path[:k + 1], lambda q: CASE q WHEN 1 THEN 2 WHEN 3 THEN 0 ELSE 1 END))::INT AS j FROM steps),
groups AS (SELECT g.*, penalty, row_number() OVER (PARTITION BY g.conv_id ORDER BY q.k) - 1 AS group_no FROM placed q JOIN moves v USING (move) JOIN g ON g.conv_id = q.conv_id AND g.i = q.i AND g.j = q.j AND g.a = v.a AND g.b = v.b)
SELECT conv_id AS pairing_id, group_no::INT AS group_no, CASE a WHEN 2 THEN (i - 2) || ',' || (i - 1) ELSE (i - 1)::VARCHAR END AS source_indices, CASE b WHEN 2 THEN (j - 2) || ',' || (j - 1) ELSE (j - 1)::VARCHAR END AS target_indices,
  sha256(x || chr(31) || y) AS h, floor(exp(-(cost + penalty)) * 1000 + 1e-6)::BIGINT AS confidence_milli, sha256(trim(x, ' ' || chr(9) || chr(10) || chr(13)) || chr(31) || trim(y, ' ' || chr(9) || chr(10) || chr(13))) AS content_hash FROM groups"""


@register(PATHS_SQL)
def align_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of each conversation against its assistant turns."""
    found = align.align_paragraphs(_pairings(spark, sf_dir))
    return found.select(
        "pairing_id", "group_no", F.array_join("source_indices", ",").alias("source_indices"), F.array_join("target_indices", ",").alias("target_indices"),
        F.sha2(F.concat_ws("\u001f", "source_text", "target_text"), 256).alias("h"), F.floor(F.col("confidence") * 1000 + 1e-6).alias("confidence_milli"), "content_hash",
    )


@register()
def align_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as books; neighbours of a source as pairings of its library."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.col("source").alias("library_id"))
    at = numbered(docs, "library_id", ["book_id"], "n").withColumn("position", F.col("n") - 1 - (F.col("n") - 1) % 2)
    pairs = at.groupBy("library_id", "position").agg(F.min_by("book_id", "n").alias("source_book_id"), F.max_by("book_id", "n").alias("target_book_id"), F.count("*").alias("books"))
    specs = pairs.where("books = 2").drop("books")
    libraries = docs.select("library_id").distinct().select("library_id", F.lit("building").alias("status"), F.lit(True).alias("rights_confirmed"))
    blocks = lines(spark, sf_dir).select(F.col("doc_id").alias("book_id"), F.lit(0).alias("section_ordinal"), "ordinal", F.col("text").alias("source_text"))
    accepted, review = align.align_libraries(libraries, specs, blocks)
    return accepted.withColumn("review", F.lit(False)).unionByName(review.withColumn("review", F.lit(True)))



def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("library_id"), "doc_id", ((F.col("n_chars") % 1000) / 1000.0).alias("confidence"))


@register("SELECT source AS library_id, CASE WHEN bool_or((n_chars % 1000) / 1000.0 < 0.64) THEN 'review_required' ELSE 'ready' END AS status FROM documents GROUP BY 1")
def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.review_flags(_aligned(spark, sf_dir))


@register("SELECT doc_id, source AS library_id, (n_chars % 1000) / 1000.0 < 0.64 AS review, bool_or((n_chars % 1000) / 1000.0 >= 0.64) OVER (PARTITION BY source) AS pairings FROM documents")
def library_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, review, replace = library.library_updates(_aligned(spark, sf_dir))
    rows = accepted.withColumn("review", F.lit(False)).unionByName(review.withColumn("review", F.lit(True)))
    return rows.join(replace, "library_id").select("doc_id", "library_id", "review", "pairings")


@register(
    """WITH l AS (SELECT source AS library_id, min(lang) AS locale FROM documents GROUP BY 1), p AS (SELECT doc_id AS project_id, lang AS target_locale, unnest([source, 'src' || (doc_id % 40)]) AS library_id FROM documents)
SELECT project_id, p.library_id, CASE WHEN locale IS NULL THEN 'NOT_FOUND' WHEN locale <> target_locale THEN 'VALIDATION_ERROR' ELSE 'ok' END AS code FROM p LEFT JOIN l USING (library_id)"""
)
def project_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    libraries = docs.groupBy(F.col("source").alias("library_id")).agg(F.min("lang").alias("target_locale"))
    projects = docs.select(F.col("doc_id").alias("project_id"), F.col("lang").alias("target_locale"), F.array("source", F.concat(F.lit("src"), F.col("doc_id") % 40)).alias("selected_library_ids"))
    ok, rejects = library.project_libraries(projects, libraries)
    return ok.withColumn("code", F.lit("ok")).unionByName(rejects.withColumnRenamed("error_code", "code"))


@register(
    """SELECT c.conv_id AS spec, len(string_split(a.text, chr(10)))::INT AS n_source, CASE WHEN b.text IS NULL THEN -1 ELSE len(string_split(b.text, chr(10))) END::INT AS n_target
FROM (SELECT DISTINCT conv_id FROM conversations) c JOIN documents a ON a.doc_id = c.conv_id LEFT JOIN documents b ON b.doc_id = c.conv_id * 3"""
)
def library_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("upload_id"), F.split("text", "\n").alias("paragraphs"))
    specs = table(spark, sf_dir, "conversations").select("conv_id").distinct().select(F.col("conv_id").alias("spec"), F.col("conv_id").alias("source_upload_id"), (F.col("conv_id") * 3).alias("target_upload_id"))
    rows = library.library_documents(specs, docs).where("source_paragraphs is not null")
    return rows.select("spec", F.size("source_paragraphs").alias("n_source"), F.coalesce(F.size("target_paragraphs"), F.lit(-1)).alias("n_target"))


@register("SELECT doc_id AS library_id FROM documents JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) USING (doc_id) WHERE q = 1 AND n_chars % 2 = 0")
def building_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rights = _rights(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("library_id"), F.when(F.col("n_chars") % 2 == 0, "building").otherwise("ready").alias("status")), "library_id")
    return library.building_libraries(rights).select("library_id")


@register("SELECT doc_id, 'book_' || substring(sha256(to_json([doc_id::VARCHAR])::VARCHAR), 1, 24) AS id FROM documents")
def book_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", stable_identifier("book", F.col("doc_id")).alias("id"))


QUERIES, ORACLE_SQL = register, register.sql
