"""Queries of text columns, identities, text sources and copying."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from booktext_spark.functions import ids
from booktext_spark.functions import text as T
from booktext_spark.operators import copying, editions, search, uploads
from booktext_spark.plans.base import LINES_SQL, Register, lines, table
from booktext_spark.sources import epub, files
from booktext_spark.storage import shared_dir

register = Register()
CANONICAL = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
GRAMS = "list_distinct(list_transform(range(1, length({t}) - {n} + 2), lambda i: substring({t}, i, {n})))"
COPYING = r"regexp_replace(lower({t}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


@register(f"SELECT doc_id, length({CANONICAL}) AS n, sha256({CANONICAL}) AS h FROM documents")
def canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.canonical_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(c).alias("n"), F.sha2(c, 256).alias("h"))


@register(f"SELECT item_id, sha256({CANONICAL}) AS h FROM benchmark")
def normalize_reference_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha2(T.normalize_reference_text(F.col("text")), 256).alias("h"))


@register(f"SELECT doc_id, length({COPYING.format(t='text')}) AS n, sha256({COPYING.format(t='text')}) AS h FROM documents")
def normalize_for_copying(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", T.normalize_for_copying(F.col("text")).alias("t"))
    return docs.select("doc_id", F.length("t").alias("n"), F.sha2("t", 256).alias("h"))


@register(
    f"""WITH {LINES_SQL}
SELECT doc_id, ordinal, length(regexp_replace(text, '\\s', '', 'g')) AS n,
  regexp_matches(trim(text), '^[「『“"]') AS opens, regexp_matches(trim(text), '[」』”"]$') AS closes,
  regexp_matches(trim(text), '[。！？!?]$') AS ends, regexp_matches(text, '[\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{9fff}}]') AS cjk
FROM lines"""
)
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    sign = T.dialogue_signature(c)
    return lines(spark, sf_dir).select("doc_id", "ordinal", T.normalized_length(c).alias("n"), sign["opens"].alias("opens"), sign["closes"].alias("closes"), T.ends_sentence(c).alias("ends"), T.contains_cjk(c).alias("cjk"))


@register(
    """WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN text || 'あ漢' WHEN 2 THEN chr(1) || text WHEN 3 THEN '\ufffd' || text ELSE text END AS t FROM documents),
v AS (SELECT *, regexp_replace(t, '\\s', '', 'g') AS visible FROM t)
SELECT doc_id, CASE WHEN visible = '' THEN 1000000 ELSE floor(1e6 * (length(visible) - length(regexp_replace(visible, '[\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}]', '', 'g'))) / length(visible) + 1e-6) END::BIGINT AS japanese,
  floor(1e6 * (doc_id % 4 = 2)::INT / greatest(length(t), 1) + 1e-6)::BIGINT AS control, floor(1e6 * (doc_id % 4 = 3)::INT / greatest(length(t), 1) + 1e-6)::BIGINT AS replacement FROM v""".replace("\\ufffd", "\ufffd")
)
def char_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, a fourth each with Japanese characters, a control character and U+FFFD added; shares in millionths."""
    way, text = F.col("doc_id") % 4, F.col("text")
    more = F.when(way == 1, F.concat(text, F.lit("あ漢"))).when(way == 2, F.concat(F.lit("\x01"), text)).when(way == 3, F.concat(F.lit("\ufffd"), text)).otherwise(text)
    rows = table(spark, sf_dir, "documents").select("doc_id", T.char_ratios(more).alias("r"))
    return rows.select("doc_id", *[F.floor(F.lit(1e6) * F.col(f"r.{c}") + 1e-6).alias(c) for c in ("japanese", "control", "replacement")])


@register(
    """WITH c AS (SELECT item_id, lower(text) AS t, regexp_replace(lower(text), '[\\s\\p{P}]', '', 'g') AS k FROM benchmark),
g AS (SELECT item_id, list_concat(list_concat(list_transform(range(1, length(k)), lambda i: substring(k, i, 2)),
  list_transform(range(1, length(k) - 1), lambda i: substring(k, i, 3))), regexp_extract_all(t, '[a-z0-9_]{2,}')) AS l FROM c),
d AS (SELECT item_id, token, min(pos) AS pos FROM (SELECT item_id, unnest(l) AS token, unnest(range(len(l))) AS pos FROM g) GROUP BY 1, 2)
SELECT item_id, count(*) AS n, sha256(string_agg(token, ' ' ORDER BY pos)) AS h FROM d GROUP BY 1"""
)
def search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.with_tokens(table(spark, sf_dir, "benchmark").select("item_id", "text"), "text")
    return rows.withColumnRenamed("tokens", "t").select("item_id", F.size("t").cast("bigint").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("h"))


@register(f"SELECT item_id, len({GRAMS.format(t='t', n=8)})::BIGINT AS n FROM (SELECT item_id, {COPYING.format(t='text')} AS t FROM benchmark)")
def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = copying.copying_texts(table(spark, sf_dir, "benchmark"), "item_id")
    return items.select(F.col("id").alias("item_id"), F.size(T.char_ngrams(F.col("text"))).cast("bigint").alias("n"))


MATCH_SQL = """WITH p AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS s, text AS t FROM conversations),
f AS (SELECT conv_id, turn, greatest(length(regexp_replace(s, '\\s', '', 'g')), 1) AS ls, greatest(length(regexp_replace(t, '\\s', '', 'g')), 1) AS lt,
  regexp_matches(trim(s), '^[「『“"]') = regexp_matches(trim(t), '^[「『“"]') AND regexp_matches(trim(s), '[」』”"]$') = regexp_matches(trim(t), '[」』”"]$') AS same,
  regexp_matches(trim(s), '[。！？!?]$') = regexp_matches(trim(t), '[。！？!?]$') AS ends FROM p WHERE s IS NOT NULL),
c AS (SELECT conv_id, turn, least(abs(ln(lt / greatest(0.72 * ls, 1.0))), 2.5) + CASE WHEN same THEN 0.0 ELSE 0.28 END + CASE WHEN ends THEN 0.0 ELSE 0.12 END AS cost FROM f)
SELECT conv_id, turn, floor(cost * 1000 + 1e-6)::BIGINT AS cost_milli, floor(exp(-cost) * 1000 + 1e-6)::BIGINT AS confidence_milli, exp(-cost) < 0.64 AS needs_review FROM c"""


@register(MATCH_SQL)
def match_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("s"), F.col("text").alias("t")).where("s is not null")
    rows = turns.select("conv_id", "turn", T.match_cost(F.col("s"), F.col("t")).alias("cost")).withColumn("c", T.confidence(F.col("cost")))
    return rows.select("conv_id", "turn", F.floor(F.col("cost") * 1000 + 1e-6).alias("cost_milli"), F.floor(F.col("c") * 1000 + 1e-6).alias("confidence_milli"), T.needs_review(F.col("c")).alias("needs_review"))


@register(f"""WITH {LINES_SQL} SELECT doc_id, ordinal, 'blk_' || substring(sha256(to_json([doc_id::VARCHAR, ordinal::VARCHAR, {CANONICAL}])::VARCHAR), 1, 24) AS id FROM lines""")
def stable_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "ordinal", ids.stable_identifier("blk", F.col("doc_id"), F.col("ordinal"), T.canonical_text(F.col("text"))).alias("id"))


PAIRS_SQL = """SELECT conv_id, turn, sha256('en' || chr(31) || trim(regexp_replace(s, '\\s+', ' ', 'g')) || chr(31) || trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS pair_hash,
  sha256(trim(s, ' ' || chr(9) || chr(10) || chr(13)) || chr(31) || trim(t, ' ' || chr(9) || chr(10) || chr(13))) AS alignment_hash
FROM (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS s, text AS t FROM conversations) WHERE s IS NOT NULL"""


@register(PAIRS_SQL)
def pair_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("s"), F.col("text").alias("t")).where("s is not null")
    return turns.select("conv_id", "turn", ids.pair_hash(F.col("s"), F.col("t"), F.lit("EN")).alias("pair_hash"), ids.alignment_hash(F.col("s"), F.col("t")).alias("alignment_hash"))


@register("SELECT page_id, sha256(html) AS h FROM pages")
def source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", ids.source_hash(F.encode("html", "UTF-8")).alias("h"))


def _text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"), F.lit(None).cast("string").alias("confirmed_encoding"))
    ok, _ = files.decode_text(docs)
    return ok


@register("SELECT doc_id, 'utf-8' AS encoding, sha256(text) AS h FROM documents WHERE text IS NOT NULL")
def decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_rows(spark, sf_dir).select("doc_id", "encoding", F.sha2("text", 256).alias("h"))


BLOCKS_SQL = f"""WITH b AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\\n+', ''), '\\n+$', '') AS body FROM documents),
p AS (SELECT doc_id, string_split_regex(body, '\\n+') AS parts FROM b),
r AS (SELECT doc_id, unnest(range(len(parts))) AS ordinal, unnest(parts) AS text FROM p)
SELECT 'book_' || substring(sha256(to_json([doc_id::VARCHAR])::VARCHAR), 1, 24) AS book_id, ordinal::INT AS ordinal,
  'blk_' || substring(sha256(to_json([doc_id::VARCHAR, 'txt:body', 'paragraph:' || ordinal, {CANONICAL}])::VARCHAR), 1, 24) AS stable_id, sha256(text) AS h FROM r"""


@register(BLOCKS_SQL)
def split_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = files.split_text_blocks(table(spark, sf_dir, "documents"), r"\n+", "doc_id")
    return blocks.select("book_id", "ordinal", "stable_id", F.sha2("source_text", 256).alias("h"))


@register("""SELECT 'book_' || substring(sha256(to_json([doc_id::VARCHAR])::VARCHAR), 1, 24) AS book_id, sha256(text) AS sha256, strlen(text)::BIGINT AS n_bytes FROM documents""")
def export_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = files.export_text(files.split_text_blocks(table(spark, sf_dir, "documents"), r"\n+", "doc_id"))
    return texts.select("book_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("n_bytes"))


@register(
    """SELECT doc_id AS export_id, 'book_' || substring(sha256(to_json([doc_id::VARCHAR])::VARCHAR), 1, 24) AS book_id, true AS valid, strlen(text)::INT AS n_bytes, sha256(text) AS sha256,
  coalesce(n, 0)::BIGINT AS omitted_non_text_assets FROM documents LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) ON conv_id = doc_id"""
)
def export_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    book = ids.stable_identifier("book", F.col("doc_id"))
    assets = table(spark, sf_dir, "conversations").select(ids.stable_identifier("book", F.col("conv_id")).alias("book_id"))
    exports = docs.select(F.col("doc_id").alias("export_id"), book.alias("book_id"), F.lit("txt").alias("format"))
    texts = files.export_text(files.split_text_blocks(docs, r"\n+", "doc_id"))
    return files.export_report(exports, texts, assets).drop("format").withColumn("omitted_non_text_assets", F.col("omitted_non_text_assets").cast("bigint"))


BOOK_JSON = "struct<book_id:string,title:string,sections:array<struct<ordinal:int,section_id:string,title:string,blocks:array<struct<ordinal:int,stable_id:string,kind:string,source_text:string,locator:string,metadata:string>>>>>"


@register(BLOCKS_SQL)
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nested JSON and back: the blocks as they were."""
    blocks = files.split_text_blocks(table(spark, sf_dir, "documents"), r"\n+", "doc_id")
    sections = blocks.select("book_id", "section_id", F.lit(0).alias("ordinal"), F.lit("").alias("title")).distinct()
    books = sections.select("book_id", "title")
    back = files.documents_from_json(files.documents_to_json(books, sections, blocks), BOOK_JSON)
    return back["blocks"].select("book_id", "ordinal", "stable_id", F.sha2("source_text", 256).alias("h"))


@register("""SELECT 'book_' || substring(sha256(to_json([doc_id::VARCHAR])::VARCHAR), 1, 24) AS book_id, 1::BIGINT AS n_sections, len(string_split_regex(regexp_replace(regexp_replace(text, '^\\n+', ''), '\\n+$', ''), '\\n+'))::BIGINT AS n_blocks FROM documents""")
def parse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editions.parse_counts(files.split_text_blocks(table(spark, sf_dir, "documents"), r"\n+", "doc_id"))


@register()
def html_section_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = epub.html_page_blocks(table(spark, sf_dir, "pages"))
    titles = editions.section_title(blocks.select(F.col("page_id").alias("section_id"), "ordinal", "kind", F.col("text").alias("source_text")))
    return titles.select(F.col("section_id").alias("page_id"), "title")


@register()
def html_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epub.html_page_blocks(table(spark, sf_dir, "pages"))


RULES = (("mail", r"[a-z0-9._]+@[a-z0-9]+\.[a-z]{2,}"), ("digits", r"\b[0-9]{8,}\b"), ("license", r"(?i)licen[sc]e"), ("key", r"(?i)(api|secret)[_-]?key"))


@register("\nUNION ALL\n".join(f"SELECT doc_id, '{n}' AS rule FROM documents WHERE strlen(text) <= 2000000 AND regexp_matches(text, '{p}')" for n, p in RULES))
def policy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads.policy_scan(table(spark, sf_dir, "documents"), RULES).select("doc_id", "rule")


TEXTS_SQL = f"""o AS (SELECT doc_id AS id, {COPYING.format(t="text")} AS t FROM documents), r AS (SELECT item_id AS id, {COPYING.format(t="text")} AS t FROM benchmark)"""
AUDIT_SQL = f"""WITH {TEXTS_SQL},
og AS (SELECT id, unnest(range(1, length(t) - 26)) AS i, t FROM o WHERE length(t) >= 28), rg AS (SELECT id, unnest(range(1, length(t) - 26)) AS j, t FROM r WHERE length(t) >= 28),
ok AS (SELECT id, i, substring(t, i, 28) AS g FROM og), rk AS (SELECT id, j, substring(t, j, 28) AS g FROM rg),
m AS (SELECT ok.id AS doc_id, rk.id AS item_id, i - j AS d, i FROM ok JOIN rk USING (g)),
s AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, d ORDER BY i) AS island FROM m),
l AS (SELECT doc_id, item_id, (max(n) + 27)::INT AS lcs FROM (SELECT doc_id, item_id, d, island, count(*) AS n FROM s GROUP BY ALL) GROUP BY ALL),
x AS (SELECT l.*, length(o.t) AS n, least(length(o.t), length(r.t)) AS shorter, len(list_intersect({GRAMS.format(t="o.t", n=8)}, {GRAMS.format(t="r.t", n=8)})) AS shared, len({GRAMS.format(t="o.t", n=8)}) AS size FROM l JOIN o ON o.id = doc_id JOIN r ON r.id = item_id)
SELECT doc_id, item_id, lcs, shared::BIGINT AS shared, size::BIGINT AS size, CASE WHEN n < 80 THEN lcs >= 28 AND lcs / shorter >= 0.58
  WHEN n < 200 THEN (lcs >= 42 AND lcs / shorter >= 0.40) OR shared / size >= 0.55 ELSE (lcs >= 64 AND lcs / shorter >= 0.30) OR shared / size >= 0.44 END AS suspicious FROM x"""


@register(AUDIT_SQL)
def copying_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against test items: every pair with a common run of 28 characters or more or a suspicious overlap, with its verdict."""
    found = copying.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")
    return found.where("lcs >= 28 or suspicious").select(F.col("output_id").alias("doc_id"), F.col("ref_id").alias("item_id"), "lcs", "shared", "size", "suspicious")


@register(
    f"""WITH {TEXTS_SQL}, og AS (SELECT id, unnest({GRAMS.format(t="t", n=8)}) AS g FROM o), rg AS (SELECT id, unnest({GRAMS.format(t="t", n=8)}) AS g FROM r)
SELECT og.id AS doc_id, rg.id AS item_id, count(*) AS shared FROM og JOIN rg USING (g) GROUP BY ALL"""
)
def copy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of document and item that shares an 8-gram, with the number of shared ones."""
    ours, theirs = copying.copying_texts(table(spark, sf_dir, "documents"), "doc_id"), copying.copying_texts(table(spark, sf_dir, "benchmark"), "item_id")
    return copying.copy_candidates(ours, theirs).select(F.col("output_id").alias("doc_id"), F.col("ref_id").alias("item_id"), "shared")


@register(
    f"""WITH {TEXTS_SQL}, ol AS (SELECT id, {GRAMS.format(t="t", n=8)} AS l FROM o), og AS (SELECT id, len(l) AS size, unnest(l) AS g FROM ol), rg AS (SELECT id, unnest({GRAMS.format(t="t", n=8)}) AS g FROM r),
m AS (SELECT og.id AS doc_id, rg.id AS item_id, any_value(size) AS size, count(*) AS shared FROM og JOIN rg USING (g) GROUP BY ALL)
SELECT doc_id, item_id, floor(shared / size * 1000000)::BIGINT AS millionths FROM m WHERE shared / size >= 0.02"""
)
def ngram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which a fiftieth of the document's 8-grams or more are the item's."""
    ours, theirs = copying.copying_texts(table(spark, sf_dir, "documents"), "doc_id"), copying.copying_texts(table(spark, sf_dir, "benchmark"), "item_id")
    rows = copying.ngram_overlap(copying.copy_candidates(ours, theirs)).where("overlap >= 0.02")
    return rows.select(F.col("output_id").alias("doc_id"), F.col("ref_id").alias("item_id"), F.floor(F.col("overlap") * 1000000).alias("millionths"))


@register(AUDIT_SQL.split("x AS (")[0].rstrip(",\n ") + "\nSELECT doc_id, item_id, lcs FROM l")
def longest_common_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest common run, 28 or more, by suffix automata of the items."""
    ours, theirs = copying.copying_texts(table(spark, sf_dir, "documents"), "doc_id"), copying.copying_texts(table(spark, sf_dir, "benchmark"), "item_id")
    return copying.longest_common_run(ours, theirs, 28).select(F.col("output_id").alias("doc_id"), F.col("ref_id").alias("item_id"), "lcs")


@register(
    f"""WITH {TEXTS_SQL}, rg AS (SELECT id, unnest({GRAMS.format(t="t", n=8)}) AS g FROM o)
SELECT og.id AS item_id, rg.id AS doc_id, floor(count(*) / any_value(size) * 1000000)::BIGINT AS millionths FROM (SELECT r.id, len(l) AS size, unnest(l) AS g FROM (SELECT id, {GRAMS.format(t="t", n=8)} AS l FROM r) r) og JOIN rg USING (g) GROUP BY ALL HAVING count(*) >= 0.44 * any_value(size)"""
)
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items of which 44 in 100 different 8-grams or more are a document's: a set-similarity join with documents as references."""
    ours, theirs = copying.copying_texts(table(spark, sf_dir, "benchmark"), "item_id"), copying.copying_texts(table(spark, sf_dir, "documents"), "doc_id")
    return copying.similar_pairs(ours, theirs).select(F.col("output_id").alias("item_id"), F.col("ref_id").alias("doc_id"), F.floor(F.col("overlap") * 1000000).alias("millionths"))


@register(
    f"""WITH {TEXTS_SQL}, ol AS (SELECT id, {GRAMS.format(t="t", n=8)} AS l FROM o), og AS (SELECT id, len(l) AS size, unnest(l) AS g FROM ol), rg AS (SELECT id, unnest({GRAMS.format(t="t", n=8)}) AS g FROM r)
SELECT og.id AS doc_id, rg.id AS item_id, floor(count(*) / any_value(size) * 1000000)::BIGINT AS millionths FROM og JOIN rg USING (g) GROUP BY ALL"""
)
def ngram_overlap_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlap of every pair that shares an 8-gram, however small its share."""
    ours, theirs = copying.copying_texts(table(spark, sf_dir, "documents"), "doc_id"), copying.copying_texts(table(spark, sf_dir, "benchmark"), "item_id")
    rows = copying.ngram_overlap(copying.copy_candidates(ours, theirs))
    return rows.select(F.col("output_id").alias("doc_id"), F.col("ref_id").alias("item_id"), F.floor(F.col("overlap") * 1000000).alias("millionths"))


RUNS_SQL = AUDIT_SQL.split("x AS (")[0].rstrip(",\n ") + "\nSELECT doc_id, item_id, lcs FROM l"


@register(RUNS_SQL.replace("length(t) - 26", "length(t) - 6").replace(">= 28", ">= 8").replace("substring(t, i, 28)", "substring(t, i, 8)").replace("substring(t, j, 28)", "substring(t, j, 8)").replace("max(n) + 27", "max(n) + 7"))
def longest_common_run_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest common run of every pair that shares an 8-gram, by suffix automata of the items."""
    ours, theirs = copying.copying_texts(table(spark, sf_dir, "documents"), "doc_id"), copying.copying_texts(table(spark, sf_dir, "benchmark"), "item_id")
    return copying.longest_common_run(ours, theirs).select(F.col("output_id").alias("doc_id"), F.col("ref_id").alias("item_id"), "lcs")


@register(BLOCKS_SQL)
def write_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of documents, written in two runs of which the second holds all: what is stored, each book once."""
    blocks = files.split_text_blocks(table(spark, sf_dir, "documents"), r"\n+", "doc_id")
    path = f"{shared_dir(spark)}/parsed-{uuid.uuid4().hex}"
    for part in (blocks.where(F.crc32("book_id") % 2 == 0), blocks):
        files.write_parsed({"blocks": part}, path)
    return files.read_parsed(spark, path, "blocks").select("book_id", "ordinal", "stable_id", F.sha2("source_text", 256).alias("h"))


@register(
    """SELECT source, 'txt' AS extension, (sum(strlen(coalesce(text, ''))) + count(*))::BIGINT AS n_bytes FROM documents GROUP BY 1
UNION ALL SELECT 'rejected', 'UNSUPPORTED_FORMAT', 0::BIGINT"""
)
def read_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files in a folder for each source, and a table of another format beside them: bytes that are read, and the rejects' code."""
    folder = f"{shared_dir(spark)}/books-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    docs.select("source", F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("source").text(f"{folder}/texts")
    docs.select("doc_id").write.parquet(f"{folder}/others")
    found, rejects = files.read_books(spark, folder)
    source = F.regexp_extract("path", "source=([^/]+)", 1)
    read = found.select(source.alias("source"), "extension", F.octet_length("content").cast("bigint").alias("n")).groupBy("source", "extension").agg(F.sum("n").alias("n_bytes"))
    return read.unionByName(rejects.select(F.lit("rejected").alias("source"), F.col("error_code").alias("extension"), F.lit(0).cast("bigint").alias("n_bytes")).distinct())


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as EPUB archives: each turn is a chapter, its role the heading and its text a paragraph."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def run(batches):
        import io
        import zipfile
        from html import escape

        import pyarrow as pa

        page = '<html xmlns="http://www.w3.org/1999/xhtml"><body>{}</body></html>'
        for batch in batches:
            out = []
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names = [f"t{t['turn']}" for t in turns]
                items = "".join(f'<item id="{n}" href="{n}.xhtml" media-type="application/xhtml+xml"/>' for n in names)
                links = "".join(f'<a href="{n}.xhtml#{n}">{escape(t["role"] or "")}</a>' for n, t in zip(names, turns, strict=True))
                parts = {
                    "META-INF/container.xml": '<container><rootfiles><rootfile full-path="book.opf"/></rootfiles></container>',
                    "book.opf": f'<package version="3.0"><metadata><title>{conv}</title><language>en</language></metadata><manifest>{items}'
                    f'<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/></manifest><spine>{"".join(f"<itemref idref={chr(34)}{n}{chr(34)}/>" for n in names)}</spine></package>',
                    "nav.xhtml": page.format(links),
                } | {f"{n}.xhtml": page.format(f"<h1>{escape(t['role'] or '')}</h1><p>{escape(t['text'] or '')}</p>") for n, t in zip(names, turns, strict=True)}
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as archive:
                    for name, text in parts.items():
                        archive.writestr(zipfile.ZipInfo(name), text)  # equal bytes whenever it is made
                out.append(data.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([f"{c}.epub" for c in batch.column(0).to_pylist()]), pa.array(out, pa.binary())], names=["path", "content"])

    return turns.mapInArrow(run, "path string, content binary")


TURNS_SQL = "t AS (SELECT conv_id, role, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS section, turn FROM conversations)"


@register(
    f"""WITH {TURNS_SQL} SELECT conv_id::VARCHAR AS title, section AS section_ordinal, 'heading' AS kind, sha256(role) AS h FROM t
UNION ALL SELECT conv_id::VARCHAR, section, 'paragraph', sha256(text) FROM t WHERE trim(text) <> ''"""
)
def read_epub(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = epub.read_epub(_archives(spark, sf_dir))
    return t["blocks"].join(t["books"].select("book_id", "title"), "book_id").select("title", "section_ordinal", "kind", F.sha2("source_text", 256).alias("h"))


@register(f"WITH {TURNS_SQL} SELECT conv_id::VARCHAR AS book, section AS toc_ordinal, role AS title, 't' || turn AS fragment, section AS section_ordinal FROM t")
def toc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = epub.read_epub(_archives(spark, sf_dir))
    rows = t["toc"].join(t["books"].select("book_id", F.col("title").alias("book")), "book_id").join(t["sections"].select("section_id", F.col("ordinal").alias("section_ordinal")), "section_id")
    return rows.select("book", "toc_ordinal", "title", "fragment", "section_ordinal")


def _turn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pages without end tags: roles are headings, texts are paragraphs and, every third, list items with ruby."""
    turn = table(spark, sf_dir, "conversations")
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.when(F.col("turn") % 3 == 2, F.concat(F.lit("<ul><li>"), text, F.lit("<li><ruby>b<rt>r</ruby>c</ul>"))).otherwise(F.concat(F.lit("<p>"), text, F.lit("<br>")))
    part = F.struct("turn", F.concat(F.lit("<h2>"), "role", F.lit("</h2>"), body).alias("html"))
    return turn.groupBy(F.col("conv_id").alias("page_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["html"]), "").alias("html"))


@register(
    """WITH b AS (SELECT conv_id AS page_id, turn, 0 AS k, 'heading' AS kind, role AS text FROM conversations
UNION ALL SELECT conv_id, turn, 1, CASE WHEN turn % 3 = 2 THEN 'list_item' ELSE 'paragraph' END, CASE WHEN turn % 3 = 2 THEN text ELSE text || chr(10) END FROM conversations WHERE trim(text) <> ''
UNION ALL SELECT conv_id, turn, 2, 'list_item', 'bc' FROM conversations WHERE turn % 3 = 2)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY turn, k) - 1)::INT AS ordinal, kind, sha256(text) AS h FROM b"""
)
def html_turn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epub.html_page_blocks(_turn_pages(spark, sf_dir)).select("page_id", "ordinal", "kind", F.sha2("text", 256).alias("h"))


@register("SELECT conv_id AS page_id, arg_min(role, turn) AS title FROM conversations GROUP BY 1")
def html_turn_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = epub.html_page_blocks(_turn_pages(spark, sf_dir))
    titles = editions.section_title(blocks.select(F.col("page_id").alias("section_id"), "ordinal", "kind", F.col("text").alias("source_text")))
    return titles.select(F.col("section_id").alias("page_id"), "title")


QUERIES, ORACLE_SQL = register, register.sql
