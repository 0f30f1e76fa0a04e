"""The registered queries of the training-data operators: each applies its operator to whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from booktext_spark.llm import ann, chat, crosstok, decontam, lattice, packing, repeats, runs, shards, simhash, tokenbin, toxicity, urls
from booktext_spark.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = decontam.hit_words()
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn_lexicon(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    scored = toxicity.score_toxicity(docs, lexicon, score_col="score").select("doc_id", held_out.alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024, 0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.sha256_of_kept(repeats.find_repeats(table(spark, sf_dir, "documents"), 200))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return lattice.score_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), held_out)


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.with_crc(tokenbin.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    back = chat.read_back(chat.format_conversations(rows, public_tokenizers.path("byte_bpe_50k.json")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), 50, 5, exact=True)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.align_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: rows of which one in ten, by the checksum of the id, repeats a period of words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10), F.size("w")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"), g.alias("g"))
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int")).withColumn("p", F.expr("cast(1 + (size(w) - a) div (3 + g % 8) as int)"))
    tail = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), cast((size(w) - a) div p as int) + 1)), 1, size(w) - a)")
    return rows.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(F.concat(F.expr("slice(w, 1, a)"), tail), " ")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(with_planted_runs(table(spark, sf_dir, "documents")), 6, 4)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    rows = found.withColumn("best", best).withColumn("lines", F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")))
    length, period = F.col("best.length"), -F.col("best.col3")
    return rows.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.col2")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"), 16, ("lang", "source", "size"), 5)


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_toxicity, op3_packing, op4_simhash, op5_suffix_dedup, op6_url_filter, op7_lm_scoring, op8_token_binary, op9_chat_format, op10_ann, op11_token_alignment, op12_periodic_runs, op13_sharding)}

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ESCAPED = r"regexp_replace(replace(coalesce({c}, ''), '\', '\\'), '<(/?turn>)', '\\<\1', 'g')"

#: Unsigned CRC-32 of a list of bytes that follows 4294967295.
CRC_TABLE = """tab AS (SELECT 0 AS k, i::BIGINT AS i, i::BIGINT AS c FROM range(256) t(i) UNION ALL SELECT k + 1, i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM tab WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS t FROM tab WHERE k = 8)"""
CRC_STEP = "lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])"
#: One level of the curve after another, from the highest bit: state, and place so far.
CURVE = "\n".join(
    f"k{level} AS (SELECT * EXCLUDE (s, h, f), f >> 3 AS s, h * 8 + (f & 7) AS h FROM (SELECT *, tb[s * 8 + (((c2 >> {level}) & 1) * 4 + ((c1 >> {level}) & 1) * 2 + ((c0 >> {level}) & 1)) + 1] AS f FROM k{level + 1})),"
    for level in range(4, -1, -1)
)

#: The operators whose results SQL can state; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS id, {WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT id, n, array_to_string(w[k + 1 : k + n], ' ') AS g FROM (SELECT id, w, least(len(w), 13) AS n, unnest(range(greatest(len(w) - 12, least(len(w), 1)))) AS k FROM b)),
p AS (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
m AS (SELECT doc_id, k, n, id FROM (SELECT doc_id, k, n, array_to_string(w[k + 1 : k + n], ' ') AS g FROM p) JOIN win USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT at_word) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS at_word FROM m) GROUP BY 1),
i AS (SELECT doc_id, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM m GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op9_chat_format": f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({ESCAPED.format(c="role")}) + length({ESCAPED.format(c="text")}) + 15)::BIGINT AS formatted_chars FROM c GROUP BY 1""",
    "op13_sharding": f"""WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, lang, source, strlen(coalesce(text, ''))::BIGINT + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS l FROM documents),
k5 AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_concat([4294967295], l), {CRC_STEP}))::BIGINT AS text_crc32, 0::BIGINT AS s, 0::BIGINT AS h, {shards.hilbert_table(3)} AS tb, count(*) OVER () AS n,
  (rank() OVER (ORDER BY lang NULLS FIRST) - 1) * 32 // count(*) OVER () AS c0, (rank() OVER (ORDER BY source NULLS FIRST) - 1) * 32 // count(*) OVER () AS c1, (rank() OVER (ORDER BY size NULLS FIRST) - 1) * 32 // count(*) OVER () AS c2 FROM d, crcs),
{CURVE}
r AS (SELECT *, row_number() OVER (ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 1 AS place FROM k0)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * 16 // n)::INT AS shard, row_number() OVER (PARTITION BY place * 16 // n ORDER BY place) - 1 AS slot, NULL::INT AS grown_shard, h AS curve FROM r""",
    "op12_periodic_runs": f"""WITH RECURSIVE {CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
  xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), {CRC_STEP})) AS h FROM documents, crcs),
g AS (SELECT r, doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN h // 10 % len(w) END AS a, h // 10 AS g FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
o AS (SELECT r, n, w, a, p, unnest(range(n)) AS i FROM p),
t AS (SELECT r, n, i, w[1 + CASE WHEN i < a OR a IS NULL THEN i ELSE a + (i - a) % p END] AS x FROM o),
m AS (SELECT a.r, a.i, b.i - a.i AS q FROM t a JOIN t b ON a.r = b.r AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
s AS (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m),
l AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY r, q, island HAVING count(*) >= 3 * q AND count(*) + q >= 6),
u AS (SELECT r, start, length, min(q) AS q FROM l GROUP BY ALL),
gone AS (SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM u),
c AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS text FROM t ANTI JOIN gone USING (r, i) GROUP BY 1),
e AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines, max({{'length': length, 'start': -start, 'q': -q}}) AS best FROM u GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, -best.start AS start, best.length AS length, -best.q AS period, 1000 * best.length // -best.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(c.text, '')) AS collapsed_sha256 FROM p LEFT JOIN e USING (r) LEFT JOIN c USING (r)""",
}
