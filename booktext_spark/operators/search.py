"""BM25 retrieval of reference pairs over n-gram postings."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from booktext_spark.functions.text import nfkc, search_tokens
from booktext_spark.storage import kept, shared_dir

#: The usual BM25 constants, the least inverse document frequency, query tokens, ranked candidates for each wanted row.
K1, B, LEAST_IDF, MAX_TOKENS, PER_WANTED, LEAST_RANKED, MOST_WANTED = 1.2, 0.75, 1e-6, 96, 8, 24, 4
#: Query tokens and queries that are broadcast at once.
TOKENS_AT_ONCE, QUERIES_AT_ONCE = 1 << 20, 1 << 14
#: Postings of a query's rarest tokens that are looked at for its bound, for each wanted row; and what a bound is lowered by, for sums in another order.
SEEDS, SLACK = 64, 1e-6
#: Share of the bound that common tokens, which are looked for last, may reach together.
SPARE = 0.5


def with_tokens(df: DataFrame, text_col: str) -> DataFrame:
    """df with the search tokens of a text in place of the text; null is empty and has none."""
    return df.withColumn(text_col, nfkc(F.coalesce(text_col, F.lit("")))).withColumn("tokens", search_tokens(F.col(text_col))).drop(text_col)


def postings(pairs: DataFrame) -> DataFrame:
    """pair_id, token, n_tokens for each token of the source side; a pair without tokens has no row."""
    tokens = with_tokens(pairs.select("pair_id", "source_text"), "source_text")
    return tokens.select("pair_id", F.size("tokens").alias("n_tokens"), F.explode("tokens").alias("token"))


def index_rows(pairs: DataFrame) -> DataFrame:
    """pair_id, library_id, target_locale, priority, external_allowed, tokens of the source side and their number."""
    rows = with_tokens(pairs.select("pair_id", "library_id", "target_locale", "priority", "external_allowed", "source_text"), "source_text")
    return rows.withColumn("n_tokens", F.size("tokens"))


def indexed(pairs: DataFrame) -> DataFrame:
    """index_rows, made once and kept by pair."""
    return by_pair(index_rows(pairs))


def by_pair(rows: DataFrame) -> DataFrame:
    """rows as a table in the shared folder with a bucket of pair_id for each shuffle partition, so that what is found in a pair joins its tokens where they are."""
    spark = rows.sparkSession
    name, buckets = f"search_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(buckets, "pair_id").write.bucketBy(buckets, "pair_id").format("parquet")
    dealt.option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def corpus_stats(posted: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, df; one row with n_pairs and mean_tokens), over the whole index, before any filter."""
    frequency = posted.groupBy("token").agg(F.count("*").alias("df"))
    whole = pairs.agg(F.count("*").alias("n_pairs")).crossJoin(posted.agg(F.count("*").alias("n_postings")))  # one row each
    return frequency, whole.select("n_pairs", (F.col("n_postings") / F.greatest("n_pairs", F.lit(1))).alias("mean_tokens"))


def query_tokens(queries: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """The first distinct tokens of each query, a row each."""
    return with_tokens(queries, "text").withColumn("token", F.explode(F.slice("tokens", 1, max_tokens))).drop("tokens")


def candidate_join(asked: DataFrame, index: DataFrame, external_only: bool = True) -> DataFrame:
    """Pairs that share a token with a query, of its locale, of libraries it names (any if null or empty), and allowed outside: a row for each shared token.

    asked comes from query_tokens, index from indexed. Pairs that are not allowed go before their tokens are looked at. Where asked is
    broadcast, the tokens of a pair are looked up where the pair is, and no posting is shuffled.
    """
    rows = index.where("external_allowed") if external_only else index
    met = rows.select("pair_id", F.col("target_locale").alias("__locale"), F.col("library_id").alias("__library"), "priority", "n_tokens", F.explode("tokens").alias("token")).join(asked, "token").where("target_locale = __locale")
    if "library_ids" in asked.columns:
        ids = F.col("library_ids")
        met = met.where(ids.isNull() | (F.size(ids) == 0) | F.array_contains(ids, F.col("__library")))
    return met.drop("__locale", "__library")


def query_bounds(weighed: DataFrame, asked: DataFrame, index: DataFrame, scale: Column, wanted: int, external_only: bool) -> DataFrame:
    """A row for each query: query_id, the priority that its best pairs have (`free`: it is null), a score that `wanted` of these reach, and
    whether there are so many; without so many, nothing bounds its other pairs.

    The seeds are pairs that hold one of a query's rarest tokens; the best `wanted` of them by these tokens are scored with all.
    """
    rarest = Window.partitionBy("query_id").orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)
    seeds = weighed.withColumn("before", F.coalesce(F.sum("df").over(rarest), F.lit(0))).where(F.col("before") < SEEDS * wanted)
    top = _highest(weighed, index, external_only)
    met = candidate_join(F.broadcast(seeds), index, external_only)
    part = met.groupBy("query_id", "pair_id").agg(F.first("priority").alias("priority"), (F.sum("idf") * F.first(scale)).alias("part"))
    part = part.join(F.broadcast(top), "query_id").where((F.col("priority").isNull() == F.col("free")) & F.col("priority").eqNullSafe(F.col("top")))
    whole = scored(F.broadcast(_best_parts(part, wanted)), index, asked, scale)
    reached = whole.groupBy("query_id").agg(F.min("bm25").alias("reached"), F.count("*").alias("seeds"))
    bound = (F.coalesce("seeds", F.lit(0)) >= wanted) & (F.col("reached") > 2 * SLACK)
    return top.join(reached, "query_id", "left").select("query_id", "free", "top", bound.alias("bounded"), (F.col("reached") - SLACK).alias("least"))


def _best_parts(part: DataFrame, wanted: int) -> DataFrame:
    """The `wanted` pairs of each query with the largest sum so far; at most that many rows for each of QUERIES_AT_ONCE."""
    order = Window.partitionBy("query_id").orderBy(F.desc("part"), "pair_id")
    return part.withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted).select("query_id", "pair_id", "priority")


def _highest(asked: DataFrame, index: DataFrame, external_only: bool) -> DataFrame:
    """query_id, free, top: the first priority among the pairs that each query may have; null goes first."""
    rows = index.where("external_allowed") if external_only else index
    level = F.max(F.struct(F.col("priority").isNull().alias("free"), F.col("priority").alias("top")))
    libraries = rows.groupBy(F.col("target_locale").alias("locale"), F.col("library_id").alias("library")).agg(level.alias("level"))
    any_of = libraries.groupBy("locale").agg(F.max("level").alias("level"))
    asked = asked.select("query_id", "target_locale", *(["library_ids"] if "library_ids" in asked.columns else [])).dropDuplicates(["query_id"])
    if "library_ids" not in asked.columns:
        found = asked.join(any_of, F.col("target_locale") == F.col("locale"))
    else:
        free = asked.where(F.col("library_ids").isNull() | (F.size("library_ids") == 0)).join(any_of, F.col("target_locale") == F.col("locale")).select("query_id", "level")
        named = asked.select("query_id", "target_locale", F.explode("library_ids").alias("named"))
        named = named.join(libraries, (F.col("target_locale") == F.col("locale")) & (F.col("named") == F.col("library"))).select("query_id", "level")
        found = free.unionByName(named)
    return found.groupBy("query_id").agg(F.max("level").alias("level")).select("query_id", "level.free", "level.top")


def essential_tokens(weighed: DataFrame, bounds: DataFrame, most: float) -> DataFrame:
    """weighed tokens without the commonest of each query, which together stay below SPARE of its bound in any pair; `rest` is their sum."""
    rows = weighed.join(bounds, "query_id")
    common = Window.partitionBy("query_id").orderBy("idf", "token").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("sum", F.sum("idf").over(common)).withColumn("spare", F.col("bounded") & (F.col("sum") * most < SPARE * F.col("least")))
    whole = Window.partitionBy("query_id")
    rest = F.coalesce(F.max(F.when(F.col("spare"), F.col("sum"))).over(whole), F.lit(0.0))
    return rows.withColumn("rest", rest).where("not spare").drop("sum", "spare", "df")


def candidates(essential: DataFrame, index: DataFrame, scale: Column, external_only: bool = True) -> DataFrame:
    """query_id, pair_id, priority, part, matched, rest: pairs that share an essential token and whose tokens could lift them to the query's bound.

    essential: broadcast by the caller's choice of size, see ranked. Where rest is 0, part times the pair's scale is the whole score.
    """
    met = candidate_join(F.broadcast(essential), index, external_only)
    met = met.where(~F.col("bounded") | ((F.col("priority").isNull() == F.col("free")) & F.col("priority").eqNullSafe(F.col("top"))))
    first = {c: F.first(c).alias(c) for c in ("priority", "rest", "bounded", "least")}
    sums = met.groupBy("query_id", "pair_id").agg(*first.values(), F.first(scale).alias("scale"), F.sum("idf").alias("part"), F.count("*").alias("matched"))
    return sums.where(~F.col("bounded") | ((F.col("part") + F.col("rest")) * F.col("scale") >= F.col("least")))


def query_lists(weighed: DataFrame) -> DataFrame:
    """query_id, asked (its tokens, at most max_tokens), idf (a map of these)."""
    return weighed.groupBy("query_id").agg(F.collect_list("token").alias("asked"), F.map_from_entries(F.collect_list(F.struct("token", "idf"))).alias("idf"))


def scored(found: DataFrame, index: DataFrame, asked: DataFrame, scale: Column) -> DataFrame:
    """query_id, pair_id, priority, bm25, matched of found(query_id, pair_id, priority): all tokens that the query and the pair share.

    asked: query_lists of the queries. found is by pair, as candidates gives it, or broadcast; so no token array moves.
    """
    rows = found.select("query_id", "pair_id", "priority").join(index.select("pair_id", "tokens", "n_tokens"), "pair_id").join(F.broadcast(asked), "query_id")
    rows = rows.withColumn("common", F.array_intersect("asked", "tokens"))
    total = F.aggregate("common", F.lit(0.0), lambda a, t: a + F.element_at(F.col("idf"), t))
    return rows.select("query_id", "pair_id", "priority", (total * scale).alias("bm25"), F.size("common").cast("bigint").alias("matched"))


def ranked(queries: DataFrame, pairs: DataFrame, limit: int = 4, max_tokens: int = MAX_TOKENS, external_only: bool = True, k1: float = K1, b: float = B, index: DataFrame | None = None) -> DataFrame:
    """query_id, position, pair_id, priority, bm25 (larger is better), matched: the ranked candidates of each query.

    Query tokens are broadcast, TOKENS_AT_ONCE at a time. The index is dealt out by pair, so a pair's score is summed where its tokens
    are. Larger priorities go first (null before all), then larger scores as rounded to nine places, then smaller pair ids.

    Upper bounds spare most of the work, without loss: a few pairs that hold a query's rarest tokens are scored first (query_bounds) and say
    what score a pair must reach. The commonest tokens of a query, which cannot reach it even together, are not looked for; of pairs that hold
    others, those go whose sum, with all common tokens added, stays below; the best of what is left raise the bound (surviving), and only pairs
    that still may reach it are scored with all tokens. Queries of which too few pairs of the highest priority were met are scored in full. Queries without tokens give no rows. index: index_rows of all pairs where they are
    stored, as append_new_pairs does; else they are made.
    """
    index = indexed(pairs) if index is None else by_pair(index)
    wanted = max(PER_WANTED * min(max(limit, 0), MOST_WANTED), LEAST_RANKED)
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_first("priority"), F.desc(F.round("bm25", 9)), F.asc("pair_id"))
    out = None
    for weighed, scale, most in weighed_queries(queries, index, max_tokens, k1, b):
        asked = kept(query_lists(weighed))
        found = surviving(weighed, asked, index, scale, most, wanted, external_only)
        lean = scored(found.where("rest > 0"), index, asked, scale)
        full = found.where("rest = 0").select("query_id", "pair_id", "priority", (F.col("part") * F.col("scale")).alias("bm25"), "matched")
        for df in (lean, full):
            best = df.withColumn("position", F.row_number().over(order)).where(F.col("position") <= wanted)
            out = best if out is None else out.unionByName(best)
    return out.select("query_id", "position", "pair_id", "priority", "bm25", "matched")


def surviving(weighed: DataFrame, asked: DataFrame, index: DataFrame, scale: Column, most: float, wanted: int, external_only: bool = True) -> DataFrame:
    """candidates of the queries that are left when those with the largest sums are scored in full and have raised the bounds."""
    bounds = kept(query_bounds(weighed, asked, index, scale, wanted, external_only))
    essential = kept(essential_tokens(weighed, bounds, most))
    found = by_pair(candidates(essential, index, scale, external_only))
    parts = found.where("rest > 0").withColumn("part", F.col("part") * F.col("scale"))
    best = scored(F.broadcast(_best_parts(parts, wanted)), index, asked, scale).groupBy("query_id").agg((F.min("bm25") - SLACK).alias("raised"), F.count("*").alias("seeds"))
    raised = kept(best.where(F.col("seeds") >= wanted).select("query_id", "raised"))
    rows = found.join(F.broadcast(raised), "query_id", "left")
    return rows.where(F.col("raised").isNull() | ((F.col("part") + F.col("rest")) * F.col("scale") >= F.col("raised"))).drop("raised")


def weighed_queries(queries: DataFrame, index: DataFrame, max_tokens: int = MAX_TOKENS, k1: float = K1, b: float = B) -> Iterator[tuple[DataFrame, Column, float]]:
    """(tokens with df and idf, a pair's scale by its number of tokens, the largest scale) of so many queries as are broadcast at once."""
    asked = kept(query_tokens(queries, max_tokens))
    whole = index.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.min(F.when(F.col("n_tokens") > 0, F.col("n_tokens"))).alias("fewest")).first()
    mean = whole.tokens / max(whole.n, 1) or 1.0
    scale = F.lit(k1 + 1) / (1 + k1 * (1 - b + b * F.col("n_tokens") / mean))
    most = (k1 + 1) / (1 + k1 * (1 - b + b * (whole.fewest or 1) / mean))
    counts = asked.agg(F.count("*").alias("tokens"), F.count_distinct("query_id").alias("queries")).first()
    parts = max(1, -(-counts.tokens // TOKENS_AT_ONCE), -(-counts.queries // QUERIES_AT_ONCE))
    for part in range(parts):
        some = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        posted = index.select(F.explode("tokens").alias("token"))
        frequency = posted.join(F.broadcast(some.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
        idf = F.log((whole.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        yield kept(some.join(frequency, "token").withColumn("idf", F.when(idf <= 0, LEAST_IDF).otherwise(idf))), scale, most


def search_references(queries: DataFrame, pairs: DataFrame, limit: int = 4, max_tokens: int = MAX_TOKENS, external_only: bool = True, k1: float = K1, b: float = B, side: int = 300, total: int = 2400, index: DataFrame | None = None) -> DataFrame:
    """The references of each query within the budget: query_id, position, pair_id, library_id, source_text, target_text, priority, score.

    queries: query_id, target_locale, text and perhaps library_ids; pairs: pair_id, library_id, target_locale, source_text,
    target_text, priority, external_allowed. Queries without tokens, and limit 0, give no rows. index: see ranked.
    """
    limit = min(max(limit, 0), MOST_WANTED)
    found = ranked(queries, pairs, limit, max_tokens, external_only, k1, b, index)
    texts = pairs.select("pair_id", "library_id", "source_text", "target_text")
    rows = found.join(texts, "pair_id").withColumn("score", F.col("priority") * 1000.0 + F.col("bm25"))
    return fill_budget(rows, limit, side, total)


def fill_budget(candidates: DataFrame, limit: int = 4, side: int = 300, total: int = 2400) -> DataFrame:
    """Walks each query's candidates in order until `limit` are taken or `total` characters are used.

    Sides are cut to `side`; where both do not fit, first the source and then the target is cut to what is left; a
    pair without text takes no place.
    """
    cut = lambda c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, side)
    item = F.struct("position", "pair_id", "library_id", cut("source_text").alias("source_text"), cut("target_text").alias("target_text"), "priority", "score")
    lists = candidates.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("items"))  # at most the ranked candidates
    kind = "struct<used:int,taken:array<struct<position:int,pair_id:{p},library_id:{l},source_text:string,target_text:string,priority:{r},score:double>>>".format(
        p=candidates.schema["pair_id"].dataType.simpleString(), l=candidates.schema["library_id"].dataType.simpleString(), r=candidates.schema["priority"].dataType.simpleString()
    )
    start = F.struct(F.lit(0).alias("used"), F.array().alias("taken")).cast(kind)

    def step(state, x):
        left = F.lit(total) - state["used"]
        source = F.substr(x["source_text"], F.lit(1), F.least(F.length(x["source_text"]), left))
        target = F.substr(x["target_text"], F.lit(1), F.greatest(F.least(F.length(x["target_text"]), left - F.length(source)), F.lit(0)))
        size = F.length(source) + F.length(target)
        one = F.struct((F.size(state["taken"]) + 1).alias("position"), x["pair_id"].alias("pair_id"), x["library_id"].alias("library_id"), source.alias("source_text"), target.alias("target_text"), x["priority"].alias("priority"), x["score"].alias("score"))
        more = F.struct((state["used"] + size).alias("used"), F.concat(state["taken"], F.array(one)).alias("taken")).cast(kind)
        return F.when((F.size(state["taken"]) >= limit) | (left <= 0) | (size == 0), state).otherwise(more)

    return lists.select("query_id", F.explode(F.aggregate("items", start, step)["taken"]).alias("r")).select("query_id", "r.*")
