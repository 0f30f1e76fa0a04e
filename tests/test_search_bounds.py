"""Search by upper bounds: the rows of a search that scores every pair, for a small part of the work."""

import math
import random

import pytest
from pyspark.sql import functions as F

from booktext_spark.operators import search

PAIRS = "pair_id bigint, library_id string, target_locale string, source_text string, target_text string, priority int, external_allowed boolean"
QUERIES = "query_id bigint, target_locale string, text string, library_ids array<string>"


def corpus(seed, number, words=400):
    """Texts of frequent and rare words, of very different lengths."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9))) for _ in range(words)]
    weights = [1 / (k + 1) for k in range(words)]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 5, 20, 60]))) for _ in range(number)]


def plain(spark, queries, pairs, wanted, external_only=True):
    """{query: [(pair, matched, score)]} by a walk over all pairs."""
    rows = search.index_rows(pairs).collect()
    asked = {}
    for r in search.query_tokens(queries).collect():
        asked.setdefault(r.query_id, (r.target_locale, r.library_ids, set()))[2].add(r.token)
    df = {}
    for r in rows:
        for t in r.tokens:
            df[t] = df.get(t, 0) + 1
    mean = sum(r.n_tokens for r in rows) / len(rows)
    idf = {t: math.log((len(rows) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    idf = {t: x if x > 0 else search.LEAST_IDF for t, x in idf.items()}
    out = {}
    for q, (locale, libraries, tokens) in asked.items():
        found = []
        for r in rows:
            common = tokens & set(r.tokens)
            if not common or r.target_locale != locale or libraries and r.library_id not in libraries or external_only and not r.external_allowed:
                continue
            score = sum(idf[t] for t in common) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * r.n_tokens / mean))
            found.append((-math.inf if r.priority is None else -r.priority, -round(score, 9), r.pair_id, len(common), score))
        found.sort()
        if found:
            out[q] = [(p, m, pytest.approx(s)) for _, _, p, m, s in found[:wanted]]
    return out


@pytest.mark.parametrize("kind", ["one priority", "few of the first", "null priorities", "libraries", "many of the first"])
def test_rows_are_those_of_a_walk_over_all_pairs(spark, kind):
    rng = random.Random(kind)
    texts = corpus(1, 420)
    first = {"one priority": lambda i: 20, "few of the first": lambda i: 9 if i % 60 == 0 else i % 3, "null priorities": lambda i: None if i % 4 == 0 else i % 2, "libraries": lambda i: 5 - i % 5, "many of the first": lambda i: 7 if i % 2 else 1}[kind]
    rows = [(i, f"lib{i % 5}", "zh-CN" if i % 7 else "zh-TW", t, "x", first(i), i % 11 > 0) for i, t in enumerate(texts)]
    rows += [(1000 + i, "lib1", "zh-CN", t, None, 1, True) for i, t in enumerate(["", None, "!?"])]
    asked = [(i, "zh-CN", t, rng.choice([None, [], ["lib1"], ["lib2", "lib3", "none"]]) if kind == "libraries" else None) for i, t in enumerate(corpus(2, 14) + texts[:4])]
    asked += [(50, "zh-TW", texts[0], None), (51, "xx", texts[0], None), (52, "zh-CN", "", None), (53, "zh-CN", "qqqqqqq", None)]
    pairs, queries = spark.createDataFrame(rows, PAIRS), spark.createDataFrame(asked, QUERIES)
    got = {}
    for r in search.ranked(queries, pairs).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append((r.pair_id, r.matched, r.bm25))
    assert got == plain(spark, queries, pairs, 32)


def test_few_pairs_are_scored_in_full(spark):
    texts = corpus(5, 3000, 1500)
    pairs = spark.createDataFrame([(i, "lib", "zh-CN", t, "x", 1, True) for i, t in enumerate(texts)], PAIRS)
    queries = spark.createDataFrame([(i, "zh-CN", t, None) for i, t in enumerate(corpus(6, 20, 1500) + texts[:20])], QUERIES)
    index = search.indexed(pairs)
    for weighed, scale, most in search.weighed_queries(queries, index):
        every = search.candidate_join(F.broadcast(weighed), index).select("query_id", "pair_id").distinct().count()
        left = search.surviving(weighed, search.query_lists(weighed), index, scale, most, 32)
        assert left.count() < every / 10


def test_no_pairs_and_no_queries(spark):
    pairs, queries = spark.createDataFrame([], PAIRS), spark.createDataFrame([(1, "zh-CN", "some text", None)], QUERIES)
    assert search.ranked(queries, pairs).collect() == []
    assert search.ranked(queries.limit(0), spark.createDataFrame([(1, "l", "zh-CN", "some text", "x", 1, True)], PAIRS)).collect() == []
