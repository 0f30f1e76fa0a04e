"""Registered queries on tables with rows that the driver's smallest tables do not have."""

import random
from collections import Counter

import pytest

from booktext_spark.functions.text import common_run
from booktext_spark.operators import search
from booktext_spark.plans import registry


def prose(n, seed):
    return "".join(random.Random(seed).choices("abcdefghijklmnopqrstuvwxyz", k=n))


@pytest.fixture
def put(spark, tmp_path):
    """Writes one table; returns the folder."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_audit_keeps_copies_with_an_edit_every_twenty_characters(spark, put):
    item = prose(400, 1)
    edited = "".join("0" if i % 20 == 19 else c for i, c in enumerate(item))
    put("documents", [(1, edited), (2, prose(400, 2))], "doc_id bigint, text string")
    found = registry.QUERIES["copying_audit"](spark, put("benchmark", [(7, item)], "item_id bigint, text string")).collect()
    assert [(r.doc_id, r.item_id, r.lcs, r.suspicious) for r in found] == [(1, 7, 19, True)]
    assert found[0].shared / found[0].size >= 0.44


def test_overlaps_and_runs_of_all_pairs_are_brute_force(spark, put):
    items = [(7, prose(60, 3)), (8, prose(40, 4))]
    docs = [(1, prose(5000, 5) + items[0][1] + prose(5000, 6)), (2, prose(300, 7) + items[1][1][5:16] + prose(200, 8)), (3, prose(100, 9) + items[1][1][:7])]
    put("documents", docs, "doc_id bigint, text string")
    sf = put("benchmark", items, "item_id bigint, text string")
    grams = lambda t: {t[i : i + 8] for i in range(len(t) - 7)}
    met = [(d, i, a, b) for d, a in docs for i, b in items if grams(a) & grams(b)]
    assert {(d, i) for d, i, *_ in met} == {(1, 7), (2, 8)}
    shares = {(d, i): len(grams(a) & grams(b)) * 1000000 // len(grams(a)) for d, i, a, b in met}
    assert 0 < shares[1, 7] < 20000
    assert {(r.doc_id, r.item_id): r.millionths for r in registry.QUERIES["ngram_overlap_all"](spark, sf).collect()} == shares
    runs = {(d, i): common_run(a, b) for d, i, a, b in met}
    assert 8 <= runs[2, 8] < 28
    assert {(r.doc_id, r.item_id): r.lcs for r in registry.QUERIES["longest_common_run_all"](spark, sf).collect()} == runs


def test_candidates_are_ranked_in_parts(spark, put, monkeypatch):
    """No list of all candidates of a query: each task keeps its best, and the outcome is that of one sort, for queries in parts too."""
    random.seed(3)
    said = [(c, t, "user", prose(12, random.randrange(40))) for c in range(60) for t in range(4)]
    put("conversations", said, "conv_id bigint, turn bigint, role string, text string")
    sf = put("benchmark", [(i, prose(12, i) + prose(12, i + 1)) for i in range(5)], "item_id bigint, text string")
    ranked = registry.QUERIES["ranked_references"](spark, sf)
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "WindowGroupLimit" in plan
    got = {tuple(r) for r in ranked.collect()}
    monkeypatch.setattr(search, "TOKENS_AT_ONCE", 40)
    monkeypatch.setattr(search, "LEAST_RANKED", 100_000)
    whole = registry.QUERIES["ranked_references"](spark, sf).collect()
    assert max(Counter(r.query_id for r in whole).values()) > 32
    by_query = {q: sorted((-r.milli, r.pair_id, r.matched) for r in whole if r.query_id == q)[:32] for q in {r.query_id for r in whole}}
    assert got == {(q, p, m, -s) for q, rows in by_query.items() for s, p, m in rows}


def test_long_conversations_and_documents_keep_their_rows_apart(spark, put):
    said = [(c, t, "user", prose(10, 2000 * c + t)) for c, n in ((0, 1100), (1, 60)) for t in range(n)]
    put("conversations", said, "conv_id bigint, turn bigint, role string, text string")
    put("benchmark", [(5, said[1049][3])], "item_id bigint, text string")
    documents = [(d, "\n".join(f"{d} {k}" for k in range(n)), "en", f"s{d}", 1) for d, n in ((0, 1100), (1, 120))]
    sf = put("documents", documents, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    pairs = registry.QUERIES["dedup_pairs"](spark, sf).collect()
    assert len(pairs) == len({r.pair_id for r in pairs}) == 1099 + 59
    ranked = registry.QUERIES["ranked_references"](spark, sf).collect()
    assert len(ranked) == len({r.pair_id for r in ranked}) and max(ranked, key=lambda r: r.milli).matched == len({said[1049][3][i : i + n] for n in (2, 3) for i in range(11 - n)}) + 1
    shown = registry.QUERIES["search_references"](spark, sf).collect()
    assert shown == [] or len({r.pair_id for r in shown}) == len(shown)
    page = registry.QUERIES["segment_page"](spark, sf).collect()
    assert len(page) == len({r.id for r in page}) == 100
