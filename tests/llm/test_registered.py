"""The registered queries of the training-data operators on the driver's smallest tables, against plain walks over all rows."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_training_operators import plain_fingerprint, plain_repeats, plain_rule
from tokenizers import Tokenizer

from booktext_spark.llm import queries


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def made(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    return df.columns, df.collect()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_with_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    columns, rows = made(spark, sf_dir, name)
    assert sorted(names) == sorted(columns)
    assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(found.fetchall())


def test_op2_scores_all_rows_and_learns_nothing_from_what_is_held_out(spark, sf_dir, docs):
    columns, rows = made(spark, sf_dir, "op2_toxicity")
    assert columns == ["doc_id", "held_out", "score", "predicted"] and {r.doc_id for r in rows} == set(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    larger = sf_dir.replace("sf0.001", "sf0.01")  # the smallest tables have too few toxic rows to learn from
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{larger}/labels.parquet").where("toxic is not null").collect()}
    judged = [(r.score, labels[r.doc_id]) for r in made(spark, larger, "op2_toxicity")[1] if r.held_out and r.doc_id in labels]
    bad, good = [s for s, x in judged if x], [s for s, x in judged if not x]
    assert len(bad) > 5 and np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) > 0.8


def test_op3_pieces_are_all_ids_once(spark, sf_dir, docs):
    _, rows = made(spark, sf_dir, "op3_packing")
    enc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: enc.encode(t or "", add_special_tokens=False).ids + [0] for d, t in docs.items()}
    ends, at = {}, Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
        at[r.doc_id] += r.length
    assert at == {d: len(x) for d, x in ids.items()}
    assert all(n == 1024 or n < 1024 and n & (n - 1) == 0 for n in ends.values())


def test_op4_components_are_those_of_all_pairs(spark, sf_dir, docs):
    _, rows = made(spark, sf_dir, "op4_simhash")
    prints = {d: plain_fingerprint(t) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    order = sorted(docs)
    for i, a in enumerate(order):
        for b in order[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{prints[d]:016x}", find(d)) for d in docs}


def test_op5_removes_what_brute_force_removes(spark, sf_dir, docs):
    columns, rows = made(spark, sf_dir, "op5_suffix_dedup")
    assert columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert {r.doc_id: tuple(r)[1:] for r in rows} == dict(zip(docs, plain_repeats(docs.values(), 200), strict=True))


def test_op6_rules(spark, sf_dir):
    _, rows = made(spark, sf_dir, "op6_url_filter")
    assert len(rows) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    for r in rows:
        rule = plain_rule(r.host, r.path)
        assert r.rule == (rule and rule[0]) and r.verdict in ("allow", "block") and (rule is None or r.verdict == rule[1])


def test_op7_counts_and_scores(spark, sf_dir, docs):
    _, rows = made(spark, sf_dir, "op7_lm_scoring")
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    words = {d: (t or "").encode().lower().split() + [None] for d, t in docs.items()}
    c = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    base = {w: np.log10((c[w] + 1) / (n + v + 1)) for ws in words.values() for w in ws}
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        ws = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(base[w] for w in ws))
        assert r.score < 0 and r.blend_score < 0
    # the model tells the corpus from the same letters in another order
    shuffled = [(d, " ".join("".join(sorted(w)) for w in (t or "").split())) for d, t in docs.items() if held[d]]
    mixed = [(d, t) for d, t in docs.items()] + [(-d - 1, t) for d, t in shuffled]
    from pyspark.sql import functions as F

    from booktext_spark.llm import lattice

    again = lattice.score_texts(spark.createDataFrame(mixed, "doc_id bigint, text string"), public_tokenizers.path("piece_bpe_32k.model"), (F.col("doc_id") < 0) | (F.crc32(F.col("doc_id").cast("string")) % 7 == 2))
    score = {r.doc_id: r.score for r in again.collect()}
    assert np.mean([score[d] > score[-d - 1] for d, t in shuffled if len(t.split()) > 20]) > 0.9


def test_op8_reads_back_what_was_written(spark, sf_dir, docs):
    _, rows = made(spark, sf_dir, "op8_token_binary")
    enc = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at = 0
    for r, d in zip(sorted(rows, key=lambda r: r.doc_id), sorted(docs), strict=True):
        ids = enc.encode(docs[d] or "", add_special_tokens=False).ids + [1]
        assert tuple(r) == (d, at, len(ids), crc(ids))
        at += len(ids)


def test_op9_masks_each_assistant_text_once(spark, sf_dir):
    _, rows = made(spark, sf_dir, "op9_chat_format")
    turns = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    said = "\\### Assistant: </turn> ok"
    turns[-7] = [(0, "user", said), (1, "assistant", said)]
    assert {r.conv_id for r in rows} == set(turns)
    for r in rows:
        own = sorted(turns[r.conv_id])
        lost = "".join(t for _, role, t in own if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(own), len(lost))
        assert r.loss_sha256 == hashlib.sha256(lost.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in own).encode()).hexdigest()


def test_op10_is_brute_force_on_small_tables(spark, sf_dir):
    _, rows = made(spark, sf_dir, "op10_ann")
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    usable = {i: np.array(v, float) for i, v in vectors.items() if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(usable))
    unit = np.array([usable[i] / np.linalg.norm(usable[i]) for i in ids])
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in usable if i % 50 == 0}
    right = total = 0
    for q, found in got.items():
        s = unit @ unit[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -9
        best = set(ids[np.lexsort((ids, -np.round(s, 12)))[:5]].tolist())
        right, total = right + len(best & {v for _, v, _ in found}), total + len(best)
        assert [r for r, _, _ in sorted(found)] == list(range(1, len(found) + 1))
        for _, v, score in found:
            assert score == pytest.approx(s[np.flatnonzero(ids == v)[0]])
    assert right >= 0.95 * total


@pytest.mark.parametrize("kind", ["wide", "close"])
def test_op10_finds_all_of_the_nearest(spark, tmp_path, kind):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(6000, 256)) if kind == "wide" else rng.normal(size=(30, 48))[rng.integers(0, 30, 6000)] + 1e-3 * rng.normal(size=(6000, 48))
    x[5000:5040] = x[100]  # copies, of which a query is one
    frame = spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    frame.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {}
    for r in queries.QUERIES["op10_ann"](spark, str(tmp_path)).collect():
        found.setdefault(r.query_id, {})[r.rank] = r.vec_id
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 6000, 50):
        s = np.round(unit @ unit[q], 13)
        s[q] = -9
        assert [found[q][rank] for rank in range(1, 6)] == np.lexsort((np.arange(6000), -s))[:5].tolist()
