"""Table operators on small literal tables."""

import hashlib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from booktext_spark.operators import align, copying, editions, layout, library, numbering, reports, requests, revisions, search, uploads


def plain_alignment(source, target):
    """Least cost by trying every cell in the stated order of moves."""
    n, m = len(source), len(target)
    best = {(0, 0): 0.0}
    came = {}
    for i, j in itertools.product(range(n + 1), range(m + 1)):
        for k, (a, b, penalty) in enumerate(align.MOVES):
            if (i - a, j - b) not in best:
                continue
            cost = best[i - a, j - b] + penalty
            if a and b:
                fx, fy = align._features(["\n".join(source[i - a : i])]), align._features(["\n".join(target[j - b : j])])
                cost = best[i - a, j - b] + float(align._costs((fx[0][0], fx[1][0]), fy)[0]) + penalty
            if (i, j) != (0, 0) and cost < best.get((i, j), math.inf):
                best[i, j], came[i, j] = cost, k
    return best[n, m]


def path_cost(groups, n, m):
    used = sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups)
    return sum(-math.log(g[4]) for g in groups) + 1.35 * (n - used[0] + m - used[1])


def test_alignment_is_optimal():
    random.seed(5)
    text = lambda: random.choice(["「", ""]) + "字" * random.randrange(0, 30) + random.choice(["。", "」", ""])
    for _ in range(40):
        s, t = [text() for _ in range(random.randrange(0, 7))], [text() for _ in range(random.randrange(0, 7))]
        groups = align.align(s, t)
        assert path_cost(groups, len(s), len(t)) == pytest.approx(plain_alignment(s, t))
        assert [x for g in groups for x in g[0]] == sorted(x for g in groups for x in g[0])


def whole_table(source, target):
    """Moves of the path of least cost, by a table of all cells; of equal costs the first move counts, at each cell."""
    best, how = {(0, 0): 0.0}, {}
    for i in range(len(source) + 1):
        for j in range(len(target) + 1):
            for k, (a, b, penalty) in enumerate(align.MOVES):
                if (i - a, j - b) not in best:
                    continue
                cost = best[i - a, j - b]
                if a and b:
                    fx, fy = align._features(["\n".join(source[i - a : i])]), align._features(["\n".join(target[j - b : j])])
                    cost += float(align._costs((fx[0][0], fx[1][0]), fy)[0])
                cost += penalty
                if (i, j) not in best or cost < best[i, j]:
                    best[i, j], how[i, j] = cost, k
    out, at = [], (len(source), len(target))
    while at != (0, 0):
        out.append(how[at])
        a, b, _ = align.MOVES[how[at]]
        at = at[0] - a, at[1] - b
    return out[::-1]


@pytest.mark.parametrize("cells", [1, 40, 1 << 24])
def test_halved_tables_give_the_path_of_the_whole_table(monkeypatch, cells):
    monkeypatch.setattr(align, "WHOLE_CELLS", cells)
    rng = random.Random(cells)
    text = lambda: rng.choice(["「", ""]) + "x" * rng.choice([0, 1, 2, 8, 8, 8, 30, 100]) + rng.choice(["。", "」", "", ""])
    for _ in range(60):
        s, t = [text() for _ in range(rng.randrange(15))], [text() for _ in range(rng.choice([0, 1, 4, 9, 14, 30]))]
        t = s if rng.random() < 0.3 else t
        assert align._Table(s, t).path(0, 0, len(s), len(t), 0.0) == whole_table(s, t)


def test_long_pairings_take_little_memory(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(align, "WHOLE_CELLS", 1 << 16)
    rng = random.Random(8)
    s, t = (["x" * rng.randrange(1, 60) + rng.choice(["。", ""]) for _ in range(n)] for n in (1500, 1600))
    tracemalloc.start()
    path = align._Table(s, t).path(0, 0, len(s), len(t), 0.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_500_000 < len(s) * len(t)
    monkeypatch.setattr(align, "WHOLE_CELLS", 1 << 24)
    assert path == align._Table(s, t).path(0, 0, len(s), len(t), 0.0)


def test_alignment_of_dialogue(spark):
    df = spark.createDataFrame([("p", ["「明日も山に登ろうか」", "弟はうなずいた。"], ["“明天也去爬山吧。”", "弟弟点了点头。"]), ("q", [], ["x"]), ("r", None, None)], "pairing_id string, source_paragraphs array<string>, target_paragraphs array<string>")
    rows = align.align_paragraphs(df).orderBy("group_no").collect()
    assert [(r.pairing_id, r.source_indices, r.target_indices) for r in rows] == [("p", [0], [0]), ("p", [1], [1])]
    assert rows[1].content_hash == hashlib.sha256("弟はうなずいた。\x1f弟弟点了点头。".encode()).hexdigest()


def test_copying(spark):
    phrase = "夜の駅で彼女は古い切符を静かに握りしめて遠い町のことを思い出していた"
    outs = spark.createDataFrame([("a", f"{phrase}と"), ("b", "短い文")], "id string, text string")
    refs = spark.createDataFrame([("r", f"昔々。{phrase}。そして"), ("s", "別の話です"), ("n", None)], "id string, text string")
    found = copying.audit(outs, refs, "id", "id").collect()
    assert [(r.output_id, r.ref_id, r.suspicious) for r in found] == [("a", "r", True)]
    assert found[0].lcs == len(phrase)


@pytest.mark.parametrize(("size", "lcs", "share", "overlap", "want"), [(79, 28, 0.58, 0, True), (79, 27, 0.9, 1, False), (80, 42, 0.40, 0, True), (199, 41, 0.9, 0.55, True), (199, 41, 0.9, 0.54, False), (200, 63, 0.9, 0.44, True), (200, 64, 0.30, 0, True), (200, 64, 0.29, 0.43, False)])
def test_verdict_ladder(spark, size, lcs, share, overlap, want):
    assert spark.range(1).select(copying.verdict(F.lit(size), F.lit(lcs), F.lit(share), F.lit(overlap)).alias("x")).first().x is want


def test_runs_by_gaps_equal_the_table(spark):
    random.seed(9)
    texts = ["".join(random.choices("ab", k=random.randrange(8, 40))) for _ in range(24)]
    outs = spark.createDataFrame(list(enumerate(texts[:12])), "id int, text string")
    refs = spark.createDataFrame(list(enumerate(texts[12:])), "id int, text string")
    from booktext_spark.functions.text import common_run

    for r in copying.longest_common_run(outs, refs, 4).collect():
        assert r.lcs == common_run(texts[r.output_id], texts[12 + r.ref_id])


def test_search_keeps_rights_and_budget(spark):
    long = "同じ駅で会う。" * 80
    pairs = spark.createDataFrame(
        [(1, "open", "zh-CN", long, long, 5, True), (2, "closed", "zh-CN", long, "秘", 999, False), (3, "open", "zh-TW", long, "x", 7, True), (4, "open", "zh-CN", "関係ない話", "x", 50, True)],
        "pair_id int, library_id string, target_locale string, source_text string, target_text string, priority int, external_allowed boolean",
    )
    q = lambda ids: spark.createDataFrame([("q", "zh-CN", "駅で会う", ids), ("none", "zh-CN", "。", None)], "query_id string, target_locale string, text string, library_ids array<string>")
    rows = search.search_references(q(None), pairs).collect()
    assert [r.pair_id for r in rows] == [1]
    assert len(rows[0].source_text) == len(rows[0].target_text) == 300
    assert search.search_references(q(["closed"]), pairs).collect() == []
    assert [r.pair_id for r in search.search_references(q(["closed"]), pairs, external_only=False).collect()] == [2]
    assert search.search_references(q(None), pairs, limit=0).collect() == []


def test_budget_cuts_the_last(spark):
    rows = [("q", i, i, "l", "あ" * 300, "い" * 300, 1, 0.0) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "query_id string, position int, pair_id int, library_id string, source_text string, target_text string, priority int, score double")
    got = search.fill_budget(df, 4, 300, 1400).orderBy("position").collect()
    assert [(len(r.source_text), len(r.target_text)) for r in got] == [(300, 300), (300, 300), (200, 0)]


def test_dedup_and_profile(spark):
    pairs = spark.createDataFrame([("a", "x  y", "z", "zh-CN", 2), ("b", "x y", "z ", "ZH-cn", 1), ("c", "w", "z", "zh-CN", 3)], "library_id string, source_text string, target_text string, target_locale string, pair_id int")
    unique, counts = library.dedup_pairs(pairs, ["pair_id"])
    assert sorted(r.library_id for r in unique.collect()) == ["b", "c"]
    assert tuple(counts.first()) == (2, 1)
    texts = spark.createDataFrame([("l", "「あ」。！"), ("l", "  "), ("l", None)], "by string, text string")
    p = library.style_profile(texts, "by").first()
    assert (p.sample_count, p.total_chars, p.average_length, p.dialogue_ratio) == (1, 5, 5.0, 0.2)
    assert (p.punctuation["。"], p.punctuation["！"]) == (1, 0)
    assert library.style_profile(texts.limit(0), "by").count() == 0


def test_authorised_pairs(spark):
    libs = spark.createDataFrame([("a", "zh-CN", 1, True, True), ("b", "zh-CN", 1, True, False), ("c", "zh-CN", 1, None, True)], "library_id string, target_locale string, priority int, rights_confirmed boolean, allows_external_snippets boolean")
    pairs = spark.createDataFrame([(x, i, t, None) for x in "abc" for i, t in enumerate(["s" * 400, " "])], "library_id string, pos int, source_text string, target_text string")
    assert [(r.library_id, len(r.source_text)) for r in library.authorized_pairs(libs, pairs).collect()] == [("a", 300)]


def test_batches(spark):
    rows = [("s", i, f"b{i}", "x" * n) for i, n in enumerate([3, 3, 3, 20, 1, 0])]
    got = requests.pack_batches(spark.createDataFrame(rows, "section_id string, ordinal int, stable_id string, source_text string"), 7).orderBy("batch_no").collect()
    assert [r.block_ids for r in got] == [["b0", "b1"], ["b2"], ["b3"], ["b4", "b5"]]


@pytest.mark.parametrize("max_chars", [1, 7, 20, 100])
def test_batches_of_sections_that_lie_in_many_ranges(spark, max_chars):
    rng = random.Random(max_chars)
    rows = [(s, o, f"{s}{o}", rng.choice([None, *("x" * n for n in (0, 0, 1, 2, 3, 5, 9, 12, 30))])) for s, n in ((None, 30), ("a", 1), ("b", 900), ("c", 60)) for o in range(n)]
    want = {}
    for s in {r[0] for r in rows}:
        batch, used = -1, 0
        for _, o, i, t in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
            n = len(t or "")
            if batch < 0 or used + n > max_chars:
                batch, used = batch + 1, 0
            used += n
            ids, _ = want.get((s, batch), ([], 0))
            want[s, batch] = ([*ids, i], used)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "section_id string, ordinal int, stable_id string, source_text string").repartition(4)
        got = requests.pack_batches(df, max_chars).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.section_id, r.batch_no): (list(r.block_ids), r.n_chars) for r in got} == want


def test_instructions_are_the_callers_or_short_ones(spark):
    one = spark.range(1)
    assert one.select(requests.system_message("translate", "zh-TW", "My words.")).first()[0] == f"My words. {requests.ANSWER_RULE}"
    assert "Simplified Chinese" in one.select(requests.system_message("review", "zh-CN")).first()[0]
    with pytest.raises(ValueError):
        requests.system_message("review", "en")


GOOD = '{"translations":[{"block_id":"a","text":"x"},{"block_id":"b","text":""}]}'


@pytest.mark.parametrize(
    ("raw", "reason"),
    [
        (GOOD, None), (f"```JSON\n{GOOD}\n```", None), ("not json", "response is not valid JSON"), (None, "response is not valid JSON"), ("[]", "response root must be an object"), ("{}", "translations must be an array"),
        ('{"translations":{}}', "translations must be an array"), ('{"translations":[1]}', "each translation must be an object"), ('{"translations":[{"block_id":"a","text":1}]}', "block_id and text must be strings"),
        ('{"translations":[{"block_id":"a"}]}', "block_id and text must be strings"), ('{"translations":[{"block_id":"a","text":"x"},{"block_id":"a","text":"y"}]}', "duplicate block_id"),
        ('{"translations":[{"block_id":"a","text":"x"},{"block_id":"c","text":"y"}]}', "block IDs differ"), ('{"translations":[]}', "block IDs differ"),
    ],
)
def test_structured_output(spark, raw, reason):
    ok, rejects = requests.parse_structured_output(spark.createDataFrame([("k", 0, raw)], "batch_id string, attempt int, raw string"), spark.createDataFrame([("k", ["a", "b"])], "batch_id string, expected_ids array<string>"))
    assert sorted((r.stable_id, r.text) for r in ok.collect()) == ([] if reason else [("a", "x"), ("b", "")])
    assert [r.reason.split(";")[0] for r in rejects.collect()] == ([reason] if reason else [])


REV = "project_id string, block_id string, revision_no int, revision_kind string, text string, locked boolean, source string, context_version int"


def test_revisions(spark):
    rows = [("p", "b", 1, "human", "locked", True, "o", 1), ("p", "b", 2, "model_candidate", "c", False, "w", 1), ("p", "b", 3, "human", "free", False, "o", 1), ("p", "c", 1, "model_draft", "d", False, "j", 1), ("p", "d", 1, "model_candidate", "only", False, "w", 1)]
    df = spark.createDataFrame(rows, REV)
    assert {r.block_id: r.text for r in revisions.effective_revision(df).collect()} == {"b": "locked", "c": "d"}
    results = spark.createDataFrame([("p", x, "draft", "final") for x in "bce"], "project_id string, block_id string, draft string, final string")
    new = revisions.revision_rows(results, df, "J", 2, "m")
    assert sorted((r.block_id, r.revision_no, r.revision_kind) for r in new.collect()) == [("b", 4, "model_candidate"), ("c", 2, "model_draft"), ("c", 3, "model_review"), ("e", 1, "model_draft"), ("e", 2, "model_review")]
    again = revisions.revision_rows(results, df.unionByName(new), "J", 2, "m")
    assert again.count() == 0


def test_pages_of_segments(spark):
    blocks = spark.createDataFrame([("k", 0, i, f"b{i}", "s") for i in range(5)], "book_id string, section_ordinal int, ordinal int, stable_id string, source_text string")
    effective = spark.createDataFrame([("b2", "model_review", False, "t")], "block_id string, revision_kind string, locked boolean, text string")
    got = editions.segment_page(blocks, effective, None, 2, 2).orderBy("position").collect()
    assert [(r.position, r.total, r.status) for r in got] == [(3, 5, "translated"), (4, 5, "pending")]
    with pytest.raises(ValueError):
        editions.segment_page(blocks, effective, None, 1, 201)


def test_uploads(spark):
    whole = b"abcdefghij"
    sha = lambda d: hashlib.sha256(d).hexdigest()
    ups = spark.createDataFrame([("u", 10, 4, sha(whole)), ("v", 10, 4, sha(b"no")), ("w", 10, 4, sha(whole))], "upload_id string, expected_size long, chunk_size long, expected_sha256 string")
    pieces = [whole[:4], whole[4:8], whole[8:]]
    rows = [(u, i, f"k{i}", sha(p), len(p), p) for u in "uv" for i, p in enumerate(pieces)] + [("w", 2, "k", sha(pieces[2]), 2, pieces[2])]
    chunks = spark.createDataFrame(rows, "upload_id string, index int, idempotency_key string, sha256 string, size long, content binary")
    assert {r.upload_id: r.status for r in uploads.chunk_manifest_check(ups, chunks).collect()} == {"u": "complete", "v": "complete", "w": "missing"}
    assert {r.upload_id: r.status for r in uploads.assembled_file_hash(ups, chunks).collect()} == {"u": "ok", "v": "HASH_MISMATCH", "w": "HASH_MISMATCH"}
    files = [("book", "a.pdf", "text/plain", 5, "0" * 64, None), ("cover", "a.png", "image/jpeg", 5, "0" * 64, None), ("cover", "a.png", "image/png", 5, "0" * 64, b"GIF89a"), ("cover", "a.png", "image/png", 5, "0" * 64, b"\x89PNG\r\n\x1a\n.."), ("book", "../a.txt", "text/plain", 5, "0" * 64, None), ("book", "a.txt", "text/plain", 5, "0" * 64, None)]
    df = spark.createDataFrame(files, "purpose string, filename string, media_type string, expected_size long, expected_sha256 string, head binary")
    assert [r.error_code for r in uploads.validate_upload_rows(df).collect()] == ["VALIDATION_ERROR", "INVALID_COVER", "INVALID_COVER", None, "VALIDATION_ERROR", None]


def test_policy_scan(spark):
    df = spark.createDataFrame([("a/secrets/k.pem", "x"), ("b.py", "KEY=abc"), ("c.py", None)], "path string, text string")
    got = uploads.policy_scan(df, [("key", "KEY=")], path_col="path", suffixes=[".pem"], parts=["secrets"])
    assert sorted((r.path, r.rule) for r in got.collect()) == [("a/secrets/k.pem", "part:secrets"), ("a/secrets/k.pem", "suffix:.pem"), ("b.py", "key")]


ITEM = "doc_id string, page int, ordinal int, text string, x0 double, y0 double, x1 double, y1 double, direction_x double, direction_y double"


def test_reading_orders(spark):
    rows = [("右下", 90, 30), ("左上", 50, 10), ("右上", 90, 10), ("左下", 50, 30)]
    df = spark.createDataFrame([("d", 0, i, t, float(x), float(y), x + 10.0, y + 10.0, 0.0, 1.0) for i, (t, x, y) in enumerate(rows)], ITEM)
    order = layout.pdf_reading_order_vertical(df).join(df, ["doc_id", "page", "ordinal"]).orderBy("position")
    assert [r.text for r in order.collect()] == ["右上", "右下", "左上", "左下"]
    assert layout.page_orientation(df).first().vertical
    flat = spark.createDataFrame([("d", 0, 0, "b", 10.0, 70.0, 90.0, 80.0, 1.0, 0.0), ("d", 0, 1, "a", 10.0, 40.0, 90.0, 50.0, 1.0, 0.0)], ITEM)
    assert [r.text for r in layout.pdf_reading_order_horizontal(flat).orderBy("position").collect()] == ["a", "b"]
    assert layout.document_layout(layout.page_orientation(df.unionByName(flat.withColumn("page", F.lit(1))))).first().layout == "mixed"
    ok, rejects = layout.ocr_gate(flat.withColumn("text", F.lit(" ")))
    assert (ok.count(), rejects.first().error_code, rejects.first().pages_without_text) == (0, "OCR_REQUIRED", 1)


def test_reports(spark):
    books = spark.createDataFrame([("b", "", "f.txt", "parsed", "2", "1")], "book_id string, title string, filename string, parse_status string, updated_at string, created_at string")
    projects = spark.createDataFrame([("p", "b", "N", "zh-TW", "replace", "translating", "5"), ("q", "b", "M", "zh-CN", "none", "awaiting_review", "4")], "project_id string, book_id string, name string, target_locale string, cover_policy string, status string, updated_at string")
    r = reports.book_summary(books, projects).first()
    assert (r.title, r.target_locales, r.cover_policy, r.state, r.updated_at) == ("f.txt", ["zh-CN", "zh-TW"], "replace", "review", "5")
    jobs = spark.createDataFrame([("j", "p", "odd", 0.55, '{"total_blocks":10}', "E"), ("k", "gone", "queued", 0.5, None, None)], "job_id string, project_id string, state string, progress double, checkpoint string, error_code string")
    got = {r.job_id: (r.state, r.completed_blocks, r.issue_count, r.locale) for r in reports.job_summary(jobs, projects, books).collect()}
    assert got == {"j": ("failed", 5, 1, "zh-TW"), "k": ("queued", 0, 0, "zh-CN")}


def test_places_in_groups_of_any_size(spark):
    random.seed(11)
    rows = [(random.choice(["hot", "hot", "hot", "b", None]), k) for k in random.sample(range(9000), 3000)]
    df = spark.createDataFrame(rows, "g string, k int")
    got = numbering.numbered(df, "g", ["k"], "at").collect()
    want = {g: {k: i + 1 for i, k in enumerate(sorted(k for h, k in rows if h == g))} for g in ("hot", "b", None)}
    assert len(got) == len(rows) and all(want[r.g][r.k] == r["at"] for r in got)
    assert numbering.numbered(df.limit(0), "g", ["k"]).count() == 0


def test_columns_are_those_of_a_plain_walk():
    random.seed(12)
    for _ in range(200):
        rows = [(random.choice([10.0, 12.0, 30.0, 31.0, 50.0]) + random.randrange(4), float(random.randrange(60)), float(random.randrange(-1, 9))) for _ in range(random.randrange(12))]
        wide = sorted(w for _, _, w in rows if w > 0)
        middle = (wide[(len(wide) - 1) // 2] + wide[len(wide) // 2]) / 2 if wide else 8.0
        columns = []
        for i in sorted(range(len(rows)), key=lambda i: (-rows[i][0], rows[i][1])):
            for c in columns:
                if abs(sum(rows[j][0] for j in c) / len(c) - rows[i][0]) <= max(middle * 0.8, 3.0):
                    c.append(i)
                    break
            else:
                columns.append([i])
        columns.sort(key=lambda c: -sum(rows[j][0] for j in c) / len(c))
        want = [i for c in columns for i in sorted(c, key=lambda i: (rows[i][1], -rows[i][0], i))]
        assert layout.columns_right_to_left(rows) == want


@pytest.mark.parametrize("cells", [1, 1 << 22])
@pytest.mark.parametrize("source, target, groups", [("x x x xxxxx? xxxxx x", "x?", ([1, 2], [0])), ("xx.", "xx xx xx xx xx xxxxx. xx? xx?", ([0], [2, 3])), ("xx xxxxxxxxx. xx? xxxxxxxxx? xx.", "xxxxxxxxx?", ([2, 3], [0]))])
def test_sums_that_become_equal_further_on_are_ties(monkeypatch, cells, source, target, groups):
    """The SQL compares whole paths: of equal sums the first move from the end counts, though one of them was less in a cell before."""
    monkeypatch.setattr(align, "WHOLE_CELLS", cells)
    s, t = source.split(), target.split()

    def paths(i, j, total, back):
        if (i, j) == (len(s), len(t)):
            yield total, back
        for k, (a, b, penalty) in enumerate(align.MOVES):
            if i + a <= len(s) and j + b <= len(t):
                cost = 0.0
                if a and b:
                    fx, fy = align._features(["\n".join(s[i : i + a])]), align._features(["\n".join(t[j : j + b])])
                    cost = float(align._costs((fx[0][0], fx[1][0]), fy)[0])
                yield from paths(i + a, j + b, total + cost + penalty, [k, *back])

    assert align._Table(s, t).path(0, 0, len(s), len(t), 0.0) == min(paths(0, 0, 0.0, []))[1][::-1]
    assert [g[:2] for g in align.align(s, t)] == [groups]


def test_ocr_gate_has_a_row_for_each_row_of_documents(spark, tmp_path):
    import duckdb

    from booktext_spark.plans import registry

    rows = [(1, "some text", "src3"), (5, "some text", None), (7, "twice", "src3"), (7, "twice", "src3"), (7, "once more", "src1"), (8, "abc", "src1"), (9, None, "src2")]
    blank = [(20, "", "src3"), (21, None, "src3"), (22, " ", "src4")]
    spark.createDataFrame(rows + blank, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in registry.QUERIES["ocr_gate"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registry.ORACLE_SQL["ocr_gate"]).fetchall()
    assert sorted((r for r in got if r[0] < 20), key=str) == sorted((r for r in want if r[0] < 20), key=str)
    assert sorted(r for r in got if r[0] >= 20) == [(20, True), (21, True), (22, True)]
