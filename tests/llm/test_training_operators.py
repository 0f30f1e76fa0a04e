"""The ten training-data operators against brute force, round trips and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from booktext_spark.llm import ann, chat, decontam, graph, lattice, packing, repeats, simhash, tokenbin, tokens, toxicity, urls
from booktext_spark.llm.common import alnum_words

DOCS = "doc_id bigint, text string"
BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
#: Null, empty, blank and repeated texts and ids, a long text, and columns whose names clash with those made.
ODD = [(1, None, 0), (2, "", 0), (3, " \n", 0), (None, "some text here", 0), (4, "a b c", 0), (4, "a b c", 0), (5, "xy " * 20000, 0), (6, "déjà\U0001f600 vu", 0), (7, "a<|endoftext|>b İ İ. <|startoftext|>", 0)]


def odd(spark, *clashing):
    df = spark.createDataFrame(ODD, "doc_id bigint, text string, n int")
    for c in clashing:
        df = df.withColumn(c, F.lit("clash"))
    return df


def words(rng, n, size=6):
    return " ".join("".join(rng.choices("abcdeé", k=rng.randrange(1, size))) for _ in range(n))


# 1: decontamination


def hits(text, items, window):
    ws = alnum_words(text.encode() if text else None)
    hit, found = set(), set()
    for name, item in items:
        iw = alnum_words(item.encode() if item else None)
        for k in range(max(1, len(iw) - window + 1)) if iw else ():
            w = iw[k : k + window]
            for at in range(len(ws) - len(w) + 1):
                if ws[at : at + len(w)] == w:
                    hit.update(range(at, at + len(w)))
                    found.add(str(name))
    return len(ws), len(hit), sorted(found)


def test_an_item_that_repeats_one_word(spark):
    items = [("long", ["w"] * 40_000), ("other", "w w w x".split()), ("short", ["w"] * 3)]
    automaton = decontam.Automaton([(n, [w.encode() for w in ws]) for n, ws in items], 13)
    assert max(map(len, automaton.ends)) <= 3
    spans, found = automaton.scan([b"y", *[b"w"] * 14, b"x"])
    assert spans == [(1, 16)] and {automaton.names[i] for i in found} == {"long", "other", "short"}


@pytest.mark.parametrize("shard", [1 << 20, 30])
def test_decontamination_is_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(decontam, "SHARD_BYTES", shard)
    rng = random.Random(1)
    items = [(i, " ".join(rng.choices("abc", k=rng.randrange(0, 8)))) for i in range(12)] + [(99, None), (98, "...")]
    docs = [(i, " ".join(rng.choices("abcD,", k=rng.randrange(0, 60)))) for i in range(40)]
    found = decontam.find_contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string"), 4)
    for r in found.collect():
        assert (r.n_words, sum(s.stop - s.start for s in r.spans), r["items"]) == hits(dict(docs)[r.doc_id], items, 4)


def test_decontamination_removes_spans_only(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"Before, {item.upper()}! after", "x"), (2, "clean text", "x"), (3, None, "x"), (4, f"{'w ' * 400}{item}", "x")], "doc_id bigint, text string, spans string")
    got = {r.doc_id: r.text for r in decontam.remove_contamination(docs, bench).collect()}
    assert got == {1: "Before,  ! after", 2: "clean text", 3: None, 4: f"{'w ' * 400}{item}"}
    with pytest.MonkeyPatch.context() as m:  # several automata
        m.setattr(decontam, "SHARD_BYTES", 5)
        more = bench.unionByName(spark.createDataFrame([(2, "clean text here"), (3, "clean")], bench.schema))
        assert {r.doc_id: r.text for r in decontam.remove_contamination(docs, more).collect()} == got | {2: "  text"}
    none = decontam.find_contamination(odd(spark, "spans", "items"), bench.limit(0))
    assert none.count() == len(ODD) and none.where("size(spans) > 0").count() == 0
    assert decontam.find_contamination(docs.limit(0), bench).count() == 0


# 2: toxicity


def test_fold():
    assert toxicity.fold("1d10t, ІDІOТ") == " idiot idiot "
    assert toxicity.fold("pläĭn!! $tu\u200bpid") == " piain stupid "
    assert toxicity.fold("") == "  "


def test_toxicity_learns_and_spares_exceptions(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = words(rng, 40) + (" moron scumbag " if bad else " ") + words(rng, 10)
        rows.append((i, text))
        labels.append((i, int(bad)))
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (9999, None)], "doc_id bigint, toxic int")
    lexicon = toxicity.learn_lexicon(docs, toxicity.training_labels(lab), exceptions=("moron valley",))
    new = spark.createDataFrame([(1, f"{words(rng, 30)} m0r0n"), (2, words(rng, 30)), (3, "moron valley " + words(rng, 30)), (4, None), (5, "")], DOCS)
    got = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(new, lexicon).collect()}
    assert got[1] > 0.7 > got[2] == got[3] == got[4] == got[5]
    assert toxicity.score_toxicity(odd(spark, "toxicity"), lexicon).count() == len(ODD)
    blank = toxicity.learn_lexicon(docs.limit(0), lab.limit(0))
    assert {r.toxicity < 0.5 for r in toxicity.score_toxicity(new, blank).collect()} == {True}


def test_shields_and_scores_are_a_naive_scan():
    rng = random.Random(18)
    for _ in range(200):
        letters = lambda n: "".join(rng.choices("ab", k=n))
        lexicon = toxicity.Lexicon({letters(rng.randrange(1, 5)): rng.random() for _ in range(6)}, [f"{letters(2)} {letters(3)}" for _ in range(4)])
        text = " ".join(letters(rng.randrange(1, 7)) for _ in range(rng.randrange(30)))
        folded = toxicity.fold(text)
        shielded = set()
        for e in lexicon.exceptions:
            for at in range(len(folded)):
                if folded.startswith(f" {e} ", at):
                    shielded.update(range(at, at + len(e) + 1))  # the space behind it belongs to the next word
        total, hits, ws = 0.0, 0, folded.split()
        for at in range(len(folded) - 1):
            if folded[at] == " " and at not in shielded:
                terms = [t for t in lexicon.terms if folded.startswith(t, at + 1)]
                if terms:
                    hits, total = hits + 1, total + lexicon.terms[max(terms, key=len)]
        a, b, n = lexicon.features(folded, lexicon.automaton())
        assert n == hits and a == pytest.approx(np.log1p(total)) and b == pytest.approx(np.log1p(100 * total / max(1, len(ws))))


def test_labels_that_differ_for_equal_texts(spark):
    docs = [(i, "moron scum here" if i < 40 else f"fine words {i % 7}") for i in range(120)]
    labels = [(i, int(i % 2 == 0 and i < 40)) for i in range(120)]
    learnt = [toxicity.learn_lexicon(spark.createDataFrame(docs[::k], DOCS), spark.createDataFrame(labels[::k], "doc_id bigint, toxic int")) for k in (1, -1)]
    assert learnt[0] == learnt[1]


def test_look_alikes_by_list_and_by_name():
    for word in ("ѕсυm", "sсum", "ꮪcum", "ⓢⓒⓤⓜ", "🅂🄲🅄🄼", "🇸🇨🇺🇲", "ꜱᴄᴜᴍ", "şçũm", "5cum", "$cum", "ѕ\u200bcum", "ＳＣＵＭ", "𝓼𝓬𝓾𝓶", "SCUM"):
        assert toxicity.fold(word).replace(" ", "") == "scum", word
    assert toxicity.fold("ŁØĐ ħ") == " iod h "
    assert toxicity.fold("þ 漢") == " þ 漢 "


def test_terms_of_any_length_and_number_unless_told(spark):
    """Words that part from clean ones far behind their first 24 letters, and more terms than any list would hold."""
    long = "abcdefghij" * 6
    bad = [f"{long}{'xy' * 20} {' '.join(f'zz{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k)}q' for k in range(20))}" for i in range(60)]
    good = [f"{long}{'pq' * 20} fine words {i % 7}" for i in range(60)]
    docs = spark.createDataFrame([(i, f"{t} n{i}") for i, t in enumerate(bad + good)], DOCS)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id bigint, toxic int")
    learnt = toxicity.learn_lexicon(docs, labels)
    assert any(len(t) > 60 and t.startswith(f"{long}x") for t in learnt.terms)
    assert all(len(t) <= 24 for t in toxicity.learn_lexicon(docs, labels, longest=24).terms)
    assert len(toxicity.learn_lexicon(docs, labels, terms=1).terms) == 1
    scores = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(docs, learnt).collect()}
    assert min(scores[i] for i in range(60)) > max(scores[i] for i in range(60, 120))


# 3: packing


def check_packed(rows, docs, size, end):
    enc = Tokenizer.from_file(BYTE)
    ids = Counter(tuple(enc.encode(t or "", add_special_tokens=False).ids + end) for _, t in docs)
    made, sequences = Counter(), {}
    rows = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    for r in rows:
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    for n in sequences.values():
        assert n <= size and (n == size or n & (n - 1) == 0)
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    if len({d for d, _ in docs}) == len(docs):
        for pieces in by_doc.values():
            pieces.sort(key=lambda r: r.start)
            whole = b"".join(bytes(p.ids) for p in pieces)
            assert len(whole) // 4 == pieces[0].doc_tokens
            made[tuple(np.frombuffer(whole, "<u4").tolist())] += 1
        assert made == ids
    assert sum(sequences.values()) == sum(len(k) * n for k, n in ids.items())


def test_packing(spark):
    rng = random.Random(3)
    docs = [(i, words(rng, rng.randrange(0, 120))) for i in range(90)] + [(1000, None), (1001, words(rng, 2000))]
    out = packing.pack_documents(spark.createDataFrame(docs, DOCS), BYTE, 64)
    check_packed(out.collect(), docs, 64, [0])
    check_packed(packing.pack_documents(odd(spark, "ids", "offset"), BYTE, 64).collect(), [o[:2] for o in ODD], 64, [0])
    assert packing.pack_documents(spark.createDataFrame([], DOCS), BYTE, 64).count() == 0


@pytest.mark.parametrize("open_tokens", [1 << 22, 200])
def test_windows_stay_as_the_level_array_filled_them(open_tokens):
    rng = random.Random(14)
    docs = [(i, np.arange(rng.choice([3, 9, 30, 31, 64, 65, 150]) + rng.randrange(3), dtype="<u4").tobytes()) for i in range(500)]
    rows = list(packing.pack_stream(iter(docs), 64, 1 << 36, open_tokens))
    levels, filled = packing.Levels(64), {}
    for k, (i, ids) in enumerate(docs):
        if rest := len(ids) // 4 % 64:
            window, _ = levels.place(rest, k)
            filled.setdefault(window, []).append(i)
    together = {}
    for doc, _, length, _, sequence, offset, donated, ids in rows:
        assert len(ids) == 4 * length and offset + length <= 64
        if not donated and length < 64:
            together.setdefault(sequence, []).append(doc)
    donated = sum(r[2] for r in rows if r[6])
    assert 0 < donated < 0.2 * sum(r[2] for r in rows)
    if open_tokens > 200:
        whole = {tuple(x) for x in filled.values()}
        assert all(tuple(x) in whole for x in together.values())
    by_doc = {}
    for doc, start, _, total, _, _, _, ids in sorted(rows, key=lambda r: (r[0], r[1])):
        by_doc[doc] = by_doc.get(doc, b"") + ids
        assert total == len(dict(docs)[doc]) // 4
    assert by_doc == dict(docs)
    ends = {}
    for r in rows:
        ends[r[4]] = max(ends.get(r[4], 0), r[5] + r[2])
    assert all(n == 64 or n & (n - 1) == 0 for n in ends.values()) and sum(ends.values()) == sum(len(ids) // 4 for _, ids in docs)


def test_levels_take_the_least_sum_of_squares():
    rng = random.Random(4)
    levels = packing.Levels(16)
    counts = np.zeros(17, int)
    for k in range(300):
        s = rng.randrange(1, 16)
        options = {}
        for h in range(0, 17 - s):
            if h == 0 or counts[h]:
                c = counts.copy()
                if h:
                    c[h] -= 1
                if h + s < 16:
                    c[h + s] += 1
                options[h] = int((c[:16] ** 2).sum())
        _, level = levels.place(s, k)
        assert options[level] == min(options.values())
        if level:
            counts[level] -= 1
        if level + s < 16:
            counts[level + s] += 1
        assert (counts == levels.counts).all()


# 4: SimHash


def plain_fingerprint(text, k=3):
    import xxhash

    ws = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))] if ws else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(5)
    for n in [0, 1, 2, 3, 4, 50, 301]:
        text = words(rng, n)
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0


def print_clusters(rng, clusters, most):
    prints = set()
    for _ in range(clusters):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, most)):
            prints.add(x)
            for b in rng.sample(range(64), rng.randrange(1, 4)):
                x ^= 1 << b
    centre = rng.getrandbits(64)  # a crowd around one print
    prints |= {centre ^ sum(1 << b for b in rng.sample(range(20), rng.randrange(6))) for _ in range(8 * most)}
    return sorted(prints)


def signed(p):
    return p - (1 << 64) if p >> 63 else p


@pytest.mark.parametrize("group", [2048, 6])
def test_near_links_join_as_all_pairs(spark, monkeypatch, group):
    prints = print_clusters(random.Random(6), 30, 12)
    root = list(range(len(prints)))
    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 2:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    found = graph.components(simhash.near_links(spark.createDataFrame([(signed(p),) for p in prints], "print bigint"), group=group))
    got = {r.node: r.root for r in found.collect()}
    classes = {}
    for p, r in zip(prints, root, strict=True):
        classes.setdefault(r, set()).add(signed(p))
    for members in classes.values():
        assert {got.get(m, m) for m in members} == {min(members)}


@pytest.mark.parametrize("pairs", [1 << 21, 7])
def test_pivots_lose_no_near_pair(monkeypatch, pairs):
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rng = random.Random(17)
    prints = np.array(print_clusters(rng, 20, 10), np.uint64)
    rng2 = np.random.default_rng(1)
    prints = prints[rng2.permutation(len(prints))]
    group = np.sort(rng2.integers(0, 3, len(prints)))
    got = {tuple(sorted(x)) for i, j in simhash.near_pairs(prints, group) for x in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if group[i] == group[j] and (int(prints[i]) ^ int(prints[j])).bit_count() <= 2}
    assert got == want and len(want) > 50


def test_components_of_a_long_chain(spark):
    ids = list(range(40))
    random.Random(7).shuffle(ids)
    edges = spark.createDataFrame([*zip(ids, ids[1:], strict=False), (100, 101), (5, 5)], "u bigint, v bigint")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == dict.fromkeys(range(40), 0) | {100: 100, 101: 100}
    assert graph.components(edges.limit(0)).count() == 0


def test_simhash_rows(spark):
    got = simhash.simhash_components(odd(spark, "fingerprint", "component_id")).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    twice = spark.createDataFrame([(7, "one two three four"), (7, "nothing alike is in this other text"), (8, "one two three four"), (9, "nothing alike is in this other text"), (7, "one two three four")], DOCS)
    assert sorted((r.doc_id, r.text) for r in simhash.drop_near_copies(twice).collect()) == [(7, "nothing alike is in this other text"), (7, "one two three four")]
    assert {(r.doc_id, r.component_id) for r in simhash.simhash_components(twice).collect()} == {(7, 7), (8, 7), (9, 7)}
    assert simhash.drop_near_copies(twice.limit(0)).count() == simhash.simhash_components(twice.limit(0)).count() == 0
    kept = simhash.drop_near_copies(odd(spark))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 5, 6, 7]
    assert kept.where("doc_id is null").count() == 1


# 5: repeats


def plain_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = b"\x01" * length
        out.append((len(d), sum(gone), len(re.findall(rb"\x01+", gone)), hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def test_repeats_are_brute_force(spark):
    rng = random.Random(8)
    shared = [words(rng, n) for n in (30, 60, 100, 200)]
    texts = [None, "", "a" * 900, "ab" * 300]
    for _ in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.5 else words(rng, rng.randrange(1, 60)) for _ in range(rng.randrange(1, 5))]
        t = " ".join(parts)
        if rng.random() < 0.5 and t:  # an edit inside
            k = rng.randrange(len(t))
            t = t[:k] + "é" + t[k + 1 :]
        texts.append(t)
    texts += [texts[10], texts[10], texts[11][:150]]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: tuple(r)[1:] for r in repeats.sha256_of_kept(repeats.find_repeats(docs, 200)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_repeats(texts, 200)


def test_repeats_across_pieces_by_shuffle(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(repeats, "BROADCAST_BYTES", -1)
    shared = words(rng, 120)
    long = words(rng, 4 * repeats.PIECE // 16)[: repeats.PIECE - 150]
    texts = [long + shared + words(rng, 40), shared + words(rng, 200), words(rng, 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: tuple(r)[1:] for r in repeats.sha256_of_kept(repeats.find_repeats(docs, 200)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_repeats(texts, 200)
    assert got[0][1] >= len(shared)


def test_repeats_odd_rows(spark):
    found = repeats.find_repeats(odd(spark, "row", "spans", "kept"), 200)
    assert found.count() == len(ODD)
    assert repeats.find_repeats(odd(spark).limit(0), 200).count() == 0
    kept = repeats.remove_repeats(odd(spark, "spans"), 200)
    assert kept.columns == ["doc_id", "text", "n", "spans"]
    assert {r.doc_id: r.text for r in kept.collect()}[1] is None
    with pytest.raises(ValueError):
        repeats.find_repeats(odd(spark), 64)


# 6: urls


def plain_rule(host, path):
    best = None
    for h, p, v in urls.RULES:
        if (host == h or host.endswith(f".{h}")) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best


def test_urls(spark):
    rng = random.Random(10)
    hosts = ["example.com", "WWW.Example.com", "com", "xcom", "a.net", "b.org", "net", "example.net:80"]
    pages = [(i, f"{rng.choice(['http', 'ftp'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/1', '/es/2.html', '/fr', '/fr/', '?q=/en/', '#x', '/es/a?b#c'])}") for i in range(200)]
    pages += [(900, None), (901, "no url"), (902, ""), (900, "http://b.org/es/1")]
    got = urls.filter_urls(spark.createDataFrame(pages, "page_id bigint, url string").withColumn("verdict", F.lit(1)), support=0.02)
    rows = got.collect()
    assert len(rows) == len(pages)
    for r in rows:
        rule = plain_rule(r.host, r.path)
        assert r.rule == (rule and rule[0])
        assert r.verdict in ("allow", "block") and (rule is None or r.verdict == rule[1])
    parts = {r.page_id: (r.host, r.path) for r in rows}
    for i, url in pages[:200]:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        assert parts[i] == (host.lower(), re.match(r"[^?#]*", rest[len(host) :])[0])
    assert urls.filter_urls(got.select("page_id", F.lit("").alias("url")).limit(0)).count() == 0


def test_mined_rules_need_all_tokens(spark):
    rows = [(i, f"http://a.net/{'es' if i % 2 else 'de'}/x") for i in range(40)] + [(i, "http://c.com/es/x") for i in range(40, 60)] + [(100, "http://q.org/es/x")]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string"), support=0.1, confidence=0.9)
    by = {r.page_id: (r.rule, r.verdict) for r in got.collect()}
    # all labelled pages of net are blocked, those of /es/ only in part
    assert by[0] == (None, "block") and by[1] == ("net/es/", "block") and by[40] == ("com/", "allow") and by[100] == (None, "allow")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mined_verdicts_are_those_of_all_itemsets(spark, seed):
    rng = random.Random(seed)
    deep = "/".join(f"f{i}" for i in range(18))  # one long path of many rows: its folders are one item
    rows = []
    for i in range(160):
        host = rng.choice(["a.com", "b.net", "b.net", "www.example.com", "example.com"])
        path = rng.choice(["", "en/x.html", "es/x", "fr/y.pdf?q", "es/en/x", deep])
        rows.append((i, f"http{rng.choice(['', 's'])}://{host}/{path}"))
    rows += [(1000 + i, f"https://{h}/{p}") for i, (h, p) in enumerate((h, p) for h in ("q.org", "x.b.net", "a.com.q") for p in ("es/x", "en/x.html", "fr/y.pdf?q", deep, "f3/z", ""))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    support, confidence = 0.05, 0.7
    got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(pages, support=support, confidence=confidence).collect()}

    host, path = urls.url_parts("url")
    tokens_of = {r.page_id: set(r.t) for r in pages.withColumns({"host": host, "path": path}).select("page_id", urls.url_tokens().alias("t")).collect()}
    judged = {i: got[i][1] for i in tokens_of if got[i][0]}
    n = len(judged)
    holders = {}
    for i in judged:
        for t in tokens_of[i]:
            holders.setdefault(t, set()).add(i)
    same = {}
    for t, rows_of in holders.items():
        if len(rows_of) >= support * n:
            same.setdefault(frozenset(rows_of), []).append(t)
    one = {t: min(ts, key=lambda t: (len(t), t)) for ts in same.values() for t in ts}
    baskets = [(frozenset(one[t] for t in tokens_of[i] if t in one), v) for i, v in judged.items()]
    items = sorted({t for b, _ in baskets for t in b})
    rules = []
    for size in range(1, len(items) + 1):
        level = 0
        for some in map(frozenset, combinations(items, size)):
            holding = [v for b, v in baskets if some <= b]
            for v in set(holding):
                k = holding.count(v)
                level += k >= support * n
                if k >= support * n and k / len(holding) >= confidence:
                    rules.append((k / len(holding), k / n, size, v, some))
        if not level:
            break
    assert len(rules) > 10
    for i, tokens_here in tokens_of.items():
        if got[i][0] is None:
            met = {one[t] for t in tokens_here if t in one}
            fits = [r for r in rules if r[4] <= met]
            assert got[i][1] == (max(fits)[3] if fits else "allow"), (i, met)


# 7: language model


def test_lattice_sums_all_segmentations():
    pieces, by_byte = lattice.normalised({"▁": 0.0, "▁a": -1.0, "a": -1.5, "ab": -0.5, "b": -2.0, "▁ab": -3.0}, [-6.0] * 256)
    model = lattice.Lattice(pieces, by_byte, 0.4)

    def every(text, used):
        if not text:
            return used * 0.4 / 0.6
        total = every(text[1:], used * 0.6 * np.exp(sum(by_byte[b] for b in text[0].encode()) + (len(text[0].encode()) - 1) * np.log(0.6)))
        for k in range(1, len(text) + 1):
            if text[:k] in pieces:
                total += every(text[k:], used * 0.6 * np.exp(pieces[text[:k]]))
        return total

    words = ["", "a", "ab", "abba", "éb", "b" * 12, "ab"]
    for part in (model.PART, 3):
        model.PART = part
        assert model.log_probabilities(words) == pytest.approx([np.log(every("▁" + w, 1.0)) for w in words])
    assert model.log_probabilities(["ab" * 5000])[0] < -1000
    assert model.log_probabilities([]).tolist() == []


def check_lattice_scores(spark, df, rows, split, held):
    """score against the marginal of each word, one by one, with the fit taken as it is."""
    c = Counter(w for i, ws in split.items() if not held(i) for w in ws)
    n, end = sum(c.values()), c[None] / sum(c.values())
    pieces, by_byte = lattice.vocabulary_pieces(PIECE)
    seen = spark.createDataFrame([(bytearray(w), k) for w, k in c.items() if w], "word binary, n_train bigint")
    model = lattice.Lattice(*lattice._fit(seen, pieces, by_byte, 0.3))
    weights = dict(zip(model.names, model.weights.tolist(), strict=True))

    def marginal(word):
        text = "▁" + word
        sums = [0.0] + [-np.inf] * len(text)
        for i in range(len(text)):
            sums[i + 1] = np.logaddexp(sums[i + 1], sums[i] + sum(model.by_byte[b] for b in text[i].encode()))
            for j in range(i + 1, len(text) + 1):
                if (w := weights.get(text[i:j])) is not None:
                    sums[j] = np.logaddexp(sums[j], sums[i] + w)
        return sums[-1] - model.log_go + model.log_stop

    a = max(1.0, lattice.PRIOR * len(c))
    for r in rows:
        ws = [w for w in split[r.doc_id] if w]
        logs = [np.log1p(-end) + marginal(w.decode()) for w in ws] + [np.log(end)]
        assert r.score == pytest.approx(sum(logs) / np.log(10))
        assert r.blend_score == pytest.approx(sum(np.log10((c[w] + a * np.exp(x)) / (n + a)) for w, x in zip([*ws, None], logs, strict=True)))


def test_language_model_counts(spark):
    rng = random.Random(11)
    docs = [(i, words(rng, rng.randrange(0, 30), 4)) for i in range(60)] + [(70, None), (71, "OnlyHere twice OnlyHere")]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    df = spark.createDataFrame(docs, DOCS).withColumn("score", F.lit("clash"))
    for head in (1 << 18, 4):
        old, lattice.HEAD = lattice.HEAD, head
        rows = lattice.score_texts(df, PIECE, F.crc32(F.col("doc_id").cast("string")) % 7 == 2, rounds=1).collect()
        lattice.HEAD = old
        split = {i: (t or "").encode().lower().split() + [None] for i, t in docs}
        c = Counter(w for i, ws in split.items() if not held(i) for w in ws)
        n, v = sum(c.values()), len(c)
        for r in rows:
            ws = split[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(ws), sum(c[w] > 0 for w in ws), n)
            assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws))
            assert r.score < 0 and r.blend_score < 0
        check_lattice_scores(spark, df, rows, split, held)
    assert lattice.score_texts(df.limit(0), PIECE, F.lit(True)).count() == 0
    assert lattice.score_texts(odd(spark), PIECE, F.lit(True)).count() == len(ODD)


# 8: token files


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 20])
def test_bit_packing(bits):
    import io

    rng = np.random.default_rng(1)
    sink = io.BytesIO()
    writer = tokenbin.Writer(sink, bits, 64)
    docs = [rng.integers(0, 1 << bits, n).astype("<u4") for n in (0, 1, 63, 64, 65, 1000, 0, 5)]
    for i, d in enumerate(docs):
        writer.add(None if i == 3 else i, d)
    writer.close()
    reader = tokenbin.Reader(io.BytesIO(sink.getvalue()), len(sink.getvalue()))
    assert [(d, s, x.tolist()) for d, s, x in reader.documents(3)] == [(None if i == 3 else i, sum(map(len, docs[:i])), d.tolist()) for i, d in enumerate(docs)]
    flat = np.concatenate(docs)
    assert reader.ids(70, 190).tolist() == flat[70:190].tolist() and reader.ids(5, 5).tolist() == []


def test_token_files(spark):
    enc = Tokenizer.from_file(WORD)
    got = tokenbin.round_trip(odd(spark, "start"), WORD, 1).orderBy("start").collect()
    at = 0
    for r, (doc, text, _) in zip(got, sorted(ODD, key=lambda o: -1 if o[0] is None else o[0]), strict=True):
        ids = enc.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (doc, at, len(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert tokenbin.round_trip(odd(spark).limit(0), WORD, 1).count() == 0


def test_files_end_before_they_are_too_long(spark, tmp_path):
    texts = ["word " * n for n in (10, 3000, 5, 400, 400, 400, 1, 0, 2500, 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    manifest = tokenbin.write_token_files(docs, WORD, str(tmp_path / "tokens"), files=2, file_bytes=6000)
    rows = sorted(manifest.collect())
    assert len(rows) > 4 and sum(r.n_docs for r in rows) == len(texts) and all(r.n_docs == 1 or r.n_ids < 2000 for r in rows)
    got = tokenbin.read_token_files(spark, spark.createDataFrame(rows, manifest.schema), str(tmp_path / "tokens")).orderBy("start").collect()
    assert [r.doc_id for r in got] == list(range(len(texts))) and [r.n_tokens for r in got] == [len(t.split()) + 1 for t in texts]
    starts = np.cumsum([0] + [len(t.split()) + 1 for t in texts])
    assert [r.start for r in got] == starts[:-1].tolist()


def test_encoder_equals_the_library():
    rng = random.Random(12)
    odd_texts = ["", " ", "a  b\n\n c", "it's \x1c x\x1dy <|endoftext|>", "déja\u0301 Σας ΟΔΟΣ İx ١٢ ½", "\x85x ", "\n", "A.B,c!! d.", " lead", "trail ", "x's '' 's x'", "\nAb*** \n Ab***\nab_c d-e", "a\n b", "Ĳ ß'S ŉx,"]
    for path in (BYTE, WORD):
        enc = tokens.Encoder(path, room=4000)
        for text in odd_texts + ["".join(rng.choices("aB é.,\n'\U0001f600 ", k=60)) for _ in range(200)]:
            assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.ids(text), text
            assert len(enc.known) + len(enc.older) < 100


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("specials", [True, False])
def test_encoder_equals_the_library_whatever_came_before(path, specials):
    """Letters that fall apart when normalised, alone and before signs, and special strings, in any order."""
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = not specials
    parts = ["İ", "İ.", " İ", "ﬁ", "e\u0301", "é", "é.", "e\u0301,", "Å", "\u212b", "\u212b!", "ǅ", "ǅ.", "ß.", "Σ", "ΑΣ", "ΑΣ.", "가", "\u1100\u1161", "\u1100\u1161.", "漢", "漢,", "<|endoftext|>", "<|startoftext|>", "x<|endoftext|>y", "<|endoftext|>'s", "word", "word.", "\nword", "'s"]
    for seed in range(30):
        rng = random.Random(seed)
        enc = tokens.Encoder(path, room=100_000, specials=specials)
        for _ in range(40):
            text = "".join(p + rng.choice(["", " ", " ", "\n", "  "]) for p in rng.choices(parts, k=rng.randrange(1, 6)))
            assert np.frombuffer(enc.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, (seed, text)


# 9: chat


def test_chat_round_trip(spark):
    rng = random.Random(13)
    texts = ["", "\\", "</turn>\n", "<turn>assistant\n", "a\nb", "é\U0001f600 x", "\\</turn>", "<tur", "  "] + ["".join(rng.choices(["<turn>", "</turn>", "\\", "\n", "x ", "語"], k=8)) for _ in range(60)]
    rows = [(k // 4, k % 4, rng.choice(["user", "assistant", "system"]), t, "clash") for k, t in enumerate(texts)] + [(50, 0, None, None, ""), (50, 0, None, None, ""), (None, 1, "assistant", "z", ""), (51, 1, "ro\nle\\", "x" * 30000, "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, ids string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df, BYTE)).collect()}
    for conv in {r[0] for r in rows}:
        want = [(r[2] or "", r[3] or "") for r in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        assert [(t.role, t.text) for t in out[conv].turns] == want
        assert out[conv].loss_text == "".join(t for role, t in want if role == "assistant")
    assert chat.format_conversations(df.limit(0), BYTE).count() == 0


def test_masked_tokens_hold_the_wanted_texts_only(spark):
    rng = random.Random(15)
    pieces = ["<turn>", "</turn>", "\\", "\n", " x", "語", "é\U0001f600", "</", "turn>", "<\\turn>", "user\n", "a.", "<|endoftext|>", "  "]
    rows = [(c, t, rng.choice(["user", "assistant", "assi\n<turn>"]), "".join(rng.choices(pieces, k=rng.randrange(8)))) for c in range(60) for t in range(5)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), BYTE)
    tokenizer = chat.chat_tokenizer(BYTE)
    opening, closing = tokenizer.token_to_id(chat.OPEN), tokenizer.token_to_id(chat.CLOSE)
    for r in made.collect():
        own = [x for x in rows if x[0] == r.conv_id]
        assert r.ids.count(opening) == r.ids.count(closing) == len(own)
        assert chat.parse(r.formatted) == [x[2:] for x in own]
        masked = [i for i, m in zip(r.ids, r.loss_mask, strict=True) if m]
        wanted = "".join(chat.escape(x[3]) for x in own if x[2] == "assistant")
        assert not {opening, closing} & set(masked) and tokenizer.decode(masked, skip_special_tokens=False) == wanted
        assert chat.masked_text(r.formatted, r.token_starts, r.token_stops, r.loss_mask) == wanted
        texts = [r.formatted[s.start : s.stop] for s in r.turn_spans]
        assert texts == [chat.escape(x[3]) for x in own]


def test_escapes():
    rng = random.Random(16)
    for _ in range(300):
        text = "".join(rng.choices(["<", "\\", "/", "turn>", "<turn>", "</turn>", "\n", "x"], k=rng.randrange(9)))
        assert chat.unescape(chat.escape(text)) == text
        assert chat.OPEN not in chat.escape(text) and chat.CLOSE not in chat.escape(text)


def test_loss_mask_is_every_overlapping_token():
    token_spans = [(0, 2), (2, 5), (5, 6), (5, 6), (6, 9), (9, 10)]
    assert chat.loss_mask(token_spans, [(1, 3), (4, 4), (5, 7)]) == [True, True, True, True, True, False]
    assert chat.masked_text("abcdefghij", [0, 2, 5, 5, 6], [2, 5, 6, 6, 9], [True, False, True, True, False]) == "abf"
    assert chat.loss_mask([], [(0, 1)]) == []


# 10: neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24)) + rng.normal(size=(20, 24))[rng.integers(0, 20, 3000)]
    rows = [(int(i), [float(v) for v in row], "clash") for i, row in enumerate(x)]
    rows += [(3000, None, ""), (3050, [0.0] * 24, ""), (3100, [float("nan")] + [1.0] * 23, ""), (3150, [None] + [1.0] * 23, ""), (3200, [1e300] * 24, ""), (3201, [2e-300] * 24, ""), (3202, [1.0, 2.0], "")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score string")
    got = ann.search(df, 50, 5, keep=100).collect()
    ids = np.array([*range(3000), 3200, 3201])
    unit = np.vstack([x, np.ones((2, 24))])
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(found) == {*range(0, 3000, 50), 3200}
    right = 0
    for q, ranks in found.items():
        at = int(np.flatnonzero(ids == q)[0])
        s = unit @ unit[at]
        s[at] = -9
        best = {int(ids[k]) for k in np.lexsort((ids, -np.round(s, 12)))[:5]}
        right += len(best & {v for v, _ in ranks.values()})
        assert sorted(ranks) == [1, 2, 3, 4, 5] and q not in {v for v, _ in ranks.values()}
        assert [sc for _, sc in (ranks[k] for k in range(1, 6))] == sorted((sc for _, sc in ranks.values()), reverse=True)
        for v, sc in ranks.values():
            assert sc == pytest.approx(s[int(np.flatnonzero(ids == v)[0])])
    assert right / (5 * len(found)) >= 0.9
    few = ann.search(df.where("vec_id in (0, 1)"), 50, 5).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 1)]
    assert ann.search(df.limit(0), 50, 5).count() == 0


def test_copies_of_a_vector_go_by_id(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 3.0] if i % 2 else [float(v) for v in rng.normal(size=3)]) for i in rng.permutation(1200).tolist()] + [(1250, [2.0, 4.0, 6.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = ann.search(df, 1250, 5, keep=20).where("query_id = 1250").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 3, 5, 7, 9]


def plain_neighbours(rows, every, k):
    """Sorted (query_id, rank, vec_id, score) of all rows of equal length, each but the query's own."""
    out = []
    for q, (i, v) in enumerate(rows):
        if i % every == 0:
            near = sorted((-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 12), j) for r, (j, w) in enumerate(rows) if r != q and len(w) == len(v))
            out += [(i, rank, j, round(-s, 8)) for rank, (s, j) in enumerate(near[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("few", [2048, 30])
def test_repeated_ids_and_lengths_of_their_own(spark, monkeypatch, few):
    monkeypatch.setattr(ann, "FEW", few)
    rng = np.random.default_rng(8)
    rows = [(int(i), rng.normal(size=d).tolist()) for d, n in ((6, 300), (3, 60), (2, 9), (1, 1)) for i in rng.integers(0, 90, n)]
    rows += [rows[0]] * 2 + [(50, [1.0, 2.0, 3.0])] * 3 + [(50, [3.0, 1.0, 2.0]), (51, [2.0, 4.0, 6.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = ann.search(df, 50, 5, keep=300, exact=True).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 8)) for r in got) == plain_neighbours(rows, 50, 5)


def test_the_exact_way_finds_what_a_short_list_misses(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(2500)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = {(q, v) for q, _, v, _ in plain_neighbours(rows, 100, 5)}
    found = [{(r.query_id, r.vec_id) for r in ann.search(df, 100, 5, keep=6, books=2, entries=16, exact=way).collect()} for way in (False, True)]
    assert len(found[0] & want) < len(want) == len(found[1] & want) == len(found[1])


def test_the_shortlist_is_that_of_all_lookup_scores():
    rng = np.random.default_rng(5)
    scores = rng.integers(0, 60, (7, 400)).astype(np.float32)
    same = rng.integers(0, 90, 400)
    for q in range(7):  # equal vectors have equal scores
        scores[q] = scores[q][np.unique(same, return_index=True)[1]][np.unique(same, return_inverse=True)[1]]
    ids = rng.permutation(400)
    best = ann.Best(7, 25, 3)
    for at in range(0, 400, 40):
        best.add(scores[:, at : at + 40], ids[at : at + 40], ids[at : at + 40], same[at : at + 40])
    for q in range(7):
        seen, want = Counter(), []
        for j in np.lexsort((ids, -scores[q])):
            seen[same[j]] += 1
            want += [float(scores[q, j])] * (seen[same[j]] <= 3)
        assert best.scores[q].tolist() == want[:25]
        kept = {s: sorted(i for i, t in zip(best.ids[q].tolist(), best.same[q].tolist(), strict=True) if t == s) for s in set(best.same[q].tolist())}
        for s, got in kept.items():
            if scores[q, np.flatnonzero(same == s)[0]] > want[24]:  # not cut at the end of the list
                assert got == sorted(ids[same == s].tolist())[:3]


def test_smallest_costs():
    rng = np.random.default_rng(6)
    for width in (5, 32, 256, 1024):
        cost = rng.integers(0, 40, (30, width)).astype(np.float32)
        got = ann._smallest(cost, 4)
        assert np.sort(np.take_along_axis(cost, got, 1), 1).tolist() == np.sort(cost, 1)[:, :4].tolist()
        assert all(len(set(r)) == 4 for r in got.tolist())


def test_recall_of_vectors_without_structure(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(8000, 64))
    df = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in enumerate(x)], "vec_id bigint, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for r in ann.search(df, 100, 5).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    right = 0
    for q in range(0, 8000, 100):
        s = unit @ unit[q]
        s[q] = -9
        right += len(found[q] & set(np.argpartition(-s, 5)[:5].tolist()))
    assert right / (5 * len(found)) >= 0.97


def test_beam_encoding_is_no_worse_than_greedy():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 8)).astype(np.float32)
    fitted = ann.fit_codebooks(x, 4, 16)
    errors = []
    for beam in (1, 8):
        codes, norms = fitted.encode(x, beam)
        sums = sum(fitted.books[m][codes[:, m]] for m in range(4))
        assert norms == pytest.approx((sums**2).sum(-1), rel=1e-3, abs=1e-3)
        errors.append(float(((x - sums) ** 2).sum()))
    assert errors[1] <= errors[0]
