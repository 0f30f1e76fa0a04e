"""Set-similarity joins and longest common runs against plain walks over all pairs."""

import random

import numpy as np
import pytest

from booktext_spark.functions.automaton import SuffixAutomaton
from booktext_spark.functions.text import common_run
from booktext_spark.operators import copying

TEXTS = "id bigint, text string"


def grams(text, n):
    return {text[i : i + n] for i in range(len(text) - n + 1)}


def edited(rng, texts, number, letters="abcd"):
    """Pieces of texts with some letters changed, and texts of their own."""
    out = []
    for _ in range(number):
        t = rng.choice(texts)
        a = rng.randrange(len(t))
        piece = list(t[a : a + rng.randrange(5, 80)])
        for _ in range(rng.randrange(4)):
            piece[rng.randrange(len(piece))] = rng.choice(letters)
        out.append("".join(piece) + "".join(rng.choices(letters, k=rng.randrange(30))))
    return out


def texts_of(seed, refs, outputs, letters="abcdefgh"):
    rng = random.Random(seed)
    ref = ["".join(rng.choices(letters, k=rng.randrange(1, 120))) for _ in range(refs)]
    return edited(rng, ref, outputs, letters), ref


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aé漢\U0001f600"])
def test_automaton_names_the_longest_run_with_each_text(letters):
    for seed in range(60):
        outputs, refs = texts_of(seed, 6, 4, letters)
        refs += [refs[0], "", refs[1][:5], letters[0] * 20]
        known = SuffixAutomaton(refs)
        for least in (1, 3, 8):
            for text in [*outputs, "", letters[0] * 30]:
                want = {k: n for k, r in enumerate(refs) if (n := common_run(text, r)) >= least}
                assert known.common_runs(text, least) == want


@pytest.mark.parametrize("shard,portion", [(1 << 16, 1 << 22), (200, 300), (1, 1)])
def test_longest_runs_in_shards_and_portions(spark, monkeypatch, shard, portion):
    monkeypatch.setattr(copying, "SHARD_CHARS", shard)
    monkeypatch.setattr(copying, "PORTION", portion)
    outputs, refs = texts_of(7, 12, 25)
    outs = [*enumerate(outputs), (100, ""), (3, outputs[4]), (3, outputs[3]), (None, refs[0])]
    got = {(r.output_id, r.ref_id): r.lcs for r in copying.longest_common_run(spark.createDataFrame(outs, TEXTS), spark.createDataFrame([*enumerate(refs), (50, ""), (2, refs[5])], TEXTS), 6).collect()}
    want = {}
    for o, a in outs:
        for r, b in [*enumerate(refs), (2, refs[5])]:
            if (n := common_run(a, b)) >= 6:
                want[o, r] = max(want.get((o, r), 0), n)
    assert got == want


def test_runs_of_no_texts(spark):
    some, none = spark.createDataFrame([(1, "abcdefghij")], TEXTS), spark.createDataFrame([], TEXTS)
    assert copying.longest_common_run(some, none).collect() == copying.longest_common_run(none, some).collect() == []
    assert copying.similar_pairs(some, none).collect() == copying.similar_pairs(none, some).collect() == []


@pytest.mark.parametrize("threshold", [0.02, 0.3, 0.44, 0.8, 1.0])
@pytest.mark.parametrize("heavy", [20_000, 3])
def test_similar_pairs_are_those_of_a_walk_over_all_pairs(spark, monkeypatch, threshold, heavy):
    monkeypatch.setattr(copying, "HEAVY", heavy)
    outputs, refs = texts_of(11, 40, 60)
    hot = "xyxyxyxyzzxyxyxy"
    outputs += [hot + "abc"] * 12 + [hot * 2] * 8 + [f"{hot}{t[:9]}" for t in outputs[:20]]
    refs += [hot] * 5 + [hot + r for r in refs[:15]] + [refs[0]]
    got = copying.similar_pairs(spark.createDataFrame(list(enumerate(outputs)), TEXTS), spark.createDataFrame(list(enumerate(refs)), TEXTS), 4, threshold).collect()
    want = {}
    for o, a in enumerate(outputs):
        for r, b in enumerate(refs):
            x, both = grams(a, 4), len(grams(a, 4) & grams(b, 4))
            if x and both and both >= threshold * len(x) - 1e-9:
                want[o, r] = (both, len(x), both / len(x))
    assert {(r.output_id, r.ref_id): (r.shared, r.size, r.overlap) for r in got} == want and len(got) == len(want)


def test_few_candidates_are_looked_at(spark):
    rng = random.Random(4)
    common = ["".join(rng.choices("abcdefghij", k=12)) for _ in range(10)]  # phrases that all texts have
    text = lambda: "".join(rng.choice(common) + "".join(rng.choices("abcdefghijklmnop", k=25)) for _ in range(6))
    refs = [text() for _ in range(150)]
    outputs = [text() for _ in range(140)] + refs[:10]
    outs, known = (spark.createDataFrame(list(enumerate(x)), TEXTS) for x in (outputs, refs))
    every = copying.copy_candidates(outs, known).count()
    near = copying.overlap_candidates(outs, known, 8, 0.44).count()
    assert near >= 10 and every > 10_000 and near < every / 10


def test_filter_keeps_every_gram_of_the_references(spark):
    outputs, refs = texts_of(13, 20, 30)
    outs, known = (spark.createDataFrame(list(enumerate(x)), TEXTS) for x in (outputs, refs))
    theirs = copying.gram_rows(known, 5)
    bits = copying.gram_filter(theirs)
    assert len(bits) == copying.FILTER_BITS // 8 and np.unpackbits(bits).sum() <= theirs.select("gram").distinct().count()
    names = {r.gram for r in theirs.collect()}
    assert {(r.id, r.gram, r.size) for r in copying.gram_rows(outs, 5, keep=bits).collect()} == {(r.id, r.gram, r.size) for r in copying.gram_rows(outs, 5).collect() if r.gram in names}
    assert {(r.id, r.at) for r in copying.gram_rows(outs, 5, False, bits).collect()} == {(r.id, r.at) for r in copying.gram_rows(outs, 5, False).collect() if r.gram in names}


def test_grams_that_no_output_has_are_not_written(spark, monkeypatch):
    """A few outputs against many references, some of them copies: the pairs of brute force, and no table with a row for each gram of the references."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=400))
    outs = [(k, word()[:120]) for k in range(4)]
    refs = [(100 + k, word()) for k in range(60)]
    refs += [(200 + k, refs[k][1][:50] + outs[k][1][: 70 + 20 * k] + refs[k][1]) for k in range(4)] + [(300, refs[0][1]), (301, outs[0][1]), (302, outs[0][1])]
    written = []

    def counted(df, what, stored=copying.stored):
        written.append((what, (out := stored(df, what)).count()))
        return out

    monkeypatch.setattr(copying, "stored", counted)
    frames = [spark.createDataFrame(rows, "id int, text string") for rows in (outs, refs)]
    got = {(r.output_id, r.ref_id): (r.shared, r.size) for r in copying.similar_pairs(*frames).collect()}
    sets = [[(k, {t[i : i + 8] for i in range(len(t) - 7)}) for k, t in rows] for rows in (outs, refs)]
    want = {(a, b): (len(x & y), len(x)) for a, x in sets[0] for b, y in sets[1] if len(x & y) >= 0.44 * len(x)}
    assert got == want and len(want) >= 6
    assert max(n for _, n in written) < 1000, written
