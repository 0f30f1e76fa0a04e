"""Periodic runs of words against plain walks."""

import random

import numpy as np
import pytest

from booktext_spark.llm import runs


def plain_runs(w, least, exponent):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(least, exponent * q) and not any(all(w[k] == w[k + r] for k in range(i, i + n - r)) for r in range(1, q)):
                out.append((i, n, q))
            i = j
    return sorted(out)


def sequences(seed, number):
    rng = random.Random(seed)
    for _ in range(number):
        w = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            if len(w) > 6:
                a, p = rng.randrange(len(w)), rng.randrange(1, 8)
                tail = w[a : a + p]
                w = w[:a] + [tail[i % len(tail)] for i in range(rng.randrange(40))] + w[a:]
        yield w


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (4, 3), (9, 5)])
def test_runs_are_those_of_a_plain_walk(least, exponent):
    for w in sequences(least, 800):
        want = plain_runs(w, least, exponent)
        assert runs.periodic_runs(w, least, exponent) == want, w
        assert runs.word_runs([b"%d" % x for x in w], least, exponent) == want, w


def test_each_square_is_a_longest_suffix_of_a_least_period():
    for w in sequences(5, 200):
        automaton = runs.Squares()
        for i, x in enumerate(w):
            found = dict(automaton.read(x))
            for d in range(1, i + 2):
                n = 0
                while n < i + 1 - d and w[i - n] == w[i - n - d]:
                    n += 1
                least = n >= d and not any(all(w[i - k] == w[i - k - r] for k in range(n + d - r)) for r in range(1, d))
                assert found.get(d) == (n + d if least else None), (w[: i + 1], d)


def test_a_long_run_and_words_without_one_are_quick():
    rng = np.random.default_rng(3)
    plain = [b"%d" % x for x in rng.integers(0, 3000, 200_000)]
    assert runs.word_runs(plain) == []
    long = plain[:1000] + [b"%d" % (i % 777) for i in range(50_000)] + plain[1000:3000]
    assert [r[2] for r in runs.word_runs(long)] == [777]
    assert runs.word_runs([b"a"] * 20_000) == [(0, 20_000, 1)]


def test_rows_of_every_kind(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b " * 5), (4, "x"), (4, "x"), (5, "no no no no no no yes"), (6, "é  é  é  é  é  é "), (7, "a b a b a b a b c c c c c c c\x0bd"), (8, "w " * 30_000)]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id bigint, text string, runs string, n_words int")
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.find_runs(df).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (None, 10, [(0, 10, 2)], "a b"), (4, 1, [], "x"), (4, 1, [], "x"), (5, 7, [(0, 6, 1)], "no yes"), (6, 6, [(0, 6, 1)], "é "),
         (7, 16, [(0, 8, 2), (8, 7, 1)], "a b c d"), (8, 30_000, [(0, 30_000, 1)], "w")], key=str)
    assert runs.find_runs(df.limit(0)).collect() == []


def test_overlapping_runs_drop_what_either_drops():
    w = list("abababab") + list("bbbbb")
    found = plain_runs(w, 6, 4)
    assert runs.word_runs(w) == found and len(found) == 2
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    assert runs.kept_words(w, found) == [x for i, x in enumerate(w) if i not in drop]
