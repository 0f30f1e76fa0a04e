"""The fit of op7_lm_scoring: every training word takes part."""

import numpy as np
import pytest

from booktext_spark.llm import lattice

PIECES = {"▁": 0.0, "▁a": -1.0, "a": -1.5, "ab": -0.5, "b": -2.0, "▁ab": -3.0}


def test_expected_counts_of_long_and_spelt_words():
    pieces, by_byte = lattice.normalised(PIECES, [-6.0] * 256)
    model = lattice.Lattice(pieces, by_byte, 0.4)
    n, spelt, drawn = model.expected(["ab" * 1000], np.array([1.0]))  # its probability underflows
    assert model.log_probabilities(["ab" * 1000])[0] < -700
    marks = len("▁".encode())
    letters = sum(k * len(p) for k, p in zip(n, model.names, strict=True)) + spelt[[*b"ab"]].sum() + spelt["▁".encode()[0]]
    assert letters == pytest.approx(2001) and drawn == pytest.approx(n.sum() + spelt.sum()) and marks == 3
    assert model.expected([], np.zeros(0))[2] == 0.0


def test_expected_counts_are_those_of_all_segmentations():
    pieces, by_byte = lattice.normalised(PIECES, [-6.0] * 256)
    model = lattice.Lattice(pieces, by_byte, 0.4)

    def every(text):
        """(log weight, pieces, bytes) of each segmentation."""
        if not text:
            return [(0.0, [], [])]
        data = [*text[0].encode()]
        out = [(w + model.by_byte[data].sum(), p, data + b) for w, p, b in every(text[1:])]
        for k, piece in enumerate(model.names):
            if text.startswith(piece):
                out += [(w + model.weights[k], [k, *p], b) for w, p, b in every(text[len(piece) :])]
        return out

    words, counts = ["abba", "", "é", "bab語", "abba"], np.array([2.0, 1.0, 5.0, 0.5, 1.0])
    want, want_bytes = np.zeros(len(model.names)), np.zeros(256)
    for word, count in zip(words, counts, strict=True):
        found = every("▁" + word)
        total = np.logaddexp.reduce([w for w, _, _ in found])
        for w, p, b in found:
            np.add.at(want, p, count * np.exp(w - total))
            np.add.at(want_bytes, b, count * np.exp(w - total))
    for part in (1, 1000):
        model.PART = part
        n, spelt, drawn = model.expected(words, counts)
        assert n == pytest.approx(want) and spelt == pytest.approx(want_bytes) and drawn == pytest.approx(want.sum() + want_bytes.sum())


def test_fit_learns_from_bytes_and_long_words(spark):
    pieces, by_byte = lattice.normalised({"▁": 0.0, "a": -1.5, "b": -2.0}, [-6.0] * 256)
    fit = lambda word: lattice._fit(spark.createDataFrame([(bytearray(word.encode()), 1)], "word binary, n_train bigint"), pieces, by_byte, 0.4)
    _, new_bytes, _ = fit("語語")
    assert all(new_bytes[b] > by_byte[b] for b in "語".encode()) and new_bytes[0] < by_byte[0]
    new, _, stop = fit("ba" + "b" * 1000)
    assert new["b"] > pieces["b"] and stop == 0.05


def test_fit_weighs_words_by_their_counts(spark):
    pieces, by_byte = lattice.normalised({"▁": 0.0, "a": -2.0, "b": -2.0}, [-6.0] * 256)
    seen = spark.createDataFrame([(bytearray(b"a"), 9), (bytearray(b"b"), 1)], "word binary, n_train bigint")
    new, _, _ = lattice._fit(seen, pieces, by_byte, 0.4)
    assert new["a"] - new["b"] > 1
