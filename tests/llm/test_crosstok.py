"""Alignment of two tokenizers' tokens against plain walks over the libraries' own output."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from booktext_spark.llm import crosstok, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE = {chr(b): b for b in LETTERS} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in LETTERS)}


class Library:
    """Both libraries, called on whole texts."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True

    def tokens(self, text):
        """[(id, bytes)] of A and of B; none where either does not spell a space and the text."""
        if not text:
            return [], []
        a = [(i, bytes(BYTE[c] for c in self.a.id_to_token(i))) for i in self.a.encode(f" {text}", add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()) for i in self.b.encode(text) for p in [self.b.id_to_piece(i)]]
        return (a, b) if b"".join(x for _, x in a) == f" {text}".encode() == b"".join(x for _, x in b) else ([], [])


def spans(tokens):
    at, out = 0, []
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def plain(text, library):
    """(n_a, n_b, groups' text, linked id pairs)."""
    a, b = (spans(x) for x in library.tokens(text))
    links = [(i, j) for i, _, e in a for j, _, f in b if e == f]
    low, groups = 0, []
    for cut in sorted({e for *_, e in a} & {e for *_, e in b}):
        groups.append("|".join(",".join(str(i) for i, _, e in x if low < e <= cut) for x in (a, b)))
        low = cut
    return len(a), len(b), groups, links


def plain_corpus(texts, library):
    made = [plain(t, library) for t in texts]
    counts = Counter(p for *_, links in made for p in links)
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    return [(n_a, n_b, len(g), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if n_a else "") for n_a, n_b, g, links in made]


PARTS = ["a", "the", "  ", "\n", " \n", "\t", "\xa0", "é", "é", "漢字", "\U0001f600", "<s>", "<|endoftext|>", "<0x0A>", "'s", "word", "\x1c", "\x1d ", "▁", "1234", "....", " ", "\r\n", "İ", "　", "\x00", "​"]


def random_texts(seed, number):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) + rng.choice(["", " "]) for _ in range(rng.randrange(12))) for _ in range(number)]


def test_chunks_give_what_whole_texts_give():
    library, aligner = Library(), crosstok.Aligner(A, B, room=100_000)
    for text in random_texts(1, 1500):
        n_a, n_b, groups, links = plain(text, library)
        found = aligner.align([text])[0]
        assert (found is None) == (not n_a), text
        found = found or []
        assert (sum(x[0] for x in found), sum(x[1] for x in found)) == (n_a, n_b)
        assert "".join(x[3] for x in found)[:-1] == ";".join(groups), text
        assert np.frombuffer(b"".join(x[2] for x in found), "<i8").tolist() == [i * crosstok.PAIR + j for i, j in links]


def test_chunks_of_many_texts_are_encoded_together(monkeypatch):
    library, texts = Library(), [None, "", *random_texts(6, 400), "x" * 3000, "  ", "a ", "a  b\n"]
    want = [plain(t, library) for t in texts]
    for joined, room in ((1 << 16, 48 << 20), (40, 20_000)):
        monkeypatch.setattr(crosstok, "JOINED", joined)
        aligner = crosstok.Aligner(A, B, room=room)
        calls, encode = [], aligner.tokens._joined
        monkeypatch.setattr(aligner.tokens, "_joined", lambda chunks, encode=encode, calls=calls: (calls.append(ids) or ids for ids in encode(chunks)))
        for _ in range(2):  # the second time most are remembered
            for t, (n_a, n_b, groups, links), codes in zip(texts, want, aligner.codes(texts), strict=True):
                v, of_a, ends, pairs = aligner.tokens.read(codes)
                assert (int(of_a.sum()), len(v) - int(of_a.sum()), int(ends.sum())) == (n_a, n_b, len(groups)), t
                assert aligner.tokens.groups(v)[:-1].decode() == ";".join(groups), t
                assert pairs.tolist() == [i * crosstok.PAIR + j for i, j in links]
        if joined == 1 << 16:  # not a call for each chunk
            chunks = {c for t in texts if t for c in crosstok.CHUNK.findall(f" {t}")}
            assert len(calls) <= 2 + sum(c[-1].isspace() for c in chunks) < len(chunks)


def test_products_are_plain_ones():
    rng = np.random.default_rng(4)
    for _ in range(100):
        x, y = (rng.integers(0, 3, (rng.integers(1, 7), 5)) for _ in range(2))
        y = y.T if y.shape[0] != 5 else y
        csr = [crosstok.Csr(np.concatenate([[0], np.cumsum((m != 0).sum(1))]), np.nonzero(m)[1], m[m != 0], m.shape[1]) for m in (x, y)]
        got = csr[0] @ csr[1]
        dense = np.zeros((x.shape[0], y.shape[1]), int)
        for r in range(x.shape[0]):
            dense[r, got.indices[got.indptr[r] : got.indptr[r + 1]]] = got.data[got.indptr[r] : got.indptr[r + 1]]
        assert (dense == x @ y).all()
        t = csr[0].transposed()
        back = np.zeros(x.T.shape, int)
        for r in range(5):
            back[r, t.indices[t.indptr[r] : t.indptr[r + 1]]] = t.data[t.indptr[r] : t.indptr[r + 1]]
        assert (back == x.T).all()


@pytest.mark.parametrize("block", [3, 1 << 18])
def test_links_of_random_cuts(monkeypatch, block):
    monkeypatch.setattr(crosstok, "NONZEROS", block)
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        a, b = (np.unique(np.append(rng.integers(1, n + 1, rng.integers(1, 15)), n)) for _ in range(2))
        low = [np.concatenate([[0], x[:-1]]) for x in (a, b)]
        pairs = [(i, j) for i in range(len(a)) for j in range(len(b))]
        common = [min(a[i], b[j]) - max(low[0][i], low[1][j]) for i, j in pairs]
        assert list(zip(*crosstok.overlap_links(a, b), strict=True)) == [(*p, c) for p, c in zip(pairs, common, strict=True) if c > 0]
        assert list(zip(*crosstok.end_links(a, b), strict=True)) == [p for p in pairs if a[p[0]] == b[p[1]]]
        cuts = sorted(set(a.tolist()) & set(b.tolist()))
        group = lambda e: sum(c < e for c in cuts)
        assert list(zip(*crosstok.group_links(a, b), strict=True)) == [p for p in pairs if group(a[p[0]]) == group(b[p[1]])]


def test_rows_of_every_kind(spark, monkeypatch):
    monkeypatch.setattr(crosstok, "BLOCK_BYTES", 50)
    texts = [None, "", " ", "a b c", "a b c", "x" * 3000, "no spaces ▁ here", "café \U0001f600\n\nnew <|endoftext|> line", "the the the", *random_texts(2, 60)]
    ids = [None, 1, 2, 3, 3, *range(4, len(texts) - 1)]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in zip(ids, texts, strict=True)], "doc_id bigint, text string, block string, pair int").repartition(3)
    made = crosstok.align_corpus(df, A, B)
    assert made.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(d, *x) for d, x in zip(ids, plain_corpus(texts, Library()), strict=True)]
    assert sorted(map(tuple, made.collect()), key=str) == sorted(want, key=str)
    assert crosstok.align_corpus(df.limit(0), A, B).collect() == []


def test_links_as_rows(spark):
    library, texts = Library(), [t for t in random_texts(3, 60) if t] + ["international co-operation"]
    df = spark.createDataFrame(list(enumerate([None, *texts])), "doc_id bigint, text string")
    for kind in ("overlap", "end", "group"):
        want = set()
        for d, t in enumerate(texts, 1):
            a, b = (spans(x) for x in library.tokens(t))
            cuts = sorted({e for *_, e in a} & {e for *_, e in b})
            for i, (x, s, e) in enumerate(a):
                for j, (y, u, f) in enumerate(b):
                    n = min(e, f) - max(s, u) if kind == "overlap" else e == f if kind == "end" else sum(c < e for c in cuts) == sum(c < f for c in cuts)
                    if n > 0:
                        want.add((d, i, j, x, y, int(n)))
        rows = [tuple(r) for r in crosstok.token_links(df, A, B, kind).collect()]
        assert set(rows) == want and len(rows) == len(want)


def test_registered_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = [(r.doc_id, *x) for r, x in zip(docs, plain_corpus([r.text for r in docs], Library()), strict=True)]
    assert sorted(map(tuple, queries.QUERIES["op11_token_alignment"](spark, sf_dir).collect())) == sorted(want)
