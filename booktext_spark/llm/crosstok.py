"""Alignment of two tokenizers' tokens by products of sparse incidence matrices."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from booktext_spark.llm.common import slices, stored

#: A space or line end after a sign that is no white space, and all up to the next one: neither tokenizer has a token across.
CHUNK = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")
#: Bytes of text of which the links are counted together, non-zero elements of a product at a time, and bytes that a chunk in memory takes besides its letters and codes.
BLOCK_BYTES, NONZEROS, ENTRY = 8 << 20, 1 << 18, 190
#: Letters of chunks that A encodes as one string.
JOINED = 1 << 16
#: Code of a linked pair: id of A times this, plus id of B.
PAIR = 1 << 20


@dataclass
class Csr:
    """A sparse matrix by compressed rows."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    @classmethod
    def spans(cls, ends: np.ndarray, low: int, high: int, columns: int, base: int = 0) -> Csr:
        """Rows low to high of tokens by bytes: token i has the bytes from the end before it to its own, less `base`."""
        starts = ends[low - 1] if low else 0
        size = ends[high - 1] - starts
        return cls(np.concatenate([[0], ends[low:high] - starts]), np.arange(starts - base, starts - base + size), np.ones(size, np.int64), columns)

    @classmethod
    def ones(cls, of: np.ndarray, columns: int) -> Csr:
        """One element in each row, in the column that `of` names."""
        return cls(np.arange(len(of) + 1), of, np.ones(len(of), np.int64), columns)

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        rows = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        indptr = np.concatenate([[0], np.cumsum(np.bincount(self.indices, minlength=self.columns))])
        return Csr(indptr, rows[order], self.data[order], len(self.indptr) - 1)

    def __matmul__(self, other: Csr) -> Csr:
        """Gustavson's product: each row is the sum of the rows of `other` that its elements name, added up by column."""
        rows = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        first = other.indptr[self.indices]
        size = other.indptr[self.indices + 1] - first
        at = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
        key = np.repeat(rows, size) * other.columns + other.indices[at]
        value = np.repeat(self.data, size) * other.data[at]
        if np.any(key[1:] < key[:-1]):
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        sums = np.add.reduceat(value, new) if len(new) else value
        row = key[new] // other.columns
        return Csr(np.searchsorted(row, np.arange(len(self.indptr))), key[new] % other.columns, sums, other.columns)


def overlap_links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token of A, token of B, common bytes) of all tokens that share a byte: the product of A's tokens by bytes and B's bytes by tokens.

    ends: where each token ends, in bytes, over the same bytes. Rows of A go in blocks, so that a text of any length takes the memory of one
    block besides the links.
    """
    out, low = [], 0
    while low < len(ends_a):
        base = int(ends_a[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends_a, base + NONZEROS, "right")))
        width = int(ends_a[high - 1]) - base
        first = int(np.searchsorted(ends_b, base, "right"))
        last = int(np.searchsorted(ends_b, base + width, "left")) + 1
        b = Csr.spans(np.clip(ends_b[first:last] - base, 0, width), 0, last - first, width).transposed()
        part = Csr.spans(ends_a, low, high, width, base) @ b
        out.append((np.repeat(np.arange(low, high), np.diff(part.indptr)), part.indices + first, part.data))
        low = high
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (empty, empty, empty)


def end_links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token of A, token of B) of the overlapping tokens that end together."""
    i, j, _ = overlap_links(ends_a, ends_b)
    same = ends_a[i] == ends_b[j]
    return i[same], j[same]


def group_matrices(ends_a: np.ndarray, ends_b: np.ndarray, cuts: np.ndarray) -> tuple[Csr, Csr]:
    """Tokens by groups, for A and B: groups end at cuts, where tokens of both end."""
    return tuple(Csr.ones(np.searchsorted(cuts, ends), len(cuts)) for ends in (ends_a, ends_b))


def group_links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token of A, token of B) of all tokens of one group: the product of the incidence of A's tokens and groups with that of B, transposed."""
    a, b = group_matrices(ends_a, ends_b, ends_a[end_links(ends_a, ends_b)[0]])
    both = a @ b.transposed()
    return np.repeat(np.arange(len(ends_a)), np.diff(both.indptr)), both.indices


class Tokens:
    """Ids of texts by both tokenizers, and the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor

        from booktext_spark.llm.tokens import Encoder

        self.encoder = Encoder(a_path)
        self.a, self.b = self.encoder.tokenizer, SentencePieceProcessor(model_file=b_path)
        byte = {letter: b for b, letter in Encoder._byte_letters().items()}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            if all(c in byte for c in entry):
                self.bytes_a[i] = bytes(byte[c] for c in entry)
        m = self.b
        self.space = [m.piece_to_id("▁")]
        self.bytes_b = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # codes of a group's tokens: ids of A, the last behind a bar, then ids of B, the last behind a semicolon; commas between ids
        self.bar, self.of_b, self.end = len(self.bytes_a), 2 * len(self.bytes_a), 2 * len(self.bytes_a) + len(self.bytes_b)
        self.spelling = np.array([f"{i}{end}".encode() for n, ends in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for end in ends for i in range(n)])

    def _joined(self, chunks: list[str]):
        """Ids of A, a list for each string of chunks: one goes on behind a chunk whose end is no white space, as in a text."""
        low = size = 0
        for k, c in enumerate(chunks):
            size += len(c)
            if size > JOINED or k + 1 == len(chunks) or c[-1].isspace():
                yield self.a.encode_batch_fast(["".join(chunks[low : k + 1])], add_special_tokens=False)[0].ids
                low, size = k + 1, 0

    def ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and how many each chunk has, ids of B and how many. Chunks begin with a space or line end. B puts a space before what it encodes,
        which is the chunk's own or goes again."""
        a = _flat(list(self._joined(chunks)))
        ends, tops = np.cumsum(self.size_a[a]), np.cumsum([len(c.encode()) for c in chunks])
        at = np.searchsorted(ends, tops) + 1
        if len(a) == at[-1] and np.array_equal(ends[at - 1], tops):
            n_a = np.diff(at, prepend=0)
        else:  # a token across chunks, or one without its bytes
            alone = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
            a, n_a = _flat(alone), np.array(list(map(len, alone)))
        b = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        b = [self.space if c == " " else ids if c[0] == " " else ids[1:] for c, ids in zip(chunks, b, strict=True)]
        return a, n_a, _flat(b), np.array(list(map(len, b)))

    def spelt(self, chunks: list[str], a: np.ndarray, b: np.ndarray) -> bool:
        """Whether ids of both sides spell the chunks."""
        text = "".join(chunks).encode()
        return all(b"".join(map(table.__getitem__, ids.tolist())) == text for ids, table in ((a, self.bytes_a), (b, self.bytes_b)))

    def read(self, codes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """codes, which are of A, which end a group, and the pair that ends each group."""
        v = np.frombuffer(codes, "<u4").astype(np.int64)
        of_a, ends = v < self.of_b, v >= self.end
        return v, of_a, ends, (v[of_a & (v >= self.bar)] - self.bar) * PAIR + v[ends] - self.end

    def groups(self, v: np.ndarray) -> bytes:
        """`a1,a2|b1;a3|b2,b3;` of codes."""
        return self.spelling[v].tobytes().translate(None, b"\0")


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))


#: Links and groups of a text: numbers of tokens, codes of the pairs that end together, and the groups' text.
Aligned = tuple[int, int, bytes, str]


class Aligner:
    """Aligns texts chunk by chunk; each distinct chunk once, as long as it is remembered.

    Both tokenizers end a token at the end of a chunk, so links and groups of a text are those of its chunks. A chunk is remembered as one code for
    each of its tokens, which says its id, its side and whether it ends its side of a group: every link ends a group, and every group ends with one.
    Chunks are kept in two generations of `room` bytes, the first one of half of it: when the younger one is full it becomes the older one, whose
    chunks go unless they are met again.
    """

    def __init__(self, a_path: str, b_path: str, room: int = 48 << 20):
        self.tokens = Tokens(a_path, b_path)
        self.room, self.left = room, room // 2
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def align(self, texts: list[str | None]) -> list[list[Aligned] | None]:
        """For each text its links and groups, as a list of one; None for a text without tokens: null, empty, or told differently by a tokenizer's bytes."""
        out = []
        for codes in self.codes(texts):
            v, of_a, _, pairs = self.tokens.read(codes)
            n_a = int(of_a.sum())
            out.append([(n_a, len(v) - n_a, pairs.astype("<i8").tobytes(), self.tokens.groups(v).decode())] if codes else None)
        return out

    def codes(self, texts: list[str | None]) -> list[bytes]:
        """For each text the codes of its tokens, as unsigned 32-bit numbers; none for a text without tokens."""
        if self.left < 0:
            self.known, self.older, self.left = {}, self.known, self.room
        known, older, missing = self.known, self.older, []
        cut = [CHUNK.findall(f" {t}") if t else [] for t in texts]
        for c in dict.fromkeys(chain.from_iterable(cut)):
            if c in known:
                continue
            got = older.get(c)
            if got is None:
                missing.append(c)
            else:
                known[c] = got
                self.left -= len(c) + len(got) + ENTRY
        at = size = 0
        for k, c in enumerate(missing):
            size += len(c)
            if size > 1 << 20 or k + 1 == len(missing):
                self._learn(missing[at : k + 1])
                at, size = k + 1, 0
        out = []
        for chunks in cut:
            found = list(map(known.__getitem__, chunks))
            out.append(b"" if b"" in found else b"".join(found))
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Remembers chunks: one product of the matrices of all of them, which lie on its diagonal. One that a side spells differently has no codes."""
        t = self.tokens
        ids_a, n_a, ids_b, n_b = t.ids(chunks)
        if not t.spelt(chunks, ids_a, ids_b):
            at_a, at_b = (np.cumsum(n)[:-1] for n in (n_a, n_b))
            same = np.array([t.spelt([c], a, b) for c, a, b in zip(chunks, np.split(ids_a, at_a), np.split(ids_b, at_b), strict=True)])
            wrong = [c for c, ok in zip(chunks, same, strict=True) if not ok]
            self.known.update(dict.fromkeys(wrong, b""))
            self.left -= sum(map(len, wrong)) + ENTRY * len(wrong)
            chunks = [c for c, ok in zip(chunks, same, strict=True) if ok]
            if not chunks:
                return
            ids_a, ids_b, n_a, n_b = ids_a[np.repeat(same, n_a)], ids_b[np.repeat(same, n_b)], n_a[same], n_b[same]
        ends_a, ends_b = np.cumsum(t.size_a[ids_a]), np.cumsum(t.size_b[ids_b])
        i, _ = end_links(ends_a, ends_b)
        a, b = group_matrices(ends_a, ends_b, ends_a[i])
        first_a, first_b = (m.transposed().indptr for m in (a, b))
        codes = np.empty(len(ids_a) + len(ids_b), "<u4")
        last_a, last_b = (np.zeros(len(ids), np.int64) for ids in (ids_a, ids_b))
        last_a[first_a[1:] - 1] = t.bar
        last_b[first_b[1:] - 1] = t.end - t.of_b
        codes[np.arange(len(ids_a)) + first_b[a.indices]] = ids_a + last_a
        codes[np.arange(len(ids_b)) + first_a[b.indices + 1]] = ids_b + last_b + t.of_b
        joined = codes.tobytes()
        low = 0
        for c, high in zip(chunks, (4 * np.cumsum(n_a + n_b)).tolist(), strict=True):
            self.known[c] = joined[low:high]
            low = high
        self.left -= sum(map(len, chunks)) + len(joined) + ENTRY * len(chunks)


_ALIGNERS: dict[tuple[str, str, int], Aligner] = {}


def aligner(a_path: str, b_path: str, room: int) -> Aligner:
    """One aligner for each pair of vocabulary files and worker process."""
    if (a_path, b_path, room) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path, room] = Aligner(a_path, b_path, room)
    return _ALIGNERS[a_path, b_path, room]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")


def token_links(docs: DataFrame, a_path: str, b_path: str, kind: str = "overlap", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a_index, b_index, a_id, b_id, n: the links of each text's tokens, a row each.

    kind `overlap`: tokens that share bytes, n of them; `end`: those of them that end together; `group`: tokens between the same two neighbouring
    offsets at which tokens of both end (n is 1). a_path: a byte-level file of the tokenizers library, for a space and the text; b_path: a
    sentencepiece model, for the text. Texts without tokens (see align_documents) give no rows; repeated rows give theirs again.
    """
    find = {"overlap": overlap_links, "end": lambda a, b: (*end_links(a, b), None), "group": lambda a, b: (*group_links(a, b), None)}[kind]

    def run(batches):
        import pyarrow as pa

        tokens = aligner(a_path, b_path, 48 << 20).tokens
        for part in slices(batches, 1):
            doc, text = part.column(0), part.column(1)[0].as_py()
            if not text:
                continue
            chunks = CHUNK.findall(f" {text}")
            a, _, b, _ = tokens.ids(chunks)
            if not tokens.spelt(chunks, a, b):
                continue
            i, j, n = find(np.cumsum(tokens.size_a[a]), np.cumsum(tokens.size_b[b]))
            n = np.ones(len(i), np.int64) if n is None else n
            for lo in range(0, len(i), 1 << 16):
                s = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(np.zeros(len(i[s]), np.int64))), *map(pa.array, (i[s], j[s], a[i[s]], b[j[s]], n[s]))], names=["doc_id", "a_index", "b_index", "a_id", "b_id", "n"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, a_index bigint, b_index bigint, a_id bigint, b_id bigint, n bigint")


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", memory: int = 48 << 20) -> DataFrame:
    """block, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs of every row of docs.

    A tokenizes a space and the text, B the text, which it puts a space before; special tokens' strings are plain text. Groups
    lie between neighbouring byte offsets at which tokens of both end; links join tokens that end together. groups_sha256: of `a1,a2|b1;a3|b2,b3`,
    ids in order. pairs: id of A * PAIR + id of B for each link, in order. Texts that are null or empty, or of which either side's tokens
    do not spell a space and the text, have zeros, no pairs and '' for the digest. block: neighbouring rows of about BLOCK_BYTES of text in one task.
    Repeated rows count each; an empty table gives no rows. memory: bytes that a worker's memory of chunks takes.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        both = aligner(a_path, b_path, memory)
        block, held = TaskContext.get().partitionId() << 33, 0
        for part in slices(batches, 200):
            texts = part.column(1).to_pylist()
            codes = both.codes(texts)
            v, of_a, ends, pairs = both.tokens.read(b"".join(codes))
            tops = np.cumsum([0, *(len(c) // 4 for c in codes)])
            n_a, n_links = (np.diff(np.concatenate([[0], np.cumsum(x)])[tops]) for x in (of_a, ends))
            blocks, digests = [], []
            for text, low, high in zip(texts, tops[:-1].tolist(), tops[1:].tolist(), strict=True):
                blocks.append(block)
                digests.append(hashlib.sha256(both.tokens.groups(v[low:high])[:-1]).hexdigest() if high > low else "")
                held += len(text or "")
                if held > BLOCK_BYTES:
                    block, held = block + 1, 0
            columns = [pa.array(c, kind) for c, kind in zip((blocks, n_a, np.diff(tops) - n_a, n_links, n_links, digests), [pa.int64()] * 5 + [pa.string()], strict=True)]
            offsets = pa.array(np.concatenate([[0], np.cumsum(n_links)]).astype(np.int32))
            listed = pa.ListArray.from_arrays(offsets, pa.array(pairs))
            yield pa.RecordBatch.from_arrays([columns[0], part.column(0), *columns[1:], listed], names=["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, n (its links in the whole corpus), best (whether no other pair of its id of B has more) from blocks(block, pair, n)."""
    counts = blocks.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair") % PAIR)
    counts = stored(counts, "align-counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of B
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_corpus(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", memory: int = 48 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs, see align_documents.

    A pair of ids counts as often as a link of any text joins it. n_best: links whose pair has the highest count of its id of B, ties
    included; count_sum: the sum of the counts of the links. Pairs are counted in each block of texts first, and a block meets the counts of its own pairs once, so
    that neither a frequent pair nor a long text gathers rows by the number of documents.
    """
    aligned = stored(align_documents(docs, a_path, b_path, id_col, text_col, memory), "align-documents")
    blocks = aligned.select("block", F.explode("pairs").alias("pair")).groupBy("block", "pair").agg(F.count("*").alias("n"))
    blocks = stored(blocks, "align-blocks")
    looked = blocks.select("block", "pair").join(pair_counts(blocks), "pair").select("block", "pair", "n", "best")

    def weigh(texts, counts):
        import pyarrow as pa

        order = np.argsort(counts.column("pair").to_numpy())
        pair, n, best = (counts.column(c).to_numpy()[order] for c in ("pair", "n", "best"))
        made = texts.drop_columns(["block", "pairs"])
        lists = texts.column("pairs").combine_chunks()
        values, ends = lists.flatten().to_numpy(), np.cumsum(texts.column("n_links").to_numpy())
        at = np.searchsorted(pair, values)
        sums = [np.concatenate([[0], np.cumsum(x[at])]) if len(at) else np.zeros(1, np.int64) for x in (best.astype(np.int64), n)]
        n_best, count_sum = (np.diff(s[np.concatenate([[0], ends])]) for s in sums)
        return made.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum)).select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return aligned.groupBy("block").cogroup(looked.groupBy("block")).applyInArrow(weigh, schema)
