"""Language-model scores: every segmentation of a word over an existing subword vocabulary counts."""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from booktext_spark.llm.common import space_words, stored, utf8

#: Words with the largest counts that each task holds: a bound on what is broadcast.
HEAD = 1 << 18
#: Prior weight of the lattice beside the counts, as a number of tokens for each distinct word.
PRIOR = 0.8
LOG10 = math.log(10)


def vocabulary_pieces(path: str) -> tuple[dict[str, float], list[float]]:
    """(log weight of each piece, log weights of the 256 byte pieces) from a sentencepiece model file.

    Unigram scores are log probabilities as they are. The scores of a merge vocabulary are negative merge ranks r;
    those are read as Zipf's law, 1 / (r + 2.7).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    scores = [model.get_score(i) for i in range(n)]
    ranks = min(scores) < -1000
    pieces, by_byte = {}, [-20.0] * 256
    for i in range(n):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            by_byte[int(name[1:-1], 16)] = -math.log(n + 2.7) if ranks else scores[i] or -20.0
        elif not model.is_control(i) and not model.is_unknown(i):
            pieces[name] = -math.log(2.7 - scores[i]) if ranks else scores[i]
    return normalised(pieces, by_byte)


def normalised(pieces: dict[str, float], by_byte: list[float]) -> tuple[dict[str, float], list[float]]:
    total = math.log(math.fsum([*map(math.exp, pieces.values()), *map(math.exp, by_byte)]))
    return {p: w - total for p, w in pieces.items()}, [w - total for w in by_byte]


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S = np.uint64(29)


def _longer(names: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """64-bit names of strings that are one character longer."""
    h = (names + codes + _M2) * _M1
    h ^= h >> _S
    h *= _M2
    return h ^ (h >> _S)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


@dataclass
class _Arcs:
    """Arcs of one length over the words of a part, by the place in the word where they end."""

    length: int
    start: np.ndarray  # node
    weight: np.ndarray  # natural log
    piece: np.ndarray  # number of the piece, or of the character for arcs spelt in bytes
    bounds: list[int]  # arcs that end at place e are bounds[e]:bounds[e + 1]
    spelt: bool = False


class Lattice:
    """Marginal probability of words: their pieces are drawn one by one, the last followed by the end of the word.

    Every way to cut "▁" and the word into pieces counts, and any character may be spelt in byte pieces too. Forward and
    backward sums are logs, taken for many words at once: all arcs of one length that end at one place in their words at a time.
    """

    #: Characters of the words that are weighed together.
    PART = 200_000

    def __init__(self, pieces: dict[str, float], by_byte: list[float], stop: float):
        self.names = list(pieces)
        self.log_stop, self.log_go = math.log(stop), math.log1p(-stop)
        self.weights = np.array([*pieces.values()], float) + self.log_go
        self.by_byte = np.array(by_byte) + self.log_go
        self.longest = max(map(len, pieces), default=1)
        # all beginnings of pieces, so that a search along a word can end early
        codes, size = _codes("".join(self.names)), np.array([len(p) for p in self.names], int)
        first, row, h = np.cumsum(size) - size, np.arange(len(size)), np.zeros(len(size), np.uint64)
        keys, ids = [], []
        for n in range(1, self.longest + 1):
            more = size[row] >= n
            row, h = row[more], _longer(h[more], codes[first[row[more]] + n - 1])
            keys.append(h)
            ids.append(np.where(size[row] == n, row, -1))
        keys, ids = np.concatenate(keys), np.concatenate(ids)
        order = np.lexsort((ids, keys))
        last = np.flatnonzero(np.append(keys[order][1:] != keys[order][:-1], True)) if len(order) else order
        self.keys, self.ids = keys[order][last], ids[order][last]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.keys >> np.uint64(42)] = True

    def _parts(self, words: list[str]) -> Iterator[np.ndarray]:
        """Numbers of words, of like lengths, in parts of some PART characters; a longer word is alone."""
        size = np.array([len(w) + 1 for w in words], int)
        order = np.argsort(size, kind="stable")
        ends = np.cumsum(size[order])
        at = 0
        while at < len(order):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + self.PART, "right")))
            yield order[at:upto]
            at = upto

    def _arcs(self, words: list[str]) -> tuple[list[_Arcs], np.ndarray, np.ndarray, np.ndarray]:
        """(arcs by length, first and last node of each word, characters): a word has a node before, between and behind its characters."""
        codes, size = _codes("▁" + "▁".join(words)), np.array([len(w) + 1 for w in words], int)
        begin, word = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
        pos = np.arange(len(codes))
        node, place, room = pos + word, pos - begin[word], (begin + size)[word] - pos
        top = int(size.max())

        def made(length, pos, weight, piece, spelt=False):
            end = place[pos] + length
            order = np.argsort(end, kind="stable")
            return _Arcs(length, node[pos][order], weight[order], piece[order], np.searchsorted(end[order], np.arange(top + 2)).tolist(), spelt)

        chars, number = np.unique(codes, return_inverse=True)
        spelling = np.array([self.by_byte[list(chr(c).encode(errors="replace"))].sum() for c in chars.tolist()])
        arcs = [made(1, pos, spelling[number], number, True)]
        h = np.zeros(len(pos), np.uint64)
        for n in range(1, self.longest + 1):
            more = room[pos] >= n
            pos = pos[more]
            h = _longer(h[more], codes[pos + n - 1])
            maybe = self.maybe[h >> np.uint64(42)]
            pos, h = pos[maybe], h[maybe]
            at = np.searchsorted(self.keys, h)
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == h if len(self.keys) else np.zeros(len(h), bool)
            pos, h, piece = pos[known], h[known], self.ids[at[known]]
            whole = piece >= 0
            if whole.any():
                arcs.append(made(n, pos[whole], self.weights[piece[whole]], piece[whole]))
            if not len(pos):
                break
        first = begin + np.arange(len(size))
        return arcs, first, first + size, chars

    @staticmethod
    def _ahead(arcs: list[_Arcs], first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all ways from a word's first node to each of its nodes."""
        sums = np.full(int(last[-1]) + 1, -np.inf)
        sums[first] = 0.0
        for end in range(1, len(arcs[0].bounds) - 1):
            for a in arcs:
                low, high = a.bounds[end], a.bounds[end + 1]
                if low < high:
                    start = a.start[low:high]
                    sums[start + a.length] = np.logaddexp(sums[start + a.length], sums[start] + a.weight[low:high])
        return sums

    @staticmethod
    def _behind(arcs: list[_Arcs], last: np.ndarray) -> np.ndarray:
        """The same from each node to the word's last one."""
        sums = np.full(int(last[-1]) + 1, -np.inf)
        sums[last] = 0.0
        top = len(arcs[0].bounds) - 2
        for begin in range(top - 1, -1, -1):
            for a in arcs:
                if (end := begin + a.length) <= top and (low := a.bounds[end]) < (high := a.bounds[end + 1]):
                    start = a.start[low:high]
                    sums[start] = np.logaddexp(sums[start], sums[start + a.length] + a.weight[low:high])
        return sums

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural logs of the words' marginal probabilities."""
        out = np.zeros(len(words))
        for part in self._parts(words):
            arcs, first, last, _ = self._arcs([words[i] for i in part])
            out[part] = self._ahead(arcs, first, last)[last]
        return out - self.log_go + self.log_stop

    def expected(self, words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(expected number of each piece, of each byte piece, of all) in words that occur `counts` times."""
        pieces, spelt = np.zeros(len(self.names)), np.zeros(256)
        for part in self._parts(words):
            arcs, first, last, chars = self._arcs([words[i] for i in part])
            ahead, behind = self._ahead(arcs, first, last), self._behind(arcs, last)
            word = np.repeat(np.arange(len(part)), last - first + 1)
            for a in arcs:
                of = word[a.start]
                share = np.exp(np.minimum(0.0, ahead[a.start] + a.weight + behind[a.start + a.length] - ahead[last][of])) * counts[part][of]
                if a.spelt:
                    for c, n in zip(chars.tolist(), np.bincount(a.piece, share, len(chars)).tolist(), strict=True):
                        for byte in chr(c).encode(errors="replace"):
                            spelt[byte] += n
                else:
                    pieces += np.bincount(a.piece, share, len(pieces))
        return pieces, spelt, float(pieces.sum() + spelt.sum())


def _words(docs: DataFrame) -> DataFrame:
    """word (null: end of text), n_train, n_all; a task's words are counted before they are shuffled."""

    def run(batches):
        import pyarrow as pa

        def out():
            names = list(train.keys() | held.keys())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([train[w] for w in names], pa.int64()), pa.array([train[w] + held[w] for w in names], pa.int64())], names=["word", "n_train", "n_all"])

        train: Counter[bytes] = Counter()
        held: Counter[bytes] = Counter()
        for batch in batches:
            for text, out_of_it in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                (held if out_of_it else train).update(space_words(text))
            if len(train) + len(held) > 400_000:
                yield out()
                train.clear()
                held.clear()
        if train or held:
            yield out()

    counted = docs.select("text", "held_out").mapInArrow(run, "word binary, n_train bigint, n_all bigint")
    return counted.groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def _spread(words: DataFrame) -> DataFrame:
    """words in as many partitions as there are cores, at least: a few megabytes of words are much work."""
    cores = words.sparkSession.sparkContext.defaultParallelism
    return words if words.rdd.getNumPartitions() >= cores else words.repartition(cores)


def _together(batches, rows: int = 20_000):
    """Arrow batches of `rows` rows or more, but for the last."""
    import pyarrow as pa

    waiting, n = [], 0
    for batch in batches:
        waiting.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
            waiting, n = [], 0
    if n:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


class _Places(dict):
    """Places of words; -1 for all others, without keeping them."""

    def __missing__(self, word: bytes) -> int:
        return -1


def score_texts(docs: DataFrame, vocabulary: str, held_out: F.Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, blend_score for each row.

    Tokens are runs without ASCII white space, A-Z lower-cased, and one end for each text; null is an empty text.
    Counts are those of the rows that `held_out` does not hold. base_score is the add-one unigram score.
    score is the log10 marginal probability of the text: of each word, over all segmentations into pieces of the vocabulary, whose
    weights are fitted to the training words and their counts by `rounds` of expectation maximisation, and of the end,
    which has its share of the training tokens (one in 100 without any). blend_score smooths
    the token counts by that probability, (c + a * p) / (N + a). Nothing is sampled. The most
    frequent HEAD words are broadcast, all others are joined by two hashes. Repeated rows are scored each; without training rows
    every count is 0; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    words = _spread(stored(_words(rows), "lm-words"))
    texts = rows.where("not held_out").count()
    n, v = words.where("n_train > 0").agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.count("*")).first()
    n, v = n + texts, v + (texts > 0)
    a = max(1.0, PRIOR * v)

    pieces, by_byte = vocabulary_pieces(vocabulary)
    stop = 0.3
    for _ in range(rounds):
        pieces, by_byte, stop = _fit(words.where("n_train > 0"), pieces, by_byte, stop)
    model = spark.sparkContext.broadcast(pickle.dumps((pieces, by_byte, stop)))

    p_end = texts / n if texts else 0.01
    log_word = math.log1p(-p_end) if p_end < 1 else 0.0  # all training texts are empty: words have no share to lose

    def weigh(batches):
        import pyarrow as pa

        lattice = Lattice(*pickle.loads(model.value))
        for batch in _together(batches):
            logs = lattice.log_probabilities([w.decode(errors="replace") for w in batch.column(0).to_pylist()]) + log_word
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs, pa.float64())], names=["word", "n_train", "n_all", "log_lattice"])

    weighed = stored(words.mapInArrow(weigh, "word binary, n_train bigint, n_all bigint, log_lattice double"), "lm-weights")
    # the counts from which on there are at most HEAD words, by counts in steps of a sixteenth of a power of two
    step = F.floor(F.log2("n_all") * 16)
    size, least = 0, math.inf
    for r in weighed.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        if (size := size + r["count"]) > HEAD:
            break
        least = r.step
    head = weighed.where(step >= least).select("word", "n_train", "log_lattice").toArrow() if least < math.inf else None
    ship = spark.sparkContext.broadcast(pickle.dumps([c.to_pylist() for c in head.columns] if head else [[], [], []]))
    base_log = math.log10(n + v + 1)

    def value(c: int, log_lattice: float) -> tuple[int, float, float, float]:
        """known, base, score, blend of one token, logs to base 10."""
        return int(c > 0), math.log10(c + 1) - base_log, log_lattice / LOG10, math.log10((c + a * math.exp(log_lattice)) / (n + a)) if c else (math.log(a / (n + a)) + log_lattice) / LOG10

    of_end = np.array(value(texts, math.log(p_end)))

    def partial(batches):
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        names, counts, logs = pickle.loads(ship.value)
        values = np.array([*(value(c, x) for c, x in zip(counts, logs, strict=True)), (0.0, 0.0, 0.0, 0.0)]).T.copy()
        place = _Places(zip(names, range(len(names)), strict=True))
        del names, counts, logs
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for text in utf8(batch.column(1)):
                found = space_words(text)
                places = np.fromiter(map(place.__getitem__, found), np.int64, len(found))
                k, b, s, x = (values[:, places].sum(1) + of_end).tolist()
                rest = [found[i] for i in np.flatnonzero(places < 0)]
                names = np.array([xxhash.xxh64_intdigest(w, 42) for w in rest], np.uint64).view(np.int64)
                out.append((at, len(found) + 1, round(k), b, s, x, names, np.array([zlib.crc32(w) for w in rest], np.int64)))
                at += 1
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "lattice", "blend", "rest", "checks"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    part = stored(rows.select("doc_id", "text", "held_out").mapInArrow(partial, f"doc_id {kind}, held_out boolean, row bigint, n_tokens bigint, n_known bigint, base double, lattice double, blend double, rest array<bigint>, checks array<bigint>"), "lm-rows")
    # words by a hash of 64 bits and a checksum of 32, which do not meet by chance among any number of words that can be stored
    wanted = part.select("row", F.explode(F.arrays_zip("rest", "checks")).alias("w")).select("row", F.col("w.rest").alias("hash"), F.col("w.checks").alias("check"))
    tail = wanted.join(weighed.select(F.xxhash64("word").alias("hash"), F.crc32("word").alias("check"), "n_train", "log_lattice"), ["hash", "check"])
    c, x = F.col("n_train"), F.col("log_lattice")
    blend = F.when(c > 0, F.log10((c + a * F.exp(x)) / (n + a))).otherwise((math.log(a / (n + a)) + x) / LOG10)
    sums = tail.groupBy("row").agg(F.sum((c > 0).cast("bigint")).alias("k"), F.sum(F.log10(c + 1) - base_log).alias("b"), F.sum(x / LOG10).alias("x"), F.sum(blend).alias("s"))
    plus = lambda one, other: F.col(one) + F.coalesce(F.col(other), F.lit(0))
    return part.drop("rest", "checks").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "k").alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        plus("base", "b").alias("base_score"), plus("lattice", "x").alias("score"), plus("blend", "s").alias("blend_score"),
    )


def _fit(words: DataFrame, pieces: dict[str, float], by_byte: list[float], stop: float) -> tuple[dict[str, float], list[float], float]:
    """One round of expectation maximisation over words(word, n_train): new piece weights and stop probability."""
    ship = words.sparkSession.sparkContext.broadcast(pickle.dumps((pieces, by_byte, stop)))

    def run(batches):
        import pyarrow as pa

        lattice = Lattice(*pickle.loads(ship.value))
        total, spelt, drawn, seen = np.zeros(len(lattice.names)), np.zeros(256), 0.0, 0.0
        for batch in _together(batches):
            counts = batch.column(1).to_numpy().astype(float)
            found = lattice.expected([w.decode(errors="replace") for w in batch.column(0).to_pylist()], counts)
            total, spelt, drawn, seen = total + found[0], spelt + found[1], drawn + found[2], seen + counts.sum()
        some = np.flatnonzero(total)
        names = [lattice.names[i] for i in some] + [f" {i}" for i in range(256)] + ["", " "]  # words, so pieces in them, have no spaces
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([*total[some], *spelt, drawn, seen], pa.float64())], names=["piece", "n"])

    got = {r.piece: r.n for r in words.select("word", "n_train").mapInArrow(run, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()}  # at most the vocabulary and 256 bytes
    drawn, seen = got.pop("", 0.0), got.pop(" ", 0.0)
    if not drawn:
        return pieces, by_byte, stop
    spread = 0.01 * drawn  # the old weights keep a hundredth
    new = {p: math.log(got.get(p, 0.0) + spread * math.exp(w)) for p, w in pieces.items()}
    new_bytes = [math.log(got.get(f" {i}", 0.0) + spread * math.exp(w)) for i, w in enumerate(by_byte)]
    return *normalised(new, new_bytes), min(0.9, max(0.05, seen / drawn))
