"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text."""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from booktext_spark.llm.common import stored

#: Letters of other scripts that look like Latin ones: Cyrillic, Greek, Armenian, Cherokee and others, in lower case.
HOMOGLYPHS = {
    look.casefold(): letter
    for looks, letters in (
        ("аеорсухіјѕһԁԛԝвкмнтгпѵүӏґєз", "aeopcyxijshdqwbkmhtrnvyirez"),
        ("αενορτυχικβγδηλμπωϲϳθ", "aevoptuxikbydnlmnwcjq"),
        ("ոսցզհաօքեյտղռկ", "nugqhaopejunnl"),
        ("ꭰꭱꭺꭼꮃꮇꮋꮍꮐꮒꮓꮖꮟꮢꮤꮩꮪꮮꮯꮲꮳꮴꮶ", "dragwmhyghzibrsvslcpvzk"),
        ("ⲁⲃⲉⲓⲕⲙⲛⲟⲣⲥⲧⲩⲭⲏ", "abeikmnopctyxh"),
        ("ıȷꞁʟᴏ", "ijllo"),
    )
    for look, letter in zip(looks, letters, strict=True)
}
#: A letter of Latin kind by its Unicode name: what stands behind LETTER, styles left out, and before WITH. The rule takes small capitals, strokes and hooks, turned and
#: open letters, letters in circles, squares and brackets, and regional signs, several hundred in all.
LATIN_NAME = re.compile(r"(?:LATIN|REGIONAL INDICATOR SYMBOL|NEGATIVE|SQUARED|CIRCLED|PARENTHESIZED|MODIFIER|TAG).*? (?:LETTER|CAPITAL|SMALL)(?: (?:SMALL|CAPITAL|DOTLESS|TURNED|REVERSED|INVERTED|OPEN|LONG|BARRED|SCRIPT|INSULAR|SIDEWAYS|BOTTOM|TOP|HALF))* ([A-Z])(?: WITH .+)?")


def looks_like(c: str) -> str:
    """The Latin letter that a sign looks like, by the list or by its name, else the sign."""
    if c in HOMOGLYPHS or c.isascii():
        return HOMOGLYPHS.get(c, c)
    found = LATIN_NAME.fullmatch(unicodedata.name(c, ""))
    return found[1].lower() if found else c


#: Digits that stand for letters, and signs that do where a letter follows.
SUBSTITUTES = dict(zip("013457", "oieast", strict=True))
SIGNS = dict(zip("@$!|", "asii", strict=True))
SIGN = re.compile(r"[@$!|](?=[^\W\d_])")
#: Letters that one sign stands for are one letter, in texts and in the lexicon alike.
MERGED = {"l": "i"}


#: Letters by which prefixes grow in one pass.
BAND = 24

#: Signs that are not seen, in code points.
UNSEEN = {0xAD, 0x200B, 0x200C, 0x200D, 0xFEFF}


class _Fold(dict):
    """Maps a code point to its folded letters, or to a space; fills itself in."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(code)).casefold():
            if not unicodedata.combining(c) and ord(c) not in UNSEEN:
                c = SUBSTITUTES.get(c) or looks_like(c)
                out += MERGED.get(c, c) if c.isalpha() else " "
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """Letters without accents, in one case, with look-alikes and digit substitutions undone; other signs are spaces.

    The result begins and ends with a space and has no two in a row.
    """
    if SIGN.search(text):
        text = SIGN.sub(lambda m: SIGNS[m[0]], text)
    return f" {' '.join(text.translate(_FOLD).split())} "


@dataclass
class Lexicon:
    """terms: folded stems (matched from a word's start) with weights. exceptions: folded phrases inside which no term counts.

    The score is sigmoid(bias + on_sum * log1p(weights) + on_rate * log1p(weights per 100 words)).
    """

    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    bias: float = -4.0
    on_sum: float = 1.0
    on_rate: float = 1.0

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for t, w in self.terms.items():
            found.add_word(f" {t}", (len(t) + 1, w))
        for e in self.exceptions:
            if folded := fold(e).strip():
                found.add_word(f" {folded} ", (len(folded) + 2, None))
        if len(found):
            found.make_automaton()
        return found

    def features(self, folded: str, automaton) -> tuple[float, float, int]:
        """(log1p of summed weights, log1p of weights per 100 words, matches); the longest term of each word counts."""
        if not len(automaton):
            return 0.0, 0.0, 0
        best: dict[int, tuple[int, float]] = {}
        shields = []
        for end, (length, weight) in automaton.iter(folded):
            start = end - length + 1
            if weight is None:
                shields.append((start, end))
            elif start not in best or best[start][0] < length:
                best[start] = (length, weight)
        starts, stops = [], []  # of merged shields
        for a, b in sorted(shields):
            if stops and a < stops[-1]:
                stops[-1] = max(stops[-1], b)
            else:
                starts.append(a)
                stops.append(b)
        hits = [w for at, (_, w) in best.items() if not starts or at < starts[0] or at >= stops[bisect_right(starts, at) - 1]]
        total = math.fsum(hits)
        words = max(1, folded.count(" ") - 1)
        return math.log1p(total), math.log1p(100 * total / words), len(hits)

    def score(self, folded: str, automaton) -> float:
        a, b, n = self.features(folded, automaton)
        return 1 / (1 + math.exp(-(self.bias + self.on_sum * a + self.on_rate * b))) if n else 1 / (1 + math.exp(-self.bias))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a ridge-penalised logistic fit by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn_lexicon(docs: DataFrame, labels: DataFrame, sample: int = 60_000, stem: int = 4, longest: int | None = None, share: float = 0.01, weight: float = 3.0, terms: int | None = None, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learns terms, weights, exception phrases and the score's scale from labelled rows.

    At most about `sample` labelled rows are used, chosen by hash, equal texts once; an id or text with several labels is
    toxic if one is. Candidates are the prefixes of folded
    words, from `stem` letters on, that occur in `share` of the toxic rows or more. A term's weight is its
    log odds; terms below `weight` go, as do stems that a longer one replaces at the same frequency and
    extensions that add no weight to their stem. Bigrams of words that hold a term but were seen in
    several clean rows and no toxic one become exceptions. Prefixes of any length are candidates: they are counted BAND letters at a time, longer ones of the words
    whose shorter one was frequent only. longest and terms, if given, end prefixes at so many letters and keep the terms of largest weight times frequency. Null labels and texts
    teach nothing; without labels the lexicon has no term.
    """
    spark = docs.sparkSession
    toxic = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = toxic.count()
    if not total:
        return Lexicon({}, list(exceptions))
    if total > sample:
        toxic = toxic.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(sample / total * (1 << 30)))
    # about `sample` labels at most: a broadcast of known size
    known = stored(docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(toxic), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")), "toxicity-sample")

    positive = known.where("toxic = 1").select("text")
    n_pos = known.where("toxic = 1").count()
    n_neg = known.where("toxic = 0").count()
    least = max(5, math.ceil(share * n_pos))
    candidates: dict[str, int] = {}
    low, grown = stem, None
    while grown is None or grown:
        high = low + BAND - 1 if longest is None else min(low + BAND - 1, longest)
        found = _counted_prefixes(positive, stem, low, high, grown, least)  # at most BAND / share for each toxic row's mean number of words
        candidates |= found
        grown = {t for t in found if len(t) == high and t[-1] != " "} if longest is None or high < longest else set()
        low = high + 1

    ship = spark.sparkContext.broadcast(pickle.dumps(set(candidates)))

    def seen(batches):
        import pyarrow as pa

        wanted = pickle.loads(ship.value)
        deepest = max(map(len, wanted), default=0)
        for batch in batches:
            counts: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                here = set()
                for w in set(fold(text).split()):
                    here.update(p for n in range(stem, min(len(w), deepest) + 1) if (p := w[:n]) in wanted)
                    if len(w) < stem and f"{w} " in wanted:
                        here.add(f"{w} ")
                counts.update(here)
            yield pa.RecordBatch.from_pydict({"term": list(counts), "n": pa.array(counts.values(), pa.int64())})

    clean = {r.term: r.n for r in known.where("toxic = 0").select("text").mapInArrow(seen, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    odds = lambda t: math.log((candidates[t] + 0.5) / (n_pos - candidates[t] + 0.5)) - math.log((clean.get(t, 0) + 0.5) / (n_neg - clean.get(t, 0) + 0.5))
    weights = {t: w for t in candidates if (w := odds(t)) >= weight}
    longer: dict[str, int] = {}
    for t, n in candidates.items():
        if t in weights:
            longer[t[:-1]] = max(longer.get(t[:-1], 0), n)
    kept: dict[str, float] = {}
    for t in sorted(weights, key=len):
        stems = [kept[t[:k]] for k in range(stem, len(t)) if t[:k] in kept]
        if longer.get(t, 0) >= 0.95 * candidates[t] or stems and max(stems) >= weights[t] - 1:
            continue
        kept[t] = weights[t]
    kept = dict(sorted(kept.items(), key=lambda x: (-x[1] * candidates[x[0]], x[0]))[:terms])
    lexicon = Lexicon(kept, list(exceptions))
    lexicon.exceptions += _exceptions(known, lexicon)
    rows = _features(known, lexicon).select("a", "b", "n", "toxic").toPandas()  # three numbers for each sampled row
    hit = rows[rows.n > 0]
    if len(hit) and rows.toxic.nunique() > 1:
        x = np.column_stack([np.ones(len(rows)), rows.a, rows.b])
        w = _logistic(x, rows.toxic.to_numpy(float))
        lexicon.bias, lexicon.on_sum, lexicon.on_rate = map(float, w)
    return lexicon


def _counted_prefixes(rows: DataFrame, stem: int, low: int, high: int, grown: set[str] | None, least: int) -> dict[str, int]:
    """Rows of text for each prefix of `low` to `high` letters of their words, from `least` rows on; of words with a prefix in `grown` where that is given.

    Words of fewer letters than a stem, but more than two, count whole, with a space behind.
    """
    ship = rows.sparkSession.sparkContext.broadcast(grown)

    def prefixes(batches):
        import pyarrow as pa

        start = ship.value
        for batch in batches:
            counts: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                here = set()
                for w in set(fold(text).split()):
                    if start is None or w[: low - 1] in start:
                        here.update(w[:n] for n in range(low, min(len(w), high) + 1))
                    if start is None and 2 < len(w) < stem:
                        here.add(f"{w} ")
                counts.update(here)
            yield pa.RecordBatch.from_pydict({"term": list(counts), "n": pa.array(counts.values(), pa.int64())})

    counted = rows.mapInArrow(prefixes, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return {r.term: r.n for r in counted.collect()}


def _exceptions(known: DataFrame, lexicon: Lexicon, least: int = 5) -> list[str]:
    """Pairs of words around a term that only clean rows have."""
    ship = known.sparkSession.sparkContext.broadcast(pickle.dumps(lexicon))

    def run(batches):
        import pyarrow as pa

        found = pickle.loads(ship.value).automaton()
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded, pairs = fold(text), set()
                for end, (length, w) in found.iter(folded) if len(found) else ():
                    start = end - length + 1
                    if w is not None:
                        stop = folded.index(" ", end) if folded[end] != " " else end
                        before = folded.rfind(" ", 0, start) if start else -1
                        after = folded.find(" ", stop + 1)
                        if before >= 0:
                            pairs.add(folded[before + 1 : stop])
                        if after > 0:
                            pairs.add(folded[start + 1 : after])
                rows += [(p, 1 - toxic, toxic) for p in pairs]
            yield pa.RecordBatch.from_pydict({"phrase": pa.array([r[0] for r in rows], pa.string()), "clean": pa.array([r[1] for r in rows], pa.int64()), "bad": pa.array([r[2] for r in rows], pa.int64())})

    pairs = known.select("text", "toxic").mapInArrow(run, "phrase string, clean bigint, bad bigint")
    counted = pairs.groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad")).where((F.col("bad") == 0) & (F.col("clean") >= least))
    return sorted(r.phrase for r in counted.collect())


def _features(known: DataFrame, lexicon: Lexicon) -> DataFrame:
    ship = known.sparkSession.sparkContext.broadcast(pickle.dumps(lexicon))

    def run(batches):
        import pyarrow as pa

        lex = pickle.loads(ship.value)
        found = lex.automaton()
        for batch in batches:
            rows = [lex.features(fold(t), found) for t in batch.column(0).to_pylist()]
            a, b, n = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.float64()), "b": pa.array(b, pa.float64()), "n": pa.array(n, pa.int64()), "toxic": batch.column(1)})

    return known.select("text", "toxic").mapInArrow(run, "a double, b double, n bigint, toxic int")


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """docs with a toxicity score from 0 to 1; a null or empty text gets the score of a text without terms.

    A column named as the score is replaced; no other column is looked at.
    """
    docs = docs.drop(score_col).withColumn(score_col, F.lit(0.0))
    at = docs.columns.index(text_col)
    ship = docs.sparkSession.sparkContext.broadcast(pickle.dumps(lexicon))

    def run(batches):
        import pyarrow as pa

        lex = pickle.loads(ship.value)
        found = lex.automaton()
        for batch in batches:
            scores = [lex.score(fold(t or ""), found) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels of the rows that may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
