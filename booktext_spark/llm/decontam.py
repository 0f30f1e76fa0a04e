"""Benchmark decontamination with a generalised suffix automaton over the words of the test items."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from booktext_spark.llm.common import alnum_words, stored, utf8

#: UTF-8 bytes of test items in one automaton (about 100 bytes of memory for each).
SHARD_BYTES = 2 << 20


class Automaton:
    """Suffix automaton of word sequences: transitions, suffix links, longest lengths."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        self.words: dict[bytes, int] = {}
        self.names: list[str] = []
        paths = []
        for name, words in items:
            if not words:
                continue
            ids = [self.words.setdefault(w, len(self.words)) for w in words]
            state = 0
            for c in ids:
                state = self._extend(state, c)
            paths.append((len(self.names), ids))
            self.names.append(name)
        seen: list[set[int]] = [set() for _ in self.next]  # items of each state
        short: dict[int, dict[int, list[int]]] = {}  # by state, the shorter items that it holds whole, by length
        for number, ids in paths:
            state = 0
            for c in ids:
                state = self.next[state][c]
                up = state
                while up > 0 and number not in seen[up]:
                    seen[up].add(number)
                    up = self.link[up]
            if len(ids) < window:
                short.setdefault(state, {}).setdefault(len(ids), []).append(number)  # an item's last state holds it whole
        #: For each state: the lengths of the windows that end there once as many words match, longest first, with items.
        #: A state has its own and those of its link, which are shorter, so states go by their longest strings.
        self.ends: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in self.next]
        for state in sorted(range(1, len(self.next)), key=self.longest.__getitem__):
            own = [(length, tuple(numbers)) for length, numbers in short.get(state, {}).items()]
            if self.longest[self.link[state]] < window <= self.longest[state]:
                own.append((window, tuple(sorted(n for n in seen[state] if len(paths[n][1]) >= window))))
            above = self.ends[self.link[state]]
            self.ends[state] = sorted(own, reverse=True) + above if own else above
        self.shortest = min([window, *(len(ids) for _, ids in paths)])

    def _extend(self, last: int, c: int) -> int:
        nxt, link, longest = self.next, self.link, self.longest
        if c in nxt[last]:
            q = nxt[last][c]
            if longest[q] == longest[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if longest[q] == longest[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, longest = self.next, self.link, self.longest
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        longest.append(longest[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """(hit spans of words, merged and in order; numbers of the items with occurring windows)."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        ids = list(map(self.words.get, words))
        nxt, link, longest, ends, shortest = self.next, self.link, self.longest, self.ends, self.shortest
        state = matched = 0
        for i, c in enumerate(ids):
            if c is None:
                state = matched = 0
                continue
            to = nxt[state].get(c)
            if to is None:
                while state > 0 and to is None:
                    state = link[state]
                    matched = longest[state]
                    to = nxt[state].get(c)
                if to is None:
                    continue
            state = to
            matched += 1
            if matched < shortest:
                continue
            span = 0
            for length, numbers in ends[state]:
                if length <= matched and numbers:
                    span = max(span, length)
                    items.update(numbers)
            if span:
                start = i + 1 - span
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, items


def shards(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> Iterator[Automaton]:
    """Automata of at most SHARD_BYTES of test items each, read one after another."""
    waiting: list[tuple[str, list[bytes]]] = []
    size = 0
    for name, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        if text is None or name is None:
            continue
        data = text.encode()
        waiting.append((name, alnum_words(data)))
        size += len(data)
        if size >= SHARD_BYTES:
            yield Automaton(waiting, window)
            waiting, size = [], 0
    if waiting:
        yield Automaton(waiting, window)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """docs with n_words, spans (hit words as array of start, stop) and items (sorted ids as strings).

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. Every
    `window` consecutive words of an item are a window, as is the whole of a shorter item that has words.
    The items go through in automata of bounded size, each broadcast in turn: one pass over the texts
    for each, one automaton at a time in a worker. Null and empty texts have no words; items of null id or text are skipped; of equal
    items each is named; repeated rows are judged each; an empty benchmark hits nothing. Columns of docs
    that have the names of new ones are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    return _hits(docs, benchmark, window, text_col, item_col).select(*kept, f"{HITS}.n_words", f"{HITS}.spans", f"{HITS}.items")


HITS = "__hits"
HITS_TYPE = "struct<n_words:bigint,spans:array<struct<start:bigint,stop:bigint>>,items:array<string>>"


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, item_col: str, share: float | None = None) -> DataFrame:
    """docs with n_words, spans and items in one struct; with a share, wrong spans are taken out of the texts.

    One automaton is matched in the pass that makes the result. Of several, each is matched in a pass of its own, whose hits
    are stored by the text's hashes before the next is made; the last pass joins them.
    """
    spark = docs.sparkSession
    ship = lambda automaton: spark.sparkContext.broadcast(pickle.dumps(automaton))
    nothing = F.lit(None).cast(HITS_TYPE)
    found, last = None, None
    for automaton in shards(benchmark, window, item_col, text_col):
        if last is not None:
            part = _hit_texts(docs, ship(last), text_col)
            found = part if found is None else found.unionByName(part)
        last = automaton
    if found is None:
        return _with_shard(docs.withColumn(HITS, nothing), ship(last or Automaton([], window)), text_col, share)
    found = found.unionByName(_hit_texts(docs, ship(last), text_col))
    # a text has a row for each automaton that hits it
    lists = found.groupBy("__a", "__b").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    hits = F.struct(F.lit(0).cast("bigint").alias("n_words"), "spans", "items")
    lists = lists.select("__a", "__b", hits.alias(HITS))
    a, b = _text_hashes(text_col)
    joined = docs.withColumns({"__a": a, "__b": b}).join(lists, ["__a", "__b"], "left").select(*docs.columns, HITS)
    return _with_shard(joined, ship(Automaton([], window)), text_col, share)


def _text_hashes(text_col: str) -> tuple[Column, Column]:
    text = F.col(text_col).cast("string")
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _hit_texts(docs: DataFrame, shipped, text_col: str) -> DataFrame:
    """Hashes, spans and items of the texts that an automaton hits, stored."""
    a, b = _text_hashes(text_col)
    texts = docs.select(a.alias("__a"), b.alias("__b"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast(HITS_TYPE).alias(HITS))
    hit = _with_shard(texts, shipped, "text").where(F.size(f"{HITS}.items") > 0)
    return stored(hit.select("__a", "__b", f"{HITS}.spans", f"{HITS}.items").dropDuplicates(["__a", "__b"]), "decontamination-hits")


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without what lies from the first to the last word of each span; a space is in its place."""
    data = text.encode()
    places = [m.span() for m in WORD.finditer(data.lower())]
    parts, done = [], 0
    for start, stop in spans:
        parts.append(data[done : places[start][0]])
        done = places[stop - 1][1]
    return b" ".join([*parts, data[done:]]).decode()


def _with_shard(docs: DataFrame, shipped, text_col: str, share: float | None = None) -> DataFrame:
    at = docs.columns.index(text_col)

    def merged(a, b):
        out: list[list[int]] = []
        for start, stop in sorted([*a, *b]):
            if out and start <= out[-1][1]:
                out[-1][1] = max(out[-1][1], stop)
            else:
                out.append([start, stop])
        return out

    def run(batches):
        import pyarrow as pa

        automaton = pickle.loads(shipped.value)
        for batch in batches:
            before = batch.column(batch.num_columns - 1)
            kind = before.type
            rows, changed = [], {}
            for k, (data, old) in enumerate(zip(utf8(batch.column(at)), before.to_pylist(), strict=True)):
                words = alnum_words(data)
                spans, items = automaton.scan(words)
                names = {automaton.names[n] for n in items}
                if old:
                    spans = merged(spans, [(s["start"], s["stop"]) for s in old["spans"]])
                    names |= set(old["items"])
                if share is not None and spans and sum(b - a for a, b in spans) >= share * len(words):
                    changed[k] = without_words(data.decode(), spans)
                rows.append({"n_words": len(words), "spans": [{"start": a, "stop": b} for a, b in spans], "items": sorted(names)})
            arrays = list(batch.columns)
            if changed:
                arrays[at] = pa.array([changed.get(k, t) for k, t in enumerate(arrays[at].to_pylist())], arrays[at].type)
            arrays[-1] = pa.array(rows, kind)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def hit_words(spans: str = "spans") -> Column:
    """The number of words in merged spans; 0 for none, null for null."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.05, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """docs without the hit spans of contaminated documents; other rows are as they were.

    A document is contaminated if hit words are at least `share` of its words. The text between a hit
    span's first and last word goes, with one space in its place.
    """
    return _hits(docs, benchmark, window, text_col, item_col, share).select(*docs.columns)
