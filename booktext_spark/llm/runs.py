"""Periodic runs of words: suffix automaton whose link tree is accessed as a link-cut forest."""

from __future__ import annotations

from array import array

import numpy as np
from pyspark.sql import DataFrame

from booktext_spark.llm.common import slices

FAR = np.iinfo(np.int64).max
RUN = "struct<start:bigint,length:bigint,period:bigint>"


class Squares:
    """Suffix automaton over a growing sequence; its link tree is a forest of splayed paths, each of one last occurrence.

    The states on the way from the newest state to the root are the suffixes of what was read. Those with the same last
    occurrence before it lie next to each other, and their longest has length L: it ends now and ended d earlier, so
    the last L + d symbols have period d. That is a square, and d the least period of it, if L >= d. Reading a symbol walks these
    segments, of which there are O(log n) amortised, and gives the whole way the newest end as its colour.
    """

    def __init__(self):
        self.end = 0
        self.longest, self.link = array("q", [0]), array("q", [-1])
        # most states have one way on; the others have a dict
        self.symbol, self.to = array("q", [-1]), array("q", [-1])
        self.ways: dict[int, dict[int, int]] = {}
        # splay trees of paths, by depth: node 0 of these is none, so that state s is node s + 1
        self.left, self.right, self.parent, self.colour = array("q", [0, 0]), array("q", [0, 0]), array("q", [0, 0]), array("q", [-1, -1])
        self.last = 0

    def _way(self, state: int, symbol: int) -> int:
        if self.symbol[state] == symbol:
            return self.to[state]
        more = self.ways.get(state)
        return -1 if more is None else more.get(symbol, -1)

    def _set(self, state: int, symbol: int, to: int) -> None:
        if self.symbol[state] in (-1, symbol):
            self.symbol[state], self.to[state] = symbol, to
        else:
            self.ways.setdefault(state, {})[symbol] = to

    def _state(self, longest: int, link: int) -> int:
        for column, value in ((self.longest, longest), (self.link, link), (self.symbol, -1), (self.to, -1), (self.left, 0), (self.right, 0), (self.parent, 0), (self.colour, -1)):
            column.append(value)
        return len(self.longest) - 1

    def _splay(self, x: int) -> None:
        """x becomes the root of its path's tree, which takes the path's colour and its way to the path above along."""
        left, right, parent = self.left, self.right, self.parent
        p = parent[x]
        if not p or left[p] != x and right[p] != x:
            return
        root = p
        while True:
            p = parent[x]
            if not p or left[p] != x and right[p] != x:
                break
            g = parent[p]
            root = p
            inner = g and (left[g] == p or right[g] == p)
            if inner:
                top = parent[g]
                root = g
                over = top and (left[top] == g, right[top] == g)
                if left[g] == p:
                    if left[p] == x:  # zig-zig
                        a, b = right[p], right[x]
                        left[g], right[p], left[p], right[x] = a, g, b, p
                        if a:
                            parent[a] = g
                        if b:
                            parent[b] = p
                        parent[g], parent[p] = p, x
                    else:  # zig-zag
                        a, b = left[x], right[x]
                        right[p], left[g], left[x], right[x] = a, b, p, g
                        if a:
                            parent[a] = p
                        if b:
                            parent[b] = g
                        parent[p] = parent[g] = x
                elif right[p] == x:
                    a, b = left[p], left[x]
                    right[g], left[p], right[p], left[x] = a, g, b, p
                    if a:
                        parent[a] = g
                    if b:
                        parent[b] = p
                    parent[g], parent[p] = p, x
                else:
                    a, b = left[x], right[x]
                    right[g], left[p], left[x], right[x] = a, b, g, p
                    if a:
                        parent[a] = g
                    if b:
                        parent[b] = p
                    parent[p] = parent[g] = x
                parent[x] = top
                if over:
                    if over[0]:
                        left[top] = x
                    elif over[1]:
                        right[top] = x
            else:
                if left[p] == x:
                    a = right[x]
                    left[p], right[x] = a, p
                else:
                    a = left[x]
                    right[p], left[x] = a, p
                if a:
                    parent[a] = p
                parent[p], parent[x] = x, g
        self.colour[x] = self.colour[root]

    def read(self, symbol: int, exponent: int = 2) -> list[tuple[int, int]]:
        """(period, length) of the longest suffixes of each least period that are `exponent` periods long or more."""
        longest, link = self.longest, self.link
        p = self.last
        self.last = new = self._state(longest[p] + 1, 0)
        while p >= 0 and self._way(p, symbol) < 0:
            self._set(p, symbol, new)
            p = link[p]
        if p >= 0:
            q = self._way(p, symbol)
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                between = self._state(longest[p] + 1, link[q])
                self.symbol[between], self.to[between] = self.symbol[q], self.to[q]
                if q in self.ways:
                    self.ways[between] = dict(self.ways[q])
                while p >= 0 and self._way(p, symbol) == q:
                    self._set(p, symbol, between)
                    p = link[p]
                link[q] = link[new] = between
                self._between(q + 1, between + 1)
        self.parent[new + 1] = link[new] + 1
        return self._access(new + 1, exponent)

    def _between(self, below: int, node: int) -> None:
        """Puts a node into the path right above another one."""
        self._splay(below)
        above = self.left[below]
        self.left[node], self.parent[node], self.left[below] = above, below, node
        if above:
            self.parent[above] = node

    def _access(self, node: int, exponent: int) -> list[tuple[int, int]]:
        right, parent, colour, longest, end = self.right, self.parent, self.colour, self.longest, self.end
        found, below, x = [], 0, node
        while x:
            self._splay(x)
            c = colour[x]
            if x != node:
                size, period = longest[x - 1], end - c
                if c >= 0 and size >= (exponent - 1) * period:
                    found.append((period, size + period))
            if right[x]:
                colour[right[x]] = c
            right[x] = below
            below, x = x, parent[x]
        colour[below] = end
        self.end += 1
        return found


def periodic_runs(symbols, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, by start, then period.

    A run is a stretch with least period `period`, at least `least` and `exponent` periods long, that no neighbour extends. Each square
    of `exponent` periods that the automaton reports names the start of its run, and later ends move the run's end on.
    """
    automaton, ends = Squares(), {}
    for i, symbol in enumerate(symbols):
        for period, length in automaton.read(symbol, exponent):
            ends[i - length + 1, period] = i
    return sorted((start, end - start + 1, period) for (start, period), end in ends.items() if end - start + 1 >= max(least, exponent * period))


def _near_equal(codes: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` symbols, the distance to the nearest other place that has it or a run of equal hash; a very large number if none has."""
    n = len(codes) - width + 1
    names, codes = np.zeros(n, np.uint64), codes.astype(np.uint64)
    for k in range(width):
        names = (names ^ names >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    order = np.argsort(names, kind="stable")
    gap = np.where(np.diff(names[order]) == 0, np.diff(order), FAR)
    near = np.full(n, FAR)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    return near


def stretches(codes: np.ndarray, least: int = 6, exponent: int = 4) -> list[tuple[int, int]]:
    """(first, last excluded) of stretches outside which no run can be, in order.

    In a run of period q with least >= 6 and exponent >= 4, every five neighbours come again q places before or behind, inside the run, and q
    is at most a fourth of it. So places whose five have no equal at so small a distance go, until nothing changes. Shorter runs, if asked for, are
    looked for everywhere.
    """
    if least < 6 or exponent < 4:
        return [(0, len(codes))] if len(codes) >= least else []
    if len(codes) < least:
        return []
    near, out, todo = _near_equal(codes, 5), [], [(0, len(codes) - 4)]
    while todo:
        first, last = todo.pop()
        size = last - first + 4
        if size < least:
            continue
        alive = near[first:last] <= size // exponent
        edges = np.flatnonzero(np.diff(np.concatenate([[False], alive, [False]]).astype(np.int8)))
        if len(edges) == 2 and edges[1] - edges[0] == last - first:
            out.append((first, last + 4))
        else:
            todo += [(first + a, first + b) for a, b in edges.reshape(-1, 2).tolist()]
    return sorted(out)


def word_runs(words: list, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """periodic_runs of words, looked for where stretches has found, by hashes of words, that there can be some."""
    if len(words) < least:
        return []
    found = []
    for first, last in stretches(np.fromiter(map(hash, words), np.int64, len(words)), least, exponent):
        seen: dict = {}
        codes = [seen.setdefault(w, len(seen)) for w in words[first:last]]
        found += [(first + start, length, period) for start, length, period in periodic_runs(codes, least, exponent)]
    return sorted(found)


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """words without those that a run holds behind its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, inside in zip(words, np.cumsum(change[:-1]).tolist(), strict=True) if not inside]


def find_runs(docs: DataFrame, least: int = 6, exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start, then period) and collapsed of every row of docs.

    Words are what ASCII white space leaves between; a null text has none. collapsed is the text of the words that stay when each run keeps its
    first period, joined by one space. Texts without runs, and empty ones, have an empty list. Rows are handled one by one: repeated
    ids and rows give a row each, an empty table none, other columns are not looked at. A text of any length takes memory in
    proportion to its longest stretch that may hold a run (see stretches), about 150 bytes a word.
    """
    import pyarrow as pa

    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for part in slices(batches):
            n, runs, texts = [], [], []
            for text in part.column(1).cast(pa.binary()).to_pylist():
                words = text.split() if text else []
                found = word_runs(words, least, exponent)
                n.append(len(words))
                runs.append([{"start": s, "length": size, "period": q} for s, size, q in found])
                texts.append(b" ".join(kept_words(words, found)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")
    return rows.mapInArrow(run, f"doc_id bigint, n_words bigint, runs array<{RUN}>, collapsed string")
