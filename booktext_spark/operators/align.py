"""Paragraph alignment of two texts by a monotone path of least cost."""

from __future__ import annotations

import copy
import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from booktext_spark.functions.text import DIALOGUE_CLOSE, DIALOGUE_COST, DIALOGUE_OPEN, END_COST, LENGTH_CAP, SENTENCE_END, TARGET_SHARE, needs_review

#: Fixed values: (source, target) paragraphs of a move and its penalty, in the order in which ties are settled for a cell.
MOVES = ((2, 1, 0.22), (1, 2, 0.22), (1, 1, 0.0), (1, 0, 1.35), (0, 1, 1.35))

_SPACE = re.compile(r"\s+")


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Visible length and a code of dialogue signs and sentence end of each text."""
    size, sign = np.zeros(len(texts)), np.zeros(len(texts), np.int8)
    for i, t in enumerate(texts):
        bare = t.strip()
        size[i] = max(len(_SPACE.sub("", t)), 1)
        sign[i] = 4 * bare.startswith(tuple(DIALOGUE_OPEN)) + 2 * bare.endswith(tuple(DIALOGUE_CLOSE)) + bare.endswith(tuple(SENTENCE_END))
    return size, sign


def _costs(source: tuple, target: tuple) -> np.ndarray:
    """Costs of all pairs of one source text (rows) with the target texts."""
    (size, sign), (sizes, signs) = source, target
    length = np.minimum(np.abs(np.log(sizes / max(size * TARGET_SHARE, 1.0))), LENGTH_CAP)
    return length + np.where(sign >> 1 == signs >> 1, 0.0, DIALOGUE_COST) + np.where((sign & 1) == (signs & 1), 0.0, END_COST)


def _with_skips(best: np.ndarray, how: np.ndarray, skip: float) -> None:
    """Lets each cell of a row take the one before it for `skip` where that is less, as a walk from left to right would, to the last bit."""
    pre, at = best.copy(), np.arange(len(best))
    level = pre - skip * at
    later = np.concatenate([[False], level[1:] > np.minimum.accumulate(level)[:-1]])
    edges = np.flatnonzero(np.diff(np.concatenate([later, [False]]).astype(np.int8)))
    for first, last in edges.reshape(-1, 2).tolist():  # runs of skips behind `first`
        if last - first > 8:
            best[first : last + 1] = np.add.accumulate(np.concatenate([best[first : first + 1], np.full(last - first, skip)]))
    for _ in range(12):
        step = best[:-1] + skip
        less = step < pre[1:]
        new = np.where(less, step, pre[1:])
        if np.array_equal(new, best[1:]):
            how[1:][less] = 4
            return
        best[1:] = new
    best[:] = pre
    for j in range(1, len(best)):
        if best[j - 1] + skip < best[j]:
            best[j], how[j] = best[j - 1] + skip, 4


#: Cells of a table that is kept whole, eight bytes each; larger ones are cut into so many parts.
WHOLE_CELLS, PARTS = 1 << 22, 32


def _largest(low: float, total: float, cost: float, penalty: float) -> float:
    """The largest number that, with a move's cost and penalty, is at most `total`, as `low` is."""
    high = total + 1.0
    while low < (middle := (low + high) / 2) < high:
        low, high = (middle, high) if middle + cost + penalty <= total else (low, middle)
    return low


class _Table:
    """Least costs of monotone paths between cells of two texts' paragraphs."""

    def __init__(self, source: list[str], target: list[str]):
        pair = lambda xs: [f"{a}\n{b}" for a, b in zip(xs, xs[1:], strict=False)]
        self.size, self.base = (len(source), len(target)), 0.0
        self.one, self.two = _features(source), _features(pair(source))
        self.ones, self.twos = _features(target), _features(pair(target))

    def rows(self, first: int, last: int, width: int, above: list[np.ndarray]):
        """Costs of the rows from first to last, of so many columns; above: the two rows before, of infinite costs where there is none."""
        part = lambda x, high: (x[0][:high], x[1][:high])
        ones, twos = part(self.ones, width - 1), part(self.twos, max(width - 2, 0))
        for i in range(first, last + 1):
            best = np.full(width, np.inf)
            if i == 0:
                best[0] = self.base
            else:
                mine = (self.one[0][i - 1], self.one[1][i - 1])
                if i > 1 and width > 1:
                    best[1:] = np.minimum(best[1:], above[0][:-1] + _costs((self.two[0][i - 2], self.two[1][i - 2]), ones) + MOVES[0][2])
                if width > 2:
                    best[2:] = np.minimum(best[2:], above[1][:-2] + _costs(mine, twos) + MOVES[1][2])
                if width > 1:
                    best[1:] = np.minimum(best[1:], above[1][:-1] + _costs(mine, ones))
                best = np.minimum(best, above[1] + MOVES[3][2])
            _with_skips(best, np.zeros(width, np.int8), MOVES[4][2])
            above = [above[1], best]
            yield best

    def cost(self, i: int, j: int, a: int, b: int) -> float:
        """Cost of the move of a and b paragraphs that ends in (i, j), without its penalty."""
        if not a or not b:
            return 0.0
        (size, sign), (sizes, signs) = (self.one, self.two)[a - 1], (self.ones, self.twos)[b - 1]
        return float(_costs((size[i - a], sign[i - a]), (sizes[j - b : j - b + 1], signs[j - b : j - b + 1]))[0])

    def path(self, i0: int, j0: int, i1: int, j1: int, base: float) -> list[int]:
        """Moves of the path of least cost from (i0, j0), which has the cost `base`, to (i1, j1), of those whose sums are equal to the last bit the first by the order of MOVES from the end.

        Sums that differ in a cell may be equal further on, where their last bits are rounded off; so the walk back knows up to which sum a cell's
        paths end in the least one, and takes the first move from a cell that has a path within it. Of a table of over WHOLE_CELLS two rows before each of PARTS parts are kept, and
        each part is walked as a table of its own, up to the column that the path has come to.
        """
        moves: list[int] = []
        if (i0, j0, i1, j1, base) != (0, 0, *self.size, self.base):
            part, own = lambda x, low, high: (x[0][low:high], x[1][low:high]), copy.copy(self)
            own.one, own.two, own.ones, own.twos = part(self.one, i0, i1), part(self.two, i0, max(i1 - 1, i0)), part(self.ones, j0, j1), part(self.twos, j0, max(j1 - 1, j0))
            own.size, own.base = (i1 - i0, j1 - j0), base
            return own.path(0, 0, *own.size, base)
        self._back(0, [np.full(j1 + 1, np.inf)] * 2, (i1, j1, None), moves)
        return moves[::-1]

    def _back(self, first: int, above: list[np.ndarray], end: tuple, moves: list[int]) -> tuple:
        """Walks from `end` (row, column, largest sum or none for the least) to a row before `first`, or to the first cell."""
        i, j, most = end
        above = [row[: j + 1] for row in above]
        height = i - first + 1
        if height * (j + 1) > WHOLE_CELLS and height > 2:
            step = -(-height // PARTS)
            starts, last = [], above
            for k, best in enumerate(self.rows(first, i, j + 1, above), first):
                if (k - first) % step == 0:
                    starts.append((k, last))
                last = [last[1], best]
            for start, before in reversed(starts):
                if i >= start and (i or j):
                    i, j, most = self._back(start, before, (i, j, most), moves)
            return i, j, most
        table = [*above, *self.rows(first, i, j + 1, above)]  # the row i is at i - first + 2
        most = float(table[-1][j]) if most is None else most
        while i >= first and (i or j):
            for k, (a, b, penalty) in enumerate(MOVES):
                if a <= i and b <= j and (before := float(table[i - a - first + 2][j - b])) + (cost := self.cost(i, j, a, b)) + penalty <= most:
                    moves.append(k)
                    i, j, most = i - a, j - b, _largest(before, most, cost, penalty)
                    break
        return i, j, most


def align(source: list[str], target: list[str]) -> list[tuple[list[int], list[int], str, str, float, str]]:
    """(source indices, target indices, texts, confidence, hash) of the matched groups, in order."""
    out, i, j = [], 0, 0
    for k in _Table(source, target).path(0, 0, len(source), len(target), 0.0):
        a, b, penalty = MOVES[k]
        if a and b:
            x, y = "\n".join(source[i : i + a]), "\n".join(target[j : j + b])
            fx, fy = _features([x]), _features([y])
            cost = float(_costs((fx[0][0], fx[1][0]), fy)[0]) + penalty
            digest = hashlib.sha256(f"{x.strip()}\x1f{y.strip()}".encode()).hexdigest()
            out.append((list(range(i, i + a)), list(range(j, j + b)), x, y, max(0.0, min(1.0, math.exp(-cost))), digest))
        i, j = i + a, j + b
    return out


ALIGNED = "pairing_id {kind}, group_no int, source_indices array<int>, target_indices array<int>, source_text string, target_text string, confidence double, content_hash string"


def align_paragraphs(pairings: DataFrame) -> DataFrame:
    """Matched groups of pairings(pairing_id, source_paragraphs, target_paragraphs): moves 1:1, 1:2, 2:1; skips give no row.

    A pairing is one row and one task's work at a time, in memory that grows with its paragraphs, not with their product; rows are dealt out evenly, the largest first. Null arrays are empty, null paragraphs too.
    """
    kind = pairings.schema["pairing_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, source, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                groups = align([p or "" for p in source or []], [p or "" for p in target or []])
                if groups:
                    a, b, x, y, c, h = zip(*groups, strict=True)
                    ints = pa.list_(pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(groups), batch.column(0).type), pa.array(range(len(groups)), pa.int32()), pa.array(a, ints), pa.array(b, ints), pa.array(x), pa.array(y), pa.array(c), pa.array(h)], names=["pairing_id", "group_no", "source_indices", "target_indices", "source_text", "target_text", "confidence", "content_hash"])

    rows = pairings.select("pairing_id", "source_paragraphs", "target_paragraphs")
    return rows.repartition(F.xxhash64("pairing_id")).mapInArrow(run, ALIGNED.format(kind=kind))


def align_libraries(libraries: DataFrame, specs: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, review): aligned groups of all pairings of building libraries.

    specs: library_id, position, source_book_id, target_book_id; blocks: book_id, section_ordinal, ordinal, source_text. Specs with a missing side give no groups.
    """
    wanted = specs.join(libraries.where((F.col("status") == "building") & F.col("rights_confirmed")).select("library_id"), "library_id", "left_semi")
    text = F.struct("section_ordinal", "ordinal", F.col("source_text").alias("t"))
    books = blocks.groupBy("book_id").agg(F.transform(F.sort_array(F.collect_list(text)), lambda s: s["t"]).alias("p"))
    pairings = (
        wanted.join(books.select(F.col("book_id").alias("source_book_id"), F.col("p").alias("source_paragraphs")), "source_book_id")
        .join(books.select(F.col("book_id").alias("target_book_id"), F.col("p").alias("target_paragraphs")), "target_book_id")
        .select(F.concat_ws(":", "library_id", "position").alias("pairing_id"), "source_paragraphs", "target_paragraphs")
    )
    groups = align_paragraphs(pairings).withColumn("library_id", F.substring_index("pairing_id", ":", 1))
    low = needs_review(F.col("confidence"))
    return groups.where(~low), groups.where(low)
