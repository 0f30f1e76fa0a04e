"""Nearest neighbours by additive quantisation."""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from booktext_spark.llm.common import cut, slices, stored

#: Rows that the codebooks are fitted on, at most (about; chosen by hash).
SAMPLE = 20_000
#: Queries that are scored together, and those that are broadcast at once.
QUERY_BLOCK, QUERIES_AT_ONCE = 512, 8192
#: Vectors of one length that are compared with each other without codes.
FEW = 2048
#: Numbers of the vectors that are scored in pairs at once.
PAIR_NUMBERS = 1 << 21


def _smallest(cost: np.ndarray, number: int, block: int = 16) -> np.ndarray:
    """Columns of the `number` smallest costs of each row, in any order: they lie in as many blocks of smallest minimum."""
    n, width = cost.shape
    if width % block or width // block <= number:
        return np.argpartition(cost, min(number, width) - 1, axis=1)[:, :number]
    blocks = cost.reshape(n, width // block, block)
    near = np.argpartition(blocks.min(-1), number - 1, axis=1)[:, :number]
    among = np.take_along_axis(blocks, near[..., None], 1).reshape(n, -1)
    at = np.argpartition(among, number - 1, axis=1)[:, :number]
    return np.take_along_axis(near, at // block, 1) * block + at % block


@dataclass
class Codebooks:
    """Full-dimensional codebooks: a vector is near the sum of one entry of each. books: (m, k, dimensions)."""

    books: np.ndarray

    def encode(self, x: np.ndarray, beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared norms of the sums): beam search keeps the `beam` best partial sums of each vector."""
        n, (m, k, d) = len(x), self.books.shape
        codes = np.zeros((n, 1, 0), np.uint8)
        sums = np.zeros((n, 1, d), np.float32)
        for book in self.books:
            residual = x[:, None, :] - sums
            cost = residual.reshape(-1, d) @ (-2 * book.T)
            cost += (book**2).sum(-1)
            cost += np.einsum("nbd,nbd->nb", residual, residual).reshape(-1, 1)
            cost = cost.reshape(n, -1)
            best = _smallest(cost, beam)
            parent, entry = best // k, best % k
            codes = np.concatenate([np.take_along_axis(codes, parent[..., None], 1), entry[..., None].astype(np.uint8)], -1)
            sums = np.take_along_axis(sums, parent[..., None], 1) + book[entry]
        at = ((x[:, None, :] - sums) ** 2).sum(-1).argmin(1)
        rows = np.arange(n)
        return codes[rows, at], (sums[rows, at] ** 2).sum(-1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The sums that codes stand for."""
        return sum(book[codes[:, m]] for m, book in enumerate(self.books))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Dot products of queries with all entries: (queries, m, k)."""
        return np.einsum("qd,mkd->qmk", queries, self.books, optimize=True).astype(np.float32)


def _sums(x: np.ndarray, at: np.ndarray, groups: int) -> np.ndarray:
    """Sums of the rows of x by their group."""
    order = np.argsort(at, kind="stable")
    out = np.zeros((groups, x.shape[1]), np.float32)
    if len(x):
        here, first = np.unique(at[order], return_index=True)
        out[here] = np.add.reduceat(x[order], first, axis=0)
    return out


def fit_codebooks(x: np.ndarray, books: int = 16, entries: int = 256, rounds: int = 6, seed: int = 7) -> Codebooks:
    """Codebooks by k-means on successive residuals, then refitted together by least squares on beam-searched codes."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    entries = min(entries, max(1, len(x)))
    left, out = x.copy(), []
    for _ in range(books):
        centres = left[rng.choice(len(left), entries, replace=False)]
        for _ in range(rounds):
            near = ((centres**2).sum(-1) - 2 * left @ centres.T).argmin(1)
            size = np.bincount(near, minlength=entries)
            centres = np.where(size[:, None] > 0, _sums(left, near, entries) / np.maximum(size, 1)[:, None], left[rng.choice(len(left), entries)])
        near = ((centres**2).sum(-1) - 2 * left @ centres.T).argmin(1)
        left = left - centres[near]
        out.append(centres)
    fitted = Codebooks(np.stack(out).astype(np.float32))
    if len(x) >= 4 * entries:
        codes = np.concatenate([fitted.encode(x[i : i + 1024])[0] for i in range(0, len(x), 1024)]).astype(np.int64)
        number = books * entries
        gram, side = np.zeros((books, entries, books, entries), np.float32), np.zeros((books, entries, x.shape[1]), np.float32)
        for i in range(books):
            side[i] = _sums(x, codes[:, i], entries)
            for j in range(books):
                gram[i, :, j] = np.bincount(codes[:, i] * entries + codes[:, j], minlength=entries * entries).reshape(entries, entries)
        square = gram.reshape(number, number)
        square.flat[:: number + 1] += 1
        solved = np.linalg.solve(square, side.reshape(number, -1) + fitted.books.reshape(number, -1))
        fitted = Codebooks(solved.reshape(fitted.books.shape).astype(np.float32))
    return fitted


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array of doubles): rows that are not null or zero and hold no null or non-finite component."""
    v = F.col(vector_col).cast("array<double>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    return rows.where(~odd & F.exists("v", lambda x: x != 0))


def _matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _first_of_equal(same: np.ndarray, number: int) -> np.ndarray:
    """For each row of keys in order, which ones are among the first `number` with their key."""
    order = np.argsort(same, axis=-1, kind="stable")
    ranked = np.take_along_axis(same, order, -1)
    out = np.ones(same.shape, bool)
    late = np.zeros(same.shape, bool)
    late[..., number:] = ranked[..., number:] == ranked[..., :-number] if number < same.shape[-1] else False
    np.put_along_axis(out, order, ~late, -1)
    return out


class Best:
    """The `keep` rows of largest lookup score of each query so far, ties to the smaller id, then row.

    Of rows with one vector the `copies` of the smallest ids are kept: no other of them can be among as many neighbours.
    """

    def __init__(self, queries: int, keep: int, copies: int):
        self.keep, self.copies = keep, copies
        self.scores = np.full((queries, 0), -np.inf, np.float32)
        self.ids, self.rows, self.same = (np.zeros((queries, 0), np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, same: np.ndarray) -> None:
        """scores (queries, rows) of rows with these ids, row numbers and vector keys."""
        if self.scores.shape[1] == self.keep:  # what is under the worst so far cannot enter
            columns = np.flatnonzero((scores >= self.scores[:, -1:]).any(0))
            scores, ids, rows, same = scores[:, columns], ids[columns], rows[columns], same[columns]
        if scores.shape[1] > self.keep:
            some = np.argpartition(-scores, self.keep - 1, axis=1)[:, : self.keep]
        else:
            some = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
        scores = np.concatenate([self.scores, np.take_along_axis(scores, some, 1)], 1)
        ids, rows, same = (np.concatenate([old, new[some]], 1) for old, new in ((self.ids, ids), (self.rows, rows), (self.same, same)))
        order = np.lexsort((rows, ids, -scores), axis=-1)
        scores, ids, rows, same = (np.take_along_axis(x, order, 1) for x in (scores, ids, rows, same))
        scores = np.where(_first_of_equal(same, self.copies), scores, -np.inf)
        order = np.argsort(-scores, axis=1, kind="stable")[:, : self.keep]
        self.scores, self.ids, self.rows, self.same = (np.take_along_axis(x, order, 1) for x in (scores, ids, rows, same))


class Nearest:
    """The k rows of largest cosine of each query so far, ties to the smaller id, then row."""

    def __init__(self, queries: np.ndarray, numbers: np.ndarray, k: int):
        self.queries, self.numbers, self.k = queries, numbers, k
        self.least = np.full(len(queries), -np.inf)
        self.at, self.ids, self.rows = (np.zeros(0, np.int64) for _ in range(3))
        self.scores = np.zeros(0)

    def _cosines(self, unit: np.ndarray, at: np.ndarray, columns: np.ndarray) -> np.ndarray:
        size = max(1, PAIR_NUMBERS // unit.shape[1])
        parts = [slice(lo, lo + size) for lo in range(0, len(at), size)]
        return np.concatenate([np.zeros(0), *(np.einsum("nd,nd->n", unit[columns[p]], self.queries[at[p]]) for p in parts)])

    def add(self, products: np.ndarray, norms: np.ndarray, off: np.ndarray, slack: float, unit: np.ndarray, ids: np.ndarray, rows: np.ndarray, keep: int) -> None:
        """Rows with lookup products (queries, rows), of which all are scored whose product and coding error may reach the k-th best.

        A unit query's product with what a row's codes leave out is at most that rest's length. The `keep` best by lookup score of the first
        rows give the first bound; where it spares few pairs, a matrix product finds those that reach it.
        """
        other = rows != self.numbers[:, None]
        least = self.least
        if not len(self.at) and len(ids) > keep + 1 > self.k:
            some = np.argpartition(-products / norms, keep, axis=1)[:, : keep + 1]
            at = np.repeat(np.arange(len(some)), keep + 1)
            first = np.where(np.take_along_axis(other, some, 1), self._cosines(unit, at, some.ravel()).reshape(some.shape), -np.inf)
            least = np.partition(first, keep + 1 - self.k, axis=1)[:, keep + 1 - self.k]
        near = other & ~(products + (off + slack) < least[:, None])
        if np.count_nonzero(near) * 32 > near.size:
            near &= self.queries @ unit.T >= least[:, None] - 1e-9
        at, columns = np.nonzero(near)
        if not len(at):
            return
        at, ids, rows, scores = (np.concatenate(x) for x in ((self.at, at), (self.ids, ids[columns]), (self.rows, rows[columns]), (self.scores, self._cosines(unit, at, columns))))
        order = np.lexsort((rows, ids, -scores, at))
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        order = order[place < self.k]
        self.ids, self.rows, self.scores = ids[order], rows[order], scores[order]
        self.at, last = at[place < self.k], place[place < self.k] == self.k - 1
        self.least[self.at[last]] = self.scores[last]


FOUND = "query_id bigint, rank int, vec_id bigint, score double"
SCORED = "query_row bigint, query_id bigint, vec_id bigint, row bigint, score double"


def search(vectors: DataFrame, query_every: int = 50, k: int = 5, keep: int = 400, books: int = 16, entries: int = 256, beam: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", exact: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of largest cosine found for each row whose id is divisible by query_every.

    Unit vectors are coded as sums of one entry of each codebook. Each task scores its rows for blocks of queries by
    table lookups alone (dot product over the stored norm of the sum) and keeps the `keep` best of each query; these
    meet, the `keep` best of all tasks stay for each query, and only they are scored exactly. More codebooks or a larger keep
    find more; wide vectors without structure need many more, see the README. exact: each task scores every row whose lookup product and
    coding error may reach the k-th best that it has found, so that the result is that of brute force, at a cost that grows with the errors.

    Every row but the query's own is a candidate: rows that repeat an id are rows of their own, as candidates and as queries. Vectors meet those of their
    length only; where another length is more frequent, FEW or fewer of one length are compared without codes. Ties go to the smaller id. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    rows = stored(usable_vectors(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()).withColumn("d", F.size("v")), "ann-rows")
    lengths = {r.d: r["count"] for r in rows.groupBy("d").count().collect()}  # a row for each length
    if not lengths:
        return spark.createDataFrame([], FOUND)
    most = max(lengths, key=lambda d: (lengths[d], -d))
    many = sorted(d for d, n in lengths.items() if n > FEW or d == most)
    parts = [_coded_search(rows.where(F.col("d") == d), lengths[d], query_every, k, keep, books, entries, beam, exact) for d in many]
    if len(many) < len(lengths):
        parts.append(_compared(rows.where(~F.col("d").isin(many)), query_every, k))
    return reduce(DataFrame.unionByName, parts)


def _compared(rows: DataFrame, query_every: int, k: int) -> DataFrame:
    """The nearest rows among those of each length, of which there are few, by all cosines."""

    def run(group):
        import pyarrow as pa

        ids, row = group.column("vec_id").to_numpy(), group.column("row").to_numpy()
        unit = _unit(_matrix(group.column("v").combine_chunks()))
        asked = np.flatnonzero(ids % query_every == 0)
        score = unit[asked] @ unit.T
        score[np.arange(len(asked)), asked] = -np.inf
        order = np.lexsort((np.broadcast_to(row, score.shape), np.broadcast_to(ids, score.shape), -score), axis=-1)[:, : min(k, len(ids) - 1)]
        query = np.repeat(ids[asked], order.shape[1])
        rank = np.tile(np.arange(1, order.shape[1] + 1), len(asked)).astype(np.int32)
        return pa.table([pa.array(query), pa.array(rank), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(score, order, 1).ravel())], names=["query_id", "rank", "vec_id", "score"])

    return rows.groupBy("d").applyInArrow(run, FOUND)


def _coded_search(rows: DataFrame, total: int, query_every: int, k: int, keep: int, books: int, entries: int, beam: int, exact: bool) -> DataFrame:
    """search among rows(vec_id, v, row) of one length."""
    spark = rows.sparkSession
    share = min(1.0, SAMPLE / total)
    sample = rows.where(F.pmod(F.xxhash64("vec_id", "row"), F.lit(1 << 20)) < max(1, int(share * (1 << 20)))).select("v").toArrow().column(0).combine_chunks()
    if not len(sample):
        sample = rows.select("v").limit(1).toArrow().column(0).combine_chunks()
    ship = spark.sparkContext.broadcast(pickle.dumps(fit_codebooks(_unit(_matrix(sample)), books, entries)))

    def code(batches):
        import pyarrow as pa

        fitted: Codebooks = pickle.loads(ship.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                unit = _unit(_matrix(part.column(3))).astype(np.float32)
                codes, norms = fitted.encode(unit, beam)
                off = np.linalg.norm(unit - fitted.decode(codes), axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.sqrt(np.maximum(norms, 1e-12)), pa.float32()), pa.array(off, pa.float32()), *part.columns[3 : 3 + exact]], names=["vec_id", "row", "same", "codes", "norm", "off", "v"][: 6 + exact])

    kind = "vec_id bigint, row bigint, same bigint, codes binary, norm float, off float" + ", v array<double>" * exact
    coded = stored(rows.select("vec_id", "row", F.xxhash64("v").alias("same"), "v").mapInArrow(code, kind), "ann-codes")
    queries = cut(rows.where(F.col("vec_id") % query_every == 0).select("vec_id", "row", "v"))
    parts, out = -(-queries.count() // QUERIES_AT_ONCE), None
    for block in range(parts):
        mine = queries.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == block).toArrow()
        if not mine.num_rows:
            continue
        asked = spark.sparkContext.broadcast(pickle.dumps((mine.column(0).to_numpy(), mine.column(1).to_numpy(), _unit(_matrix(mine.column(2).combine_chunks())))))
        best = _reachable(coded, ship, asked, k, keep) if exact else _exact(_shortlist(coded, ship, asked, k, keep), rows, asked)
        best = _ranked(best, k)
        out = best if out is None else out.unionByName(best)
    return spark.createDataFrame([], FOUND) if out is None else out.select("query_id", "rank", "vec_id", "score")


def _products(fitted: Codebooks, table: np.ndarray, part) -> np.ndarray:
    """Dot products (queries, rows) of a block's queries with the sums that rows' codes stand for, by lookups."""
    codes = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(part.num_rows, -1)
    out = np.zeros((len(table), len(codes)), np.float32)
    for m in range(codes.shape[1]):
        out += table[:, m, :][:, codes[:, m]]
    return out


def _shortlist(coded: DataFrame, ship, asked, k: int, keep: int) -> DataFrame:
    """query_row, row: the `keep` rows of largest lookup score for each query, of all tasks."""

    def run(batches):
        import pyarrow as pa

        fitted: Codebooks = pickle.loads(ship.value)
        ids, numbers, unit = pickle.loads(asked.value)
        blocks = [slice(at, at + QUERY_BLOCK) for at in range(0, len(ids), QUERY_BLOCK)]
        tables = [fitted.tables(unit[b].astype(np.float32)) for b in blocks]
        best = [Best(len(ids[b]), keep + 1, k + 1) for b in blocks]  # the query itself may be one
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                own, number, same = (part.column(i).to_numpy() for i in range(3))
                first = np.lexsort((number, own))
                first = first[_first_of_equal(same[first], k + 1)]
                part = part.take(pa.array(first))
                own, number, same, norms = (part.column(i).to_numpy() for i in (0, 1, 2, 4))
                for table, top in zip(tables, best, strict=True):
                    top.add(_products(fitted, table, part) / norms, own, number, same)
        for b, top in zip(blocks, best, strict=True):
            rows, columns = np.nonzero(np.isfinite(top.scores) & (top.rows != numbers[b][:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (numbers[b][rows], top.ids[rows, columns], top.rows[rows, columns], top.same[rows, columns], top.scores[rows, columns])], names=["query_row", "vec_id", "row", "same", "guess"])

    found = coded.mapInArrow(run, "query_row bigint, vec_id bigint, row bigint, same bigint, guess float")
    copies = found.withColumn("copy", F.row_number().over(Window.partitionBy("query_row", "same").orderBy("vec_id", "row"))).where(F.col("copy") <= k)
    order = Window.partitionBy("query_row").orderBy(F.desc("guess"), "vec_id", "row")
    return copies.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep).select("query_row", "row")


def _reachable(coded: DataFrame, ship, asked, k: int, keep: int) -> DataFrame:
    """query_row, query_id, vec_id, row, score: for each query the k nearest rows of each task, by bounds from the codes and cosines of what they leave."""

    def run(batches):
        import pyarrow as pa

        fitted: Codebooks = pickle.loads(ship.value)
        ids, numbers, unit = pickle.loads(asked.value)
        slack = 1e-4 + 1e-5 * float(np.linalg.norm(fitted.books, axis=2).max(1).sum())  # rounding of single precision
        blocks = [slice(at, at + QUERY_BLOCK) for at in range(0, len(ids), QUERY_BLOCK)]
        tables = [fitted.tables(unit[b].astype(np.float32)) for b in blocks]
        best = [Nearest(unit[b], numbers[b], k) for b in blocks]
        for part in slices(batches, 4096):
            own, number, same = (part.column(i).to_numpy() for i in range(3))
            first = np.lexsort((number, own))
            part = part.take(pa.array(first[_first_of_equal(same[first], k + 1)]))  # the query itself may be one
            own, number, norms, off = (part.column(i).to_numpy() for i in (0, 1, 4, 5))
            vectors = _unit(_matrix(part.column(6)))
            for table, top in zip(tables, best, strict=True):
                top.add(_products(fitted, table, part), norms, off, slack, vectors, own, number, keep)
        for b, top in zip(blocks, best, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (numbers[b][top.at], ids[b][top.at], top.ids, top.rows, top.scores)], names=["query_row", "query_id", "vec_id", "row", "score"])

    return coded.mapInArrow(run, SCORED)


def _exact(pairs: DataFrame, rows: DataFrame, asked) -> DataFrame:
    """query_row, query_id, vec_id, row, score of the pairs, by cosines of the vectors themselves."""

    def run(batches):
        import pyarrow as pa

        ids, numbers, unit = pickle.loads(asked.value)
        order = np.argsort(numbers)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                place = order[np.searchsorted(numbers, part.column(0).to_numpy(), sorter=order)]
                score = np.einsum("nd,nd->n", _unit(_matrix(part.column(3))), unit[place])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids[place]), part.column(1), part.column(2), pa.array(score)], names=["query_row", "query_id", "vec_id", "row", "score"])

    joined = stored(pairs, "ann-pairs").join(rows, "row").select("query_row", "vec_id", "row", "v")
    return joined.mapInArrow(run, SCORED)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    """query_row, query_id, rank, vec_id, score of the k nearest of the rows that are scored for each query."""
    nearest = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return scored.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_id", "score")
