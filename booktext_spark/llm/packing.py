"""Sum-of-squares online packing of tokenised documents into windows of fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

PIECE_SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, donated boolean, ids binary"
#: Sequence ids of a task begin at its number times this.
IDS_PER_TASK = 1 << 36


class Levels:
    """Partly filled windows by fill level; counts[h] is the number of windows filled to h."""

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def place(self, length: int, new: int) -> tuple[int, int]:
        """(window, offset) for a piece of fewer tokens than a window; `new` names a window opened for it.

        Moving a window from level h to h + length changes the sum of squares by
        2 * (counts[h + length] - counts[h]) + 2; a new window by 2 * counts[length] + 1; a window that
        becomes full leaves the sum. The smallest change wins, at a tie the fuller window.
        """
        size, counts = self.size, self.counts
        top = size - length
        cost = np.full(top + 1, np.iinfo(np.int64).max)
        open_ = counts[1 : top + 1] > 0
        np.copyto(cost[1:], 2 * (counts[1 + length : size + 1] - counts[1 : top + 1]) + 2, where=open_)
        if counts[top]:
            cost[top] = 1 - 2 * counts[top]
        cost[0] = 2 * counts[length] + 1
        level = top - int(np.argmin(cost[::-1]))
        window = new if level == 0 else self.windows[level].pop()
        if level:
            counts[level] -= 1
        if level + length < size:
            counts[level + length] += 1
            self.windows[level + length].append(window)
        return window, level


def binary_parts(length: int) -> list[int]:
    """Powers of two that add up to length, largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def pack_stream(docs: Iterator[tuple[int | None, bytes]], size: int, first_sequence: int, open_tokens: int = 1 << 22) -> Iterator[tuple]:
    """Rows of PIECE_SCHEMA for (doc_id, little-endian 32-bit ids), in bounded memory.

    A document's full windows are cut off at once; its rest is placed whole by the level array, and a window
    goes out when it is full. Windows that are still open at the end stay as they were filled, but for the
    emptiest: these are donors, cut to fill the gaps of the others, and what is left of them is cut at powers of two,
    so that nothing is padded. Pieces from donors are marked `donated`. Open windows hold `open_tokens`
    tokens at most, a bound on memory; beyond it they are closed as at the end.
    """
    sequence = first_sequence
    levels, content = Levels(size), {}
    held = 0

    def row(doc, start, ids, total, window, offset, donated=False):
        return doc, start, len(ids) // 4, total, window, offset, donated, ids

    def laid(window: int) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in content[window]:
            yield row(doc, start, ids, total, window, at)
            at += len(ids) // 4

    def closed() -> Iterator[tuple]:
        nonlocal sequence
        fill = {w: sum(len(p[2]) // 4 for p in pieces) for w, pieces in content.items()}
        left = sum(fill.values())
        order = sorted(fill, key=lambda w: (-fill[w], w))
        stay, donors = order[: left // size], order[left // size :]
        given = (p for w in donors for p in content[w])
        piece = done = n = 0

        def take(window: int, at: int, room: int) -> Iterator[tuple]:
            nonlocal piece, done, n
            while room:
                if done == n:
                    piece, done = next(given), 0
                    n = len(piece[2]) // 4
                doc, start, ids, total = piece
                some = min(room, n - done)
                yield row(doc, start + done, ids[4 * done : 4 * (done + some)], total, window, at, True)
                done, room, at = done + some, room - some, at + some

        for w in stay:
            yield from laid(w)
            yield from take(w, fill[w], size - fill[w])
        for part in binary_parts(left % size):
            yield from take(sequence, 0, part)
            sequence += 1

    for doc, ids in docs:
        total = len(ids) // 4
        full = total // size
        for k in range(full):
            yield row(doc, k * size, ids[4 * k * size : 4 * (k + 1) * size], total, sequence, 0)
            sequence += 1
        rest = total - full * size
        if not rest:
            continue
        window, level = levels.place(rest, sequence)
        sequence += level == 0
        content.setdefault(window, []).append((doc, full * size, ids[4 * full * size :], total))
        held += rest
        if level + rest == size:
            yield from laid(window)
            del content[window]
            held -= size
        elif held > open_tokens:
            yield from closed()
            levels, content, held = Levels(size), {}, 0
    yield from closed()


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", memory: int = 160 << 20, open_tokens: int = 1 << 22, specials: bool = True) -> DataFrame:
    """Packs every document into sequences of at most `size` tokens; one row for each piece.

    docs: any DataFrame with an integer id and a text; other columns are ignored. vocabulary: a file of
    the tokenizers library. end_id follows each document (none if None). Each task packs what it reads,
    online, and closes its windows at its end; nothing is shuffled. memory: bytes that a worker's memory of
    encoded words takes; open_tokens: tokens in windows that are not full yet, see pack_stream. specials: whether the string of a
    special token inside a text has that token's id, as in the library's plain call (else it is ordinary text).

    Returns doc_id, start (the document's ids before the piece), length, doc_tokens, sequence_id, offset
    (in the sequence, gapless), donated (whether the piece fills a gap that the level array left) and ids
    (little-endian unsigned 32-bit). A null or empty text is its end
    id alone, and no row if end_id is None; null doc_ids stay null; repeated rows are packed each; an
    empty table gives no rows.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from booktext_spark.llm.tokens import encoder

        enc = encoder(vocabulary, memory, specials)
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        kinds = {"donated": pa.bool_(), "ids": pa.binary()}
        schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "donated", "ids")])

        def documents():
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield doc, enc.encode(text.as_py()) + end

        out: list[tuple] = []
        for piece in pack_stream(documents(), size, TaskContext.get().partitionId() * IDS_PER_TASK, open_tokens):
            out.append(piece)
            if len(out) >= 4000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, PIECE_SCHEMA)
