"""Chat formatting with loss masks aligned to token offsets."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import compress

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template: a turn is its escaped role and a line end, then its escaped text between two marks, and a line end.
#: The marks are tokens of their own, so no token holds both text and template.
OPEN, CLOSE = "<turn>", "</turn>"
#: A mark inside a role or text gets a backslash behind its first sign, and a backslash another one.
CONTROL = re.compile(r"\\|<(?=/?turn>)")
ESCAPED = re.compile(r"\\\\|<\\(?=/?turn>)")
TURNS = re.compile(f"(.*?)\n{OPEN}(.*?){CLOSE}\n", re.S)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[0][0], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the span of each turn's escaped text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{escape(role)}\n{OPEN}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{CLOSE}\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: the inverse of render."""
    return [(unescape(role), unescape(text)) for role, text in TURNS.findall(formatted)]


def chat_tokenizer(vocabulary: str):
    """The vocabulary's tokenizer with the template's marks as tokens, whose ids follow its own."""
    from tokenizers import AddedToken

    from booktext_spark.llm.tokens import load

    tokenizer = load(vocabulary)
    tokenizer.add_tokens([AddedToken(m, normalized=False) for m in (OPEN, CLOSE)])
    return tokenizer


def loss_mask(token_spans: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[bool]:
    """Whether each token overlaps one of the sorted, disjoint `spans`.

    Both lists are sorted, so the first and last token of a span are found by binary search. Empty spans have no token.
    """
    starts, ends = [a for a, _ in token_spans], [b for _, b in token_spans]
    mask = [False] * len(token_spans)
    for a, b in spans:
        if a < b:
            low, high = bisect_right(ends, a), bisect_left(starts, b)
            mask[low:high] = [True] * (high - low)
    return mask


def masked_text(formatted: str, token_starts: list[int], token_stops: list[int], mask: list[bool]) -> str:
    """What the masked tokens hold, in order; a character that several tokens share counts once."""
    parts, at = [], 0
    for a, b in compress(zip(token_starts, token_stops, strict=True), mask):
        if b > at:
            parts.append(formatted[max(a, at) : b])
            at = b
    return "".join(parts)


FORMAT_SCHEMA = "conv_id bigint, formatted string, turn_spans array<struct<start:int,stop:int>>, ids array<int>, token_starts array<int>, token_stops array<int>, loss_mask array<boolean>"


def format_conversations(conversations: DataFrame, vocabulary: str, loss_role: str = "assistant") -> DataFrame:
    """One row for each conv_id: formatted text, spans of the turns' texts, token ids and their offsets, token mask.

    conversations has conv_id, turn, role and text; other columns are ignored. Turns go by turn, then
    role and text (nulls first); repeated rows are turns of their own; null roles and texts are empty;
    null conv_ids are one conversation. Each conversation is rendered whole and encoded once; a token is in the mask if
    it overlaps the text of a turn of `loss_role`. As marks are tokens, masked tokens hold these texts and nothing else where
    the vocabulary keeps all characters. Offsets count code points. A conversation is one string, so
    its turns meet in one row. An empty table gives no rows.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def lists(rows, kind):
            sizes = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(sizes), pa.array([x for r in rows for x in r], kind))

        tokenizer = chat_tokenizer(vocabulary)
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                convs = [[(t["role"], t["text"]) for t in turns] for turns in part.column(1).to_pylist()]
                made = [render(c) for c in convs]
                ids, starts, stops, masks = [], [], [], []
                for turns, (_, spans), e in zip(convs, made, tokenizer.encode_batch([m[0] for m in made], add_special_tokens=False), strict=True):
                    offsets = e.offsets
                    ids.append(e.ids)
                    starts.append([a for a, _ in offsets])
                    stops.append([b for _, b in offsets])
                    masks.append(loss_mask(offsets, [s for (role, _), s in zip(turns, spans, strict=True) if role == loss_role]))
                whole = [part.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([[{"start": a, "stop": b} for a, b in m[1]] for m in made], span)]
                yield pa.RecordBatch.from_arrays([*whole, lists(ids, pa.int32()), lists(starts, pa.int32()), lists(stops, pa.int32()), lists(masks, pa.bool_())], names=["conv_id", "formatted", "turn_spans", "ids", "token_starts", "token_stops", "loss_mask"])

    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = conversations.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.mapInArrow(run, FORMAT_SCHEMA)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted rows hold: conv_id, turns (parsed), loss_text (of the masked tokens, unescaped, in order), formatted.

    An empty table gives no rows; a conversation without masked tokens has an empty loss_text.
    """

    def run(batches):
        import pyarrow as pa

        turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            texts, *tokens = (c.to_pylist() for c in batch.columns[1:])
            turns = [[{"role": r, "text": t} for r, t in parse(x)] for x in texts]
            loss = [unescape(masked_text(*row)) for row in zip(texts, *tokens, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(turns, turn), pa.array(loss, pa.string()), batch.column(1)], names=["conv_id", "turns", "loss_text", "formatted"])

    rows = formatted.select("conv_id", "formatted", "token_starts", "token_stops", "loss_mask")
    return rows.mapInArrow(run, "conv_id bigint, turns array<struct<role:string,text:string>>, loss_text string, formatted string")
