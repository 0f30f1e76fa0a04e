"""Text columns: normalisers, tokens, ratios and the paragraph match cost."""

from __future__ import annotations

import unicodedata
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

#: White space as Python's \s and strip() see it. Java's \s misses U+3000, and (?U)\s misses U+001C to U+001F.
WS = r"(?U)[\s\x1c-\x1f]"
#: Opening and closing signs of dialogue, and sentence ends.
DIALOGUE_OPEN, DIALOGUE_CLOSE, SENTENCE_END = "「『“\"", "」』”\"", "。！？!?"
#: The marks that a style profile counts.
PROFILE_MARKS = ("。", "、", "！", "？", "……", "——")
#: Cost of a target length, of a dialogue and of a sentence-end mismatch, and the review threshold.
TARGET_SHARE, LENGTH_CAP, DIALOGUE_COST, END_COST, REVIEW_BELOW = 0.72, 2.5, 0.28, 0.12, 0.64



def strip(c: Column) -> Column:
    """c without white space at both ends."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def canonical_text(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark SQL lacks."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def copying_form(texts: pd.Series) -> pd.Series:
    """NFKC, lower case, letters and numbers only; whole in Python, whose Unicode tables are newer than the JVM's."""

    def one(t: str | None) -> str | None:
        return None if t is None else "".join(filter(str.isalnum, unicodedata.normalize("NFKC", t).lower()))

    return texts.map(one)


def normalize_reference_text(c: Column) -> Column:
    return canonical_text(nfkc(c))


def normalize_for_copying(c: Column) -> Column:
    return copying_form(c)


def windows(c: Column, n: int) -> Column:
    """All runs of n characters, in order; none if c is shorter.

    A look-ahead takes them in one pass; texts with characters beyond U+FFFF, which Java's regular expressions
    step through by halves, take the slower way.
    """
    length = F.length(c)
    slow = F.when(length >= n, F.transform(F.sequence(F.lit(1), length - (n - 1)), lambda i: F.substr(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.when(c.rlike(r"[\x{10000}-\x{10FFFF}]"), slow).otherwise(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), 1))


def search_tokens(c: Column) -> Column:
    """Distinct tokens in order: 2-grams, then 3-grams of the text without spaces and punctuation, then Latin words.

    c is a column of a table that holds NFKC text already: Spark takes no Python function inside an array expression.
    """
    text = F.lower(c)
    compact = F.regexp_replace(text, r"(?U)[\s\x1c-\x1f\p{P}]", "")
    return F.array_distinct(F.concat(windows(compact, 2), windows(compact, 3), F.regexp_extract_all(text, F.lit("[a-z0-9_]{2,}"), 0)))


def char_ngrams(c: Column, n: int = 8) -> Column:
    """The set of n-grams of a text in copying form."""
    return F.array_distinct(windows(c, n))


def normalized_length(c: Column) -> Column:
    return F.length(F.regexp_replace(c, WS, ""))


def dialogue_signature(c: Column) -> Column:
    bare = strip(c)
    return F.struct(bare.rlike(f"^[{DIALOGUE_OPEN}]").alias("opens"), bare.rlike(f"[{DIALOGUE_CLOSE}]$").alias("closes"))


def ends_sentence(c: Column) -> Column:
    return strip(c).rlike(f"[{SENTENCE_END}]$")


def match_cost(source: Column, target: Column) -> Column:
    """Cost of matching two paragraphs: length ratio, dialogue signature, sentence end.

    The expected length is a decimal product, rounded once: a binary one is off in its last place, and confidences of just 0.64 (45 for 40 characters) fall below it.
    """
    expected = F.greatest((F.greatest(normalized_length(source), F.lit(1)) * F.lit(Decimal(str(TARGET_SHARE)))).cast("double"), F.lit(1.0))
    length = F.least(F.abs(F.log(F.greatest(normalized_length(target), F.lit(1)) / expected)), F.lit(LENGTH_CAP))
    dialogue = F.when(dialogue_signature(source) == dialogue_signature(target), 0.0).otherwise(DIALOGUE_COST)
    return length + dialogue + F.when(ends_sentence(source) == ends_sentence(target), 0.0).otherwise(END_COST)


def confidence(cost: Column) -> Column:
    return F.least(F.greatest(F.exp(-cost), F.lit(0.0)), F.lit(1.0))


def needs_review(value: Column) -> Column:
    return value < REVIEW_BELOW


def char_ratios(c: Column) -> Column:
    """Shares of Japanese characters among visible ones (1 if none is), of control characters and of U+FFFD."""
    visible = F.regexp_replace(c, WS, "")
    size = F.greatest(F.length(c), F.lit(1))
    return F.struct(
        F.when(F.length(visible) > 0, F.regexp_count(visible, F.lit("[\\u3040-\\u30ff\\u3400-\\u9fff]")) / F.length(visible)).otherwise(1.0).alias("japanese"),
        (F.regexp_count(c, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")) / size).alias("control"),
        (F.regexp_count(c, F.lit("\\ufffd")) / size).alias("replacement"),
    )


def contains_cjk(c: Column) -> Column:
    return c.rlike("[\\u3040-\\u30ff\\u3400-\\u9fff]")


def text_for(translations: Column, locale: str, source: Column) -> Column:
    """The translation into a locale, an empty one too, else the source text."""
    return F.coalesce(F.try_element_at(translations, F.lit(locale)), source)


def occurrences(c: Column, mark: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))) / len(mark)).cast("bigint")


def common_run(a: str, b: str) -> int:
    """Length of the longest common substring, by one row of lengths at a time."""
    if not a or not b:
        return 0
    x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in ((a, b) if len(a) >= len(b) else (b, a)))
    row, best = np.zeros(len(x) + 1, np.int32), 0
    for c in y:
        row[1:] = np.where(x == c, row[:-1] + 1, 0)
        best = max(best, int(row.max()))
    return best


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0 if x is None or y is None else common_run(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")
