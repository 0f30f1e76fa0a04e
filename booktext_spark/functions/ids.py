"""Stable identities and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from booktext_spark.functions.text import canonical_text, normalize_reference_text, strip


def stable_identifier(prefix: str, *parts: Column) -> Column:
    """prefix_ and 24 hex digits of the SHA-256 of the parts as a compact JSON array of strings; a null part is None."""
    listed = F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]))
    # JSON escapes of control characters: lower-case hex digits; few texts have any
    escape = r"(?<!\\)(?=\\u00[01][0-9A-F])"
    low = F.array_join(F.transform(F.split(listed, escape), lambda s: F.when(s.rlike(r"^\\u00[01][A-F]"), F.concat(F.lower(F.substring(s, 1, 6)), F.substring(s, 7, 1 << 30))).otherwise(s)), "")
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.when(F.contains(listed, F.lit("\\u00")), low).otherwise(listed), 256), 1, 24))


def block_identifier(source_hash: Column, section_locator: Column, locator: Column, text: Column) -> Column:
    return stable_identifier("blk", source_hash, section_locator, locator, canonical_text(text))


def pair_hash(source: Column, target: Column, locale: Column) -> Column:
    """SHA-256 over the lower-cased locale and both normalised texts."""
    return F.sha2(F.concat_ws("\u001f", F.lower(locale), normalize_reference_text(source), normalize_reference_text(target)), 256)


def alignment_hash(source: Column, target: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", strip(source), strip(target)), 256)


def source_hash(content: Column) -> Column:
    return F.sha2(content, 256)
