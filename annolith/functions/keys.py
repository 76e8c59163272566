"""Book keys, entry signatures and set hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annolith.functions.text import key_text, strip


def book_key(title: Column, author: Column) -> Column:
    """SHA-1 over both key forms. One UDF call: the separator survives the key form, so the pair is normalised alone."""
    return F.sha1(F.concat(key_text(title), F.lit("||"), key_text(author)))


def _or_none(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def entry_signature(key_content: Column) -> Column:
    """type|start|end|page|content over columns of entries; a missing value prints None."""
    parts = [_or_none(F.col(c)) for c in ("type", "start_pos", "end_pos", "page")]
    return F.concat_ws("|", *parts, key_content)


def highlight_signature(key_content: Column) -> Column:
    """As the entry signature, without the page."""
    parts = [_or_none(F.col(c)) for c in ("type", "start_pos", "end_pos")]
    return F.concat_ws("|", *parts, key_content)


def hash_text(value: Column) -> Column:
    return F.sha1(F.coalesce(value, F.lit("")))


def sorted_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def set_hash(values: Column) -> Column:
    """SHA-1 of the sorted distinct items; of nothing for an empty or missing set."""
    return hash_text(F.array_join(sorted_set(F.coalesce(values, F.array().cast("array<string>"))), "||"))


def clean_strings(values: Column) -> Column:
    """Trimmed, non-empty, sorted, distinct."""
    trimmed = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: strip(v))
    return sorted_set(F.filter(trimmed, lambda v: v.isNotNull() & (v != "")))


def clean_hashes(values: Column) -> Column:
    """SHA-1 hex stays (in lower case), any other text is hashed."""
    return sorted_set(F.transform(clean_strings(values), lambda v: F.when(v.rlike("^[0-9a-fA-F]{40}$"), F.lower(v)).otherwise(F.sha1(v))))
