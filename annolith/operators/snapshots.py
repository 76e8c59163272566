"""Books as sets of entries: counts, sorted hashes, set hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolith.functions.keys import entry_signature, hash_text, highlight_signature, set_hash
from annolith.functions.text import key_text
from annolith.settings import UNKNOWN_AUTHOR


def with_hashes(entries: DataFrame) -> DataFrame:
    """entries with entry_hash and highlight_hash, unless they are there; content crosses to Python once."""
    if {"entry_hash", "highlight_hash"} <= set(entries.columns):
        return entries
    rows = entries.withColumn("_key", key_text(F.col("content")))
    return rows.withColumns({"entry_hash": hash_text(entry_signature(F.col("_key"))), "highlight_hash": hash_text(highlight_signature(F.col("_key")))}).drop("_key")


def snapshots(entries: DataFrame) -> DataFrame:
    """One row per book. Title and author come from the first place of its list (slot_seq), as do equal keys' spellings."""
    rows = with_hashes(entries).withColumn("_high", F.when(F.col("type") == "highlight", F.col("highlight_hash")))
    first = F.min_by(F.struct("title", F.coalesce(F.nullif("author", F.lit("")), F.lit(UNKNOWN_AUTHOR)).alias("author")), "slot_seq")
    books = rows.groupBy("analysis_id", "book_key").agg(
        first.alias("_first"),
        F.array_sort(F.collect_set("entry_hash")).alias("entry_hashes"),
        F.array_sort(F.collect_set("_high")).alias("highlight_hashes"),
        F.count_if(F.col("type") == "highlight").alias("highlight_count"),
        F.count_if(F.col("type") == "note").alias("note_count"),
        F.count_if(F.col("type") == "bookmark").alias("bookmark_count"),
        F.min("slot_seq").alias("first_seq"),
    )
    return books.select(
        "analysis_id",
        "book_key",
        F.col("_first.title").alias("title"),
        F.col("_first.author").alias("author"),
        "entry_hashes",
        "highlight_hashes",
        set_hash(F.col("entry_hashes")).alias("content_hash"),
        set_hash(F.col("highlight_hashes")).alias("highlight_hash"),
        "highlight_count",
        "note_count",
        "bookmark_count",
        "first_seq",
    )


def authors(rows: DataFrame) -> DataFrame:
    """Distinct authors, sorted."""
    return rows.select("author").distinct().orderBy("author")
