"""What a book's state is against the history: two vocabularies that never mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolith.functions.dates import display
from annolith.functions.keys import sorted_set
from annolith.settings import FILTER_LABELS, STATUS_LABELS, STATUS_ORDER


def _set(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


def _new(now: Column, then: Column) -> Column:
    """Distinct hashes of now that then lacks."""
    return F.size(F.array_except(now, then)).cast("long")


def _known(snapshots: DataFrame, history: DataFrame) -> DataFrame:
    """snapshots left-joined with the books of the history, whose columns get the prefix was_."""
    was = history.select("book_key", *[F.col(c).alias(f"was_{c}") for c in history.columns if c != "book_key"], F.lit(True).alias("was_known"))
    return snapshots.join(was, "book_key", "left").withColumn("was_known", F.coalesce("was_known", F.lit(False)))


def classify(snapshots: DataFrame, history: DataFrame) -> DataFrame:
    """snapshots with status, new_highlights_count, has_new_highlights and has_changes_since_export.

    history: book_key, highlight_hashes, last_analysis_at, last_export_at, last_export_signature,
    last_export_highlight_hashes, last_export_formats. An export that kept no hashes counts with those last analysed.
    """
    rows = _known(snapshots, history)
    never = ~F.col("was_known") | F.col("was_last_export_at").isNull()
    exported = _set("was_last_export_highlight_hashes")
    seen = F.when(never, F.array().cast("array<string>")).when(F.size(exported) > 0, exported).otherwise(_set("was_highlight_hashes"))
    changed = never | F.col("was_last_export_signature").isNull() | (F.col("content_hash") != F.col("was_last_export_signature"))
    status = F.when(~F.col("was_known"), "novo").when(never, "nunca_exportado").when(changed, "com_novidades").otherwise("sem_novidades")
    rows = rows.withColumns({"status": status, "new_highlights_count": _new(F.col("highlight_hashes"), seen), "has_changes_since_export": changed})
    return rows.withColumn("has_new_highlights", F.col("new_highlights_count") > 0)


def detect(snapshots: DataFrame, history: DataFrame) -> DataFrame:
    """snapshots with detected_status (novo, sem_mudancas, atualizado) and detected_new: against what was last analysed."""
    rows = _known(snapshots, history)
    fresh = ~F.col("was_known") | ((F.size(_set("was_entry_hashes")) == 0) & F.col("was_last_analysis_at").isNull())
    same = sorted_set(F.col("entry_hashes")) == sorted_set(_set("was_entry_hashes"))
    status = F.when(fresh, "novo").when(same, "sem_mudancas").otherwise("atualizado")
    count = F.when(fresh, F.size("highlight_hashes").cast("long")).when(same, F.lit(0).cast("long")).otherwise(_new(F.col("highlight_hashes"), _set("was_highlight_hashes")))
    return rows.withColumns({"detected_status": status, "detected_new": count})


def label(status: Column) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair]), status)
    return F.coalesce(found, status)


def priority(status: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, s in enumerate(STATUS_ORDER) for x in (s, i)]), status), F.lit(99))


def order() -> list[Column]:
    """The table's order: by status, then title and author in lower case, then place in the file."""
    return [priority(F.col("status")), F.lower("title"), F.lower("author"), F.col("first_seq")]


def books_table(snapshots: DataFrame, history: DataFrame, analysed_at: str | None = None, forced: bool = False) -> DataFrame:
    """The rows of the books table, in its order. analysed_at: ISO text of the analysis that is being stored, if any."""
    rows = classify(snapshots, history)
    last_analysis = F.coalesce(F.lit(analysed_at), F.col("was_last_analysis_at"))
    out = rows.orderBy(*order())
    return out.select(
        "analysis_id",
        "book_key",
        "title",
        "author",
        F.col("highlight_count").alias("highlights"),
        F.col("note_count").alias("notes"),
        F.col("bookmark_count").alias("bookmarks"),
        "status",
        label(F.col("status")).alias("status_label"),
        "new_highlights_count",
        "has_new_highlights",
        "has_changes_since_export",
        (F.col("status") != "sem_novidades").alias("default_selected"),
        last_analysis.alias("last_analysis_at"),
        display(last_analysis).alias("last_analysis_display"),
        F.col("was_last_export_at").alias("last_export_at"),
        display(F.col("was_last_export_at")).alias("last_export_display"),
        _set("was_last_export_formats").alias("last_export_formats"),
        F.col("was_known").alias("was_processed_before"),
        F.col("was_last_export_at").isNotNull().alias("was_exported_before"),
        F.lit(forced).alias("forced_reprocess"),
        "first_seq",
    )


def fresh_entries(hashed: DataFrame, history: DataFrame) -> DataFrame:
    """Entries (with entry_hash) that the last export of their book did not hold. A book without one passes whole."""
    sent = history.select("book_key", F.explode(_set("last_export_entry_hashes")).alias("entry_hash"))
    return hashed.join(sent, ["book_key", "entry_hash"], "left_anti")


def status_options(has_rows: bool) -> list[dict[str, str]]:
    return [{"value": k, "label": v} for k, v in FILTER_LABELS.items() if has_rows or k != "todos"]
