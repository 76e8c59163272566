"""Choosing books: filters, batch actions, summaries, optimistic marking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolith.functions.text import strip
from annolith.settings import STATUS_ORDER


def default_selection(rows: DataFrame) -> DataFrame:
    """(book_key, selected) as recommended."""
    return rows.select("book_key", F.col("default_selected").alias("selected"))


def as_map(selection: DataFrame) -> DataFrame:
    """The selection of one analysis as a single map; a books table is as long as one reader's library."""
    return selection.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("book_key", "selected")))).alias("selection"))


def _selected(rows: DataFrame, selection: DataFrame) -> DataFrame:
    return rows.join(selection.select("book_key", F.col("selected").alias("_on")), "book_key", "left").withColumn("_on", F.coalesce("_on", F.lit(False)))


def filter_rows(rows: DataFrame, selection: DataFrame, search: str = "", author: str = "Todos", status: str = "todos", selected_only: bool = False) -> DataFrame:
    """All conditions must hold; search is a lower-case substring of 'title author'."""
    kept = _selected(rows, selection)
    if text := search.strip().lower():
        kept = kept.filter(F.contains(F.lower(F.concat_ws(" ", "title", "author")), F.lit(text)))
    if author != "Todos":
        kept = kept.filter(F.col("author") == author)
    if selected_only or status == "selecionados":
        kept = kept.filter("_on")
    if status not in ("todos", "selecionados"):
        kept = kept.filter(F.col("status") == status)
    return kept.drop("_on")


def search_entries(entries: DataFrame, kind: str | None = None, search: str = "") -> DataFrame:
    """Entries of a type whose content holds the text, in lower case."""
    if kind:
        entries = entries.filter(F.col("type") == kind)
    if text := search.strip().lower():
        entries = entries.filter(F.contains(F.lower("content"), F.lit(text)))
    return entries


def batch(rows: DataFrame, selection: DataFrame, visible: DataFrame, action: str) -> DataFrame:
    """The selection after an action on the visible rows: recommended, select_visible or clear_visible."""
    value: Column = {"recommended": F.col("default_selected"), "select_visible": F.lit(True), "clear_visible": F.lit(False)}[action]
    touched = rows.join(visible.select("book_key"), "book_key", "left_semi").select("book_key", value.alias("_set"))
    joined = selection.join(touched, "book_key", "full_outer")
    return joined.select("book_key", F.coalesce("_set", "selected").alias("selected"))


def toggle(selection: DataFrame, visible: DataFrame) -> DataFrame:
    """The header box: clears the visible rows if all of them are selected, else selects them."""
    shown = visible.select("book_key").join(selection, "book_key", "left")
    on = not shown.agg(F.bool_and(F.coalesce("selected", F.lit(False))).alias("all")).first()["all"]
    touched = visible.select("book_key", F.lit(on).alias("_set"))
    return selection.join(touched, "book_key", "full_outer").select("book_key", F.coalesce("_set", "selected").alias("selected"))


def summary(rows: DataFrame, selection: DataFrame, formats: int, only_new: bool = False) -> DataFrame:
    """(selected_books, selected_highlights, active_formats)."""
    counted = F.col("new_highlights_count" if only_new else "highlights")
    chosen = _selected(rows, selection).filter("_on")
    return chosen.agg(F.count(F.lit(1)).alias("selected_books"), F.coalesce(F.sum(counted), F.lit(0)).alias("selected_highlights")).withColumn("active_formats", F.lit(formats))


def export_totals(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """(books, entries): books asked for (wanted: book_key, each as often as asked), and entries of those that there are."""
    books = wanted.groupBy("book_key").agg(F.count(F.lit(1)).alias("asked"))
    sizes = entries.join(books.select("book_key"), "book_key", "left_semi").groupBy("book_key").agg(F.count(F.lit(1)).alias("entries"))
    totals = books.join(sizes, "book_key", "left").agg(F.coalesce(F.sum("asked"), F.lit(0)).alias("books"), F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"))
    return totals


def visible_counts(rows: DataFrame, visible: DataFrame, selection: DataFrame) -> DataFrame:
    """(books, visible, visible_selected, header): header is all, some or none of the visible rows."""
    shown = _selected(visible, selection).agg(F.count(F.lit(1)).alias("visible"), F.count_if("_on").alias("visible_selected"))
    # Two rows of one count each: a scalar beside a scalar.
    return shown.withColumn("books", F.lit(rows.count())).withColumn("header", _header(F.col("visible"), F.col("visible_selected")))


def counts_by_status(rows: DataFrame, selection: DataFrame) -> DataFrame:
    """visible_counts for each status, as if its rows alone were visible."""
    shown = _selected(rows, selection).groupBy("status").agg(F.count(F.lit(1)).alias("visible"), F.count_if("_on").alias("visible_selected"))
    names = rows.sparkSession.createDataFrame([(s,) for s in STATUS_ORDER], "status string")
    shown = names.join(shown, "status", "left").fillna(0)
    return shown.withColumns({"books": F.lit(rows.count()), "header": _header(F.col("visible"), F.col("visible_selected"))})


def _header(visible: Column, selected: Column) -> Column:
    return F.when((visible > 0) & (visible == selected), "all").when(selected > 0, "some").otherwise("none")


def mark_rows(rows: DataFrame, exported: DataFrame, formats: list[str], display: str) -> DataFrame:
    """The table as it will look once exported (a set of book keys) is exported."""
    joined = rows.join(exported.select("book_key").distinct().withColumn("_sent", F.lit(True)), "book_key", "left")
    becomes = {"status": F.lit("sem_novidades"), "status_label": F.lit("Exportado"), "new_highlights_count": F.lit(0).cast("long"), "last_export_display": F.lit(display), "last_export_formats": F.array(*[F.lit(f) for f in formats]).cast("array<string>")}
    sent = F.coalesce("_sent", F.lit(False))
    return joined.withColumns({c: F.when(sent, v).otherwise(F.col(c)) for c, v in becomes.items()}).drop("_sent")


def known_keys(requested: DataFrame, rows: DataFrame) -> DataFrame:
    """Requested keys (with any order column) that the analysis has; order and repeats stay."""
    return requested.join(rows.select("book_key"), "book_key", "left_semi")


def clean_search(text: Column) -> Column:
    return F.lower(strip(text))
