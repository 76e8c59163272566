"""Every query of the annotation engine by name. plans/oracles.py has the SQL that must give the same rows."""

from __future__ import annotations

import hashlib
import json
import tempfile
from collections.abc import Callable
from datetime import date
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolith.functions import dates, keys, similarity, text
from annolith.operators import dedup, pairs, parsing, render, search, selection, snapshots, status, text_joins
from annolith.plans import oracles
from annolith.session import scratch_folder
from annolith.settings import Settings
from annolith.sources import adapters, analyses, clippings, history, scan, sinks

#: The clock of rendered queries.
SETTINGS = Settings(today=date(2024, 1, 15))
ANALYSED, EXPORTED = "2024-01-10T09:00:00+00:00", "2024-01-12T00:40:00+00:00"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.of_conversations(_table(spark, sf_dir, "conversations"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.of_events(_table(spark, sf_dir, "events"))


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations' entries with their hashes, without content: written once where several snapshots are made of
    them, so that texts cross to Python once."""
    path = scratch_folder(spark, "hashed")
    snapshots.with_hashes(_talks(spark, sf_dir)).drop("content").write.parquet(path)
    return spark.read.parquet(path)


def _turn() -> F.Column:
    return F.col("start_pos") / 10


def _history(rows: DataFrame) -> DataFrame:
    """A history of the conversations: those of two turns or more were analysed after their second turn, those of three
    or more exported after their fourth."""
    turns = rows.groupBy("book_key").agg(F.count(F.lit(1)).alias("turns"))
    known = rows.join(turns, "book_key")
    then = snapshots.snapshots(known.filter((F.col("turns") >= 2) & (_turn() < 2)))
    sent = snapshots.snapshots(known.filter((F.col("turns") >= 3) & (_turn() < 4)))
    sent = sent.select("book_key", F.col("content_hash").alias("last_export_signature"), F.col("highlight_hashes").alias("last_export_highlight_hashes"), F.col("entry_hashes").alias("last_export_entry_hashes"), F.lit(EXPORTED).alias("last_export_at"), F.array(F.lit("markdown"), F.lit("txt")).alias("last_export_formats"))
    return then.withColumn("last_analysis_at", F.lit(ANALYSED)).join(sent, "book_key", "left").drop("analysis_id", "first_seq")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hashed(spark, sf_dir)
    return status.books_table(snapshots.snapshots(rows), _history(rows))


def book_snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshots(_talks(spark, sf_dir)).select("book_key", "title", "author", "highlight_count", "note_count", "bookmark_count")


def book_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of every source and language, and of every part's name and brand."""
    docs = _table(spark, sf_dir, "documents").select(F.col("source").alias("title"), F.col("lang").alias("author")).distinct()
    parts = _table(spark, sf_dir, "part").select(F.col("p_name").alias("title"), F.col("p_brand").alias("author")).distinct()
    return docs.unionByName(parts).withColumn("book_key", keys.book_key(F.col("title"), F.col("author")))


def entry_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.with_hashes(_talks(spark, sf_dir)).select("book_key", "seq", "entry_hash", "highlight_hash")


def snapshot_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshots(_talks(spark, sf_dir)).select("book_key", "content_hash", "highlight_hash", F.array_join("entry_hashes", ",").alias("entry_list"), F.size("highlight_hashes").alias("n_highlight_hashes"))


def entry_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Served entries with their place in the book."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("book_key").orderBy(*render.sort_key()))
    rows = _events(spark, sf_dir).withColumn("place", place)
    return rows.select("book_key", "place", "type", "page", "start_pos", "end_pos", "content", "date_formatted")


def status_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return rows.select("book_key", status.priority(F.col("status")).alias("priority"), F.lower("title").alias("sort_title"), F.lower("author").alias("sort_author"))


def status_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("book_key", "status", "status_label", "new_highlights_count", "has_new_highlights", "has_changes_since_export", "default_selected", "was_processed_before", "was_exported_before", "last_analysis_display", "last_export_display")


def books_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return rows.withColumn("last_export_formats", F.array_join("last_export_formats", ",")).drop("analysis_id", "first_seq")


def detected_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = _hashed(spark, sf_dir)
    rows = status.detect(snapshots.snapshots(hashed), _history(hashed))
    return rows.select("book_key", "detected_status", "detected_new")


def new_entries_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = _hashed(spark, sf_dir)
    return status.fresh_entries(hashed, _history(hashed)).select("book_key", "seq", "entry_hash")


def known_keys_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations asked for by number, ten beyond those that there are, in the order asked."""
    ids = _table(spark, sf_dir, "conversations").select("conv_id").distinct()
    asked = ids.select(F.col("conv_id").alias("asked")).unionByName(ids.select((F.col("conv_id") + 10).alias("asked")))
    title = F.concat(F.lit("Conversation "), F.col("asked").cast("string"))
    asked = asked.withColumn("book_key", keys.book_key(title, F.lit("corpus")))
    return selection.known_keys(asked, snapshots.snapshots(_talks(spark, sf_dir)))


def range_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairs.overlapping(_events(spark, sf_dir).withColumn("type", F.lit("highlight")))
    a, b = similarity.Side("new"), similarity.Side("old")
    return found.select("old_seq", "new_seq", similarity.overlap_units(a, b).alias("units"), F.round(similarity.overlap_ratio(a, b), 6).alias("share"), F.round(similarity.material_overlap(a, b, 0.6, 15), 6).alias("material"), similarity.same_range(a, b).alias("same_range"))


def same_session_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.in_session(_events(spark, sf_dir), 15).select("old_seq", "new_seq")


def _text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _talks(spark, sf_dir).withColumn("text", text.comparison_text(F.col("content")))
    return pairs.within_books(rows, {"text": F.col("text")})


def token_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("new_text"), F.col("old_text")
    return _text_pairs(spark, sf_dir).select("old_seq", "new_seq", F.round(similarity.token_overlap(a, b), 6).alias("new_in_old"), F.round(similarity.token_overlap_both(a, b), 6).alias("both_ways"))


def containment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("new_text"), F.col("old_text")
    return _text_pairs(spark, sf_dir).select("old_seq", "new_seq", similarity.contains(a, b).alias("contains"), similarity.contains_nearby(a, b).alias("nearby"))


def character_ratio_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_pairs(spark, sf_dir).select("old_seq", "new_seq", F.round(similarity.character_ratio("new_content", "old_content"), 6).alias("ratio"))


def _comparison_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison texts of documents, a book for each source and language."""
    rows = adapters.of_documents(_table(spark, sf_dir, "documents"))
    return rows.select("analysis_id", "book_key", "type", "seq", text.comparison_text(F.col("content")).alias("text"))


def _document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, crossed to Python once."""
    path = scratch_folder(spark, "texts")
    _comparison_texts(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def word_set_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source and language that share three quarters of their words both ways."""
    return text_joins.alike_word_sets(_document_texts(spark, sf_dir), SETTINGS.token_overlap_threshold).pairs.drop("analysis_id", "type").withColumn("both_ways", F.round("both_ways", 9))


def word_set_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_joins.alike_word_sets(_document_texts(spark, sf_dir), SETTINGS.token_overlap_threshold).members.select("book_key", "seq", "class_seq")


def contained_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text another of the source and language holds."""
    return text_joins.containing_texts(_comparison_texts(spark, sf_dir)).pairs.drop("analysis_id", "type")


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source and language that read alike."""
    rows = adapters.of_documents(_table(spark, sf_dir, "documents")).withColumn("text", text.comparison_text(F.col("content")))
    groups = rows.groupBy("book_key", F.sha1("text").alias("text_hash")).agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("copies"))
    return groups.filter("copies > 1")


def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison and key forms of every conversation turn."""
    rows = _talks(spark, sf_dir)
    return rows.select("seq", text.comparison_text(F.col("content")).alias("comparison"), text.key_text(F.col("content")).alias("key"))


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part").select(F.concat_ws(": ", "p_brand", "p_name").alias("name")).distinct()
    return parts.withColumn("slug", text.slug_text(F.col("name")))


def author_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = adapters.of_documents(_table(spark, sf_dir, "documents"))
    return snapshots.authors(docs)


def filter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    kept = selection.filter_rows(rows, selection.default_selection(rows), search=" Conversation 1", author="corpus", status="selecionados")
    return kept.select("book_key", "title", "status")


def batch_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recommended selection, with the books that have news cleared."""
    rows = _rows(spark, sf_dir)
    chosen = selection.default_selection(rows)
    return selection.batch(rows, chosen, rows.filter("status = 'com_novidades'"), "clear_visible")


def selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return selection.summary(rows, selection.default_selection(rows), len(SETTINGS.enabled()), only_new=True)


def mark_rows_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    marked = selection.mark_rows(rows, rows.filter("default_selected"), ["markdown"], "2024-01-15 10:00")
    return marked.select("book_key", "status", "status_label", "new_highlights_count", "last_export_display", F.array_join("last_export_formats", ",").alias("formats"))


def entry_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.search_entries(_talks(spark, sf_dir), "note", "tion").select("book_key", "seq")


def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a text, by an index of all of them."""
    index = search.SearchIndex(spark, scratch_folder(spark, "search"))
    index.build(adapters.of_documents(_table(spark, sf_dir, "documents")).select("book_key", "type", "seq", "content"))
    return index.search("License", "highlight").select("book_key", "seq")


def history_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 200 events of each user."""
    rows = _table(spark, sf_dir, "events")
    return history.tail(rows, [F.col("ts").desc(), F.col("event_id").desc()], ["user_id"]).select("user_id", "event_id")


def latest_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five uploads most recently saved, where a customer's orders are saves of one upload."""
    saves = _table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("analysis_id"), F.col("o_orderkey").alias("saved_no"), F.col("o_orderstatus").alias("filename"))
    return analyses.retained(saves)


def format_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _talks(spark, sf_dir).unionByName(_events(spark, sf_dir))
    return rows.select("seq", "type", render.location(" | ").alias("location"))


def display_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", dates.to_iso(F.col("ts")).alias("iso"))
    return rows.withColumn("shown", dates.display(F.col("iso")))


def date_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's date as a label, read back from a metadata line."""
    rows = _table(spark, sf_dir, "events").select("event_id", dates.date_label(F.col("ts")).alias("label"))
    line = text.matching_text(F.concat(F.lit("- Seu destaque | Adicionado: sexta-feira, "), "label", F.lit(" 10:00:00")))
    day, month, year = parsing.date_parts(F.col("line"))
    return rows.withColumn("line", line).select("event_id", "label", F.make_date(year, month, day).cast("string").alias("day"))


def parse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as clippings files, then cut and parsed."""
    files = adapters.clippings_text(_talks(spark, sf_dir))
    parsed = parsing.entries(parsing.parse(clippings.segments(files)))
    return parsed.select("book_key", "seq", "type", "title", "author", "page", "start_pos", "end_pos", "content")


def split_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by hundreds as clippings files, each read by as many tasks as it has ranges; with the files' SHA-1."""
    path = scratch_folder(spark, "hundreds")
    rows = _talks(spark, sf_dir).withColumn("hundred", F.floor(F.col("seq") / 100_000_000))
    files = adapters.clippings_text(rows.withColumn("book_key", F.col("hundred")))
    body = F.regexp_replace("text", "\\n\\z", "")  # the writer ends lines
    files.select(F.col("analysis_id").alias("hundred"), body.alias("text")).repartition("hundred").write.partitionBy("hundred").text(path)
    hundred = F.regexp_extract("path", r"hundred=(\d+)", 1).cast("bigint").alias("hundred")
    found = scan.Scan(spark, path).segments().select("path", hundred, "seq", F.sha1("raw").alias("raw_sha1"))
    return found.join(scan.digests(spark, path), "path").drop("path")


def render_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.plain_text(_talks(spark, sf_dir), SETTINGS, True).select("book_key", "content")


def render_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.markdown(_talks(spark, sf_dir), SETTINGS).select("book_key", "content")


def render_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.web_page(_talks(spark, sf_dir), SETTINGS).select("book_key", "content")


def vault_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.vault_note(_talks(spark, sf_dir), SETTINGS).select("book_key", "content")


def clip_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.clip_page(_talks(spark, sf_dir), SETTINGS).select("book_key", "content")


def note_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = render.note_blocks(_talks(spark, sf_dir), SETTINGS).select("book_key", F.posexplode("blocks").alias("place", "b"))
    return rows.select("book_key", "place", "b.kind", "b.type", "b.title", "b.text", "b.location")


def export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of what is new since the last export."""
    hashed = snapshots.with_hashes(_talks(spark, sf_dir))
    fresh = status.fresh_entries(hashed, _history(_hashed(spark, sf_dir)))
    settings = SETTINGS.merged({"formats": {"html": {"enabled": False}}})
    made = render.unique_files(render.files(fresh, settings))
    return made.select("format", "path", "book_key", F.length("content").alias("n_chars"))


def encoded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.encoded(render.files(_talks(spark, sf_dir), SETTINGS))


def mark_exported_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hashed(spark, sf_dir)
    events = history.export_events(snapshots.snapshots(rows), _history(rows), ["txt", " markdown ", "txt"], "2024-01-15T13:00:00+00:00")
    return events.select("book_key", "export_id", "exported_at", F.array_join("formats", ",").alias("formats"), "content_hash", "processed_at", "reexport_without_changes")


def processing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hashed(spark, sf_dir)
    events = history.processing_events(snapshots.snapshots(rows), _history(rows), "2024-01-15T12:00:00+00:00", False, 1, 7)
    return events.select("book_key", "process_id", "detected_status", "new_highlights_count", "content_hash", "highlight_count")


def history_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history as the JSON document of older versions, read back."""
    state = _history(_hashed(spark, sf_dir))
    old = F.struct("title", F.lit(None).cast("string").alias("author"), F.col("entry_hashes").alias("entry_signatures"), F.col("highlight_hashes").alias("highlight_signature_hashes"), F.col("highlight_count").cast("string").alias("highlight_count"), F.col("last_analysis_at").alias("last_processed_at"), F.col("last_export_at").alias("last_exported_at"), F.struct(F.col("last_export_signature").alias("content_signature_hash")).alias("last_export"))
    documents = state.select(F.to_json(F.struct(F.create_map("book_key", old).alias("books"))).alias("value"))
    rows = history.sanitise(documents)
    return rows.select("book_key", "title", "author", F.array_join("entry_hashes", ",").alias("entries"), "content_hash", "highlight_hash", "highlight_count", "note_count", "last_analysis_at", "last_export_at", "last_export_signature")


def parse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as clippings with page numbers, in one file for each book, read back as uploads are."""
    rows = _talks(spark, sf_dir).withColumn("page", (_turn() + 1).cast("bigint"))
    parsed = parsing.entries(parsing.parse(clippings.segments(adapters.clippings_text(rows))))
    return parsed.select("book_key", "seq", "page", "start_pos", "end_pos")


def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clipping on the 31st of each event's month for each event of a user: errors where the month has no such day."""
    line = F.concat(F.lit("- Sua nota | posição "), F.col("event_id").cast("string"), F.lit(" | Adicionado: 31 de "), dates.month_name(F.month("ts")), F.lit(" de "), F.year("ts").cast("string"))
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("analysis_id"), F.col("event_id").alias("seq"), F.concat(F.lit("T (A)\n"), line, F.lit("\n\nx")).alias("raw"))
    return parsing.parse(rows).groupBy("analysis_id").agg(F.count_if("is_error").alias("errors"), F.count_if(~F.col("is_error")).alias("entries"))


def repaired_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose UTF-8 was read as Latin-1, repaired."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    misread = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return rows.select("doc_id", F.sha1(text.repaired_text(misread)).alias("repaired"), F.sha1(text.repaired_text(F.col("text"))).alias("left_alone"))


def position_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event of a user against the one before it; some without type, some without a place."""
    from pyspark.sql import Window

    rows = _table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("type"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 4).alias("start"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 4 + 2).alias("end"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("content"), F.col("ts").cast("timestamp_ntz").alias("date"))
    before = Window.partitionBy("user_id").orderBy("seq")
    fields = ("seq", "type", "start", "end", "text", "content", "date")
    both = rows.select(*[F.col(c).alias(f"new_{c}") for c in fields], *[F.lag(c).over(before).alias(f"old_{c}") for c in fields]).filter("old_seq is not null")
    a, b = similarity.Side("new"), similarity.Side("old")
    return both.select("new_seq", similarity.same_type(a, b).alias("same_type"), similarity.same_start(a, b).alias("same_start"), similarity.same_range(a, b).alias("same_range"), similarity.missing_position(a, b).alias("unplaced"), similarity.overlap_units(a, b).alias("units"), F.round(similarity.overlap_ratio(a, b), 6).alias("share"))


def settings_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers' requests become: enabled formats, flags, thresholds; also after a nested override and a round trip."""
    key = F.col("c_custkey")
    asked = {"exportMarkdown": key % 3 != 0, "exportHtml": key % 2 == 0, "exportTxt": F.col("c_nationkey") % 2 == 1, "exportObsidian": F.when(key % 7 == 0, True), "removeDuplicates": key % 5 != 0, "includeMetadata": F.when(key % 4 == 0, False), "similarityThreshold": F.when(key % 2 == 1, 0.5 + (key % 4) / 8), "dedupSessionWindowMinutes": F.when(key % 3 == 1, key % 30), "unknown": key}
    rows = _table(spark, sf_dir, "customer").select(key.alias("request"), F.to_json(F.struct(*(c.alias(n) for n, c in asked.items()))).alias("payload"))

    @F.pandas_udf("formats string, remove_duplicates boolean, metadata boolean, similarity double, session double, with_txt string, bookmarks boolean, same_when_stored boolean")
    def forms(payloads: pd.Series) -> pd.DataFrame:
        out = []
        for payload in payloads:
            made = Settings.of_request(json.loads(payload), SETTINGS.today)
            override = made.merged({"include_bookmarks": False, "formats": {"txt": {"enabled": True}}})
            stored = Settings.of_stored(json.dumps(made.as_request())).with_changes(today=SETTINGS.today)
            out.append((",".join(made.format_labels()), made.remove_duplicates, made.formats[0].include_metadata, made.similarity_threshold, float(made.session_window_minutes), ",".join(override.format_labels()), override.include_bookmarks, stored == made))
        return pd.DataFrame(out)

    return rows.select("request", forms("payload").alias("f")).select("request", "f.*")


def local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The application's day of each event."""
    return _table(spark, sf_dir, "events").select("event_id", dates.local_day(F.col("ts")).cast("string").alias("day"))


def export_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books and entries of an export of what is selected, and of ten books that there are not."""
    chosen = selection.default_selection(_rows(spark, sf_dir)).filter("selected").select("book_key")
    missing = spark.range(10).select(F.concat(F.lit("none"), F.col("id").cast("string")).alias("book_key"))
    return selection.export_totals(_talks(spark, sf_dir), chosen.unionByName(missing))


def visible_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics strip for each status, as if its books alone were visible."""
    rows = _rows(spark, sf_dir)
    return selection.counts_by_status(rows, selection.default_selection(rows))


def zip_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ZIP archive of all books holds, read back from its bytes, with its order."""
    return sinks.zip_listing(sinks.zip_pieces(render.files(_talks(spark, sf_dir), SETTINGS)))


def folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written into a folder, read back from it."""
    with tempfile.TemporaryDirectory() as folder:  # the driver's own, as the sink's
        failed = sinks.write_folder(render.files(_talks(spark, sf_dir), SETTINGS), folder)
        rows = [(str(p.relative_to(folder)), hashlib.sha1(p.read_bytes()).hexdigest(), failed) for p in sorted(Path(folder).glob("*/*"))]
    return spark.createDataFrame(rows, "path string, sha1 string, failed int")


def history_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history written as events, analysis and export and analysis again, and read back as the books' current state."""
    store = history.History(spark, scratch_folder(spark, "history"))
    rows = _talks(spark, sf_dir)
    books = snapshots.snapshots(rows.filter(_turn() < 2))
    store.record_analysis(books, ANALYSED)
    keys_ = rows.filter(_turn() == 2).select("book_key")
    store.mark_exported(keys_, ["txt", "markdown"], EXPORTED)
    store.record_analysis(snapshots.snapshots(rows), "2024-01-15T12:00:00+00:00", forced=True)
    events = store.processing().groupBy("book_key").agg(F.count(F.lit(1)).alias("events"), F.max_by("detected_status", "event_no").alias("detected_status"), F.max_by("forced", "event_no").alias("forced"))
    state = store.books().select("book_key", "title", "content_hash", "highlight_count", "last_analysis_at", "last_export_at", "last_export_signature", F.array_join("last_export_formats", ",").alias("formats"))
    return state.join(events, "book_key")


def stored_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as uploads, stored, and their index rejoined with their bytes."""
    store = analyses.Analyses(spark, scratch_folder(spark, "analyses"), most=1 << 30)
    files = adapters.clippings_text(_talks(spark, sf_dir))
    content = F.encode("text", "UTF-8")
    uploads = files.select("analysis_id", F.concat(F.lit("folder/"), "analysis_id", F.lit(".txt")).alias("path"), F.length(content).cast("bigint").alias("size"), content.alias("content"))
    store.save(uploads, ANALYSED, json.dumps(SETTINGS.as_request()))
    return store.uploads().select("analysis_id", "path", "size", F.sha1("text").alias("text_sha1"), F.get_json_object("config", "$.exportMarkdown").alias("markdown"))


def _decided(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows, dedup.decide(rows, SETTINGS)


def dedup_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, decisions = _decided(adapters.of_documents(_table(spark, sf_dir, "documents")))
    return dedup.survivors(rows, decisions).select("book_key", "type", "seq", "slot_seq")


def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(_events(spark, sf_dir))[1].drop("analysis_id")


def _crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as long ranges of one type, so that a user's ranges form long islands; every fourth has no date."""
    rows = _events(spark, sf_dir).withColumns({"type": F.lit("highlight"), "end_pos": F.col("start_pos") + 300})
    return rows.withColumn("date_obj", F.when(F.col("seq") % 4 != 0, F.col("date_obj")))


def dedup_crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(_crowded(spark, sf_dir))[1].drop("analysis_id")


def dedup_crowded_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, decisions = _decided(_crowded(spark, sf_dir))
    return dedup.survivors(rows, decisions).select("book_key", "type", "seq", "slot_seq")


def dedup_crowded_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.report(*_decided(_crowded(spark, sf_dir))).drop("analysis_id")


def dedup_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.metrics(_decided(_crowded(spark, sf_dir))[1])


def dedup_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rung of the ladder on every turn: books of two entries, a turn's text and what a reader's later clipping made
    of it. Variants 6 to 9 have no place."""
    turns = _table(spark, sf_dir, "conversations").filter(F.length("text").between(40, 180))
    rows = turns.select("conv_id", "turn", F.col("text").alias("t"), (F.length("text") / 2).cast("int").alias("half"), F.explode(F.sequence(F.lit(0), F.lit(10))).alias("variant"))
    t, half, start = F.col("t"), F.col("half"), F.col("turn") * 100
    words = F.split("t", " ")
    old = [start, start + 9, t]
    none = F.lit(None).cast("bigint")
    front, back = F.substring(t, 1, half), F.substring(t, half + 1, F.lit(200))
    grown = F.concat(front, F.lit(" zzqy "), back)
    new = [
        (start + 9, start, F.concat(t, F.lit("!"))),  # read backwards
        (start, start + 4, front),
        (start, start + 9, back),
        (start + 4, start + 13, t),
        (start, start - 9, grown),  # away from the same start
        (start + 4, start + 13, F.array_join(F.reverse(words), " ")),  # the same words in another order
        (none, none, front),
        (none, none, F.concat(front, F.lit("§"), F.substring(t, half + 2, F.lit(200)))),  # another character in the middle
        (none, none, F.lit("...")),
        (none, none, F.lit("§§")),
        (start + 10, start + 19, t),
    ]
    place = lambda at: F.element_at(F.array(*(n[at] for n in new)), F.col("variant") + 1)
    first = F.struct(F.lit(0).alias("k"), F.when(F.col("variant").isin(6, 7, 9), none).otherwise(old[0]).alias("s"), F.when(F.col("variant").isin(6, 7, 9), none).otherwise(old[1]).alias("e"), F.when(F.col("variant") == 8, "").otherwise(old[2]).alias("c"))
    second = F.struct(F.lit(1).alias("k"), place(0).alias("s"), place(1).alias("e"), place(2).alias("c"))
    made = rows.select("conv_id", "turn", "variant", F.inline(F.array(first, second)))
    entries = adapters.pairs_of_versions(made)
    return dedup.decide(entries, SETTINGS).select("book_key", "seq", "action", "reason", "priority", F.round("score", 9).alias("score"), "matched_slot")


def dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.report(*_decided(adapters.of_documents(_table(spark, sf_dir, "documents"))))


ALL: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    book_snapshot_counts, book_keys, entry_signatures, snapshot_hashes, entry_sort, status_sort, status_classify, books_table, detected_status,
    new_entries_anti, known_keys_semi, range_overlap_pairs, same_session_pairs, token_overlap_pairs, containment_pairs, character_ratio_pairs,
    word_set_pairs, word_set_classes, contained_documents, exact_duplicates, normal_forms, slugs, author_options, filter_rows, batch_selection, selection_summary, mark_rows_exported, entry_search, indexed_search,
    history_tail, latest_analyses, format_location, display_time, date_labels, parse_roundtrip, render_txt, render_markdown, render_html,
    vault_note, clip_page, note_blocks, export_files, encoded_files, mark_exported_events, processing_events, history_import,
    dedup_survivors, dedup_events, dedup_crowded, dedup_crowded_survivors, dedup_crowded_report, dedup_metrics, dedup_report, dedup_rungs,
    split_scan, parse_pages, parse_errors, repaired_texts, position_predicates, settings_forms, local_days, export_totals, visible_counts, zip_listing, folder_files,
    history_books, stored_uploads,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in ALL}


def oracle_sql() -> dict[str, str]:
    """Only character ratios, and folds of texts without positions that ask for them, are not SQL."""
    return oracles.all_sql()
