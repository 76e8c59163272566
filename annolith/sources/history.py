"""The processing and export history: two append-only event tables; a book's current state is derived from them.

A batch of events gets the next number and is appended whole (sources.log), by any number of writers. Readers get the
last HISTORY_KEPT events of each book; older ones are removed when batches are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from annolith.functions.keys import clean_hashes, clean_strings, hash_text, set_hash
from annolith.operators.status import detect
from annolith.settings import HISTORY_KEPT, UNKNOWN_AUTHOR
from annolith.sources.log import BatchLog

STATE = "book_key string, title string, author string, entry_hashes array<string>, highlight_hashes array<string>, content_hash string, highlight_hash string, highlight_count bigint, note_count bigint, bookmark_count bigint"
PROCESSING = f"{STATE}, event_no bigint, process_id string, processed_at string, forced boolean, detected_status string, new_highlights_count bigint"
EXPORT = "book_key string, event_no bigint, export_id string, exported_at string, formats array<string>, content_hash string, highlight_hash string, highlight_hashes array<string>, entry_hashes array<string>, processed_at string, reexport_without_changes boolean"
CURRENT = f"{STATE}, last_analysis_at string, last_export_at string, last_export_formats array<string>, last_export_signature string, last_export_highlight_hashes array<string>, last_export_entry_hashes array<string>"


def _names(ddl: str) -> list[str]:
    return [f.name for f in StructType.fromDDL(ddl)]


def latest(events: DataFrame) -> DataFrame:
    """Each book's last event; partial aggregation, no sort of its history."""
    rest = [c for c in events.columns if c not in ("book_key", "event_no")]
    last = events.groupBy("book_key").agg(F.max_by(F.struct(*rest), "event_no").alias("_e"))
    return last.select("book_key", "_e.*")


def tail(events: DataFrame, order: list[Column], keys: list[str] | None = None, most: int = HISTORY_KEPT) -> DataFrame:
    """The last `most` events of each book (or other keys), as kept in its history."""
    place = Window.partitionBy(*(keys or ["book_key"])).orderBy(*order)
    return events.withColumn("_r", F.row_number().over(place)).filter(F.col("_r") <= most).drop("_r")


def current(processing: DataFrame, exports: DataFrame) -> DataFrame:
    """One row per analysed book: its last analysed state and its last export."""
    state = latest(processing).select(*_names(STATE), F.col("processed_at").alias("last_analysis_at"))
    sent = latest(exports).select(
        "book_key",
        F.col("exported_at").alias("last_export_at"),
        F.col("formats").alias("last_export_formats"),
        F.col("content_hash").alias("last_export_signature"),
        F.col("highlight_hashes").alias("last_export_highlight_hashes"),
        F.col("entry_hashes").alias("last_export_entry_hashes"),
    )
    return state.join(sent, "book_key", "left")


def processing_events(snapshots: DataFrame, state: DataFrame, processed_at: str, forced: bool, event_no: int, count: int) -> DataFrame:
    """Events of one analysis. count: its number of books, part of the id."""
    rows = detect(snapshots, state)
    added = {"event_no": F.lit(event_no).cast("bigint"), "process_id": hash_text(F.lit(f"{processed_at}|{count}")), "processed_at": F.lit(processed_at), "forced": F.lit(forced), "new_highlights_count": F.col("detected_new")}
    return rows.withColumns(added).select(*_names(PROCESSING))


def export_events(keys: DataFrame, state: DataFrame, formats: list[str] | Column, exported_at: str, event_no: int = 0) -> DataFrame:
    """Events of one export: those of keys (book_key) that the history knows, with the hashes of their state."""
    labels = formats if isinstance(formats, Column) else F.array(*[F.lit(f) for f in formats]).cast("array<string>")
    rows = state.join(keys.select("book_key").distinct(), "book_key", "left_semi").withColumn("formats", clean_strings(labels))
    again = F.coalesce(F.col("last_export_at").isNotNull() & (F.col("last_export_signature") == F.col("content_hash")), F.lit(False))
    identity = F.concat_ws("|", "book_key", F.lit(exported_at), F.array_join("formats", ","), F.coalesce("content_hash", F.lit("None")))
    added = {"event_no": F.lit(event_no).cast("bigint"), "export_id": hash_text(identity), "exported_at": F.lit(exported_at), "processed_at": F.col("last_analysis_at"), "reexport_without_changes": again}
    return rows.withColumns(added).select(*_names(EXPORT))


#: Numbers that one batch may give to events of a book, and batches that are merged into one.
SPAN, MERGED = 1000, 64


class History:
    """The event tables at a path."""

    def __init__(self, spark: SparkSession, path: str, most: int = HISTORY_KEPT):
        self.spark, self.path, self.most = spark, path.rstrip("/"), most
        self._processing = BatchLog(spark, f"{self.path}/processing_events", PROCESSING)
        self._exports = BatchLog(spark, f"{self.path}/export_events", EXPORT)

    def _kept(self, events: DataFrame) -> DataFrame:
        last = Window.partitionBy("book_key").orderBy(F.desc("event_no"))
        return events.withColumn("_r", F.dense_rank().over(last)).filter(F.col("_r") <= self.most).drop("_r")

    def processing(self) -> DataFrame:
        return self._kept(self._processing.read())

    def exports(self) -> DataFrame:
        return self._kept(self._exports.read())

    def books(self) -> DataFrame:
        return current(self._processing.read(), self._exports.read())

    def _add(self, log: BatchLog, events: DataFrame, number: int) -> None:
        log.append(events, number)
        if len(log.names()) > MERGED:
            log.compact(lambda rows: self._kept(rows).coalesce(8))

    def record_analysis(self, snapshots: DataFrame, processed_at: str, forced: bool = False) -> None:
        """Append what an analysis found; snapshots: one analysis, with count of its books taken here."""
        with self._processing.lock:
            number = self._processing.claim()
            self._add(self._processing, processing_events(snapshots, self.books(), processed_at, forced, number * SPAN, snapshots.count()), number)

    def mark_exported(self, keys: DataFrame, formats: list[str], exported_at: str, exported: DataFrame | None = None) -> None:
        """Append an export of keys. By default the store's latest hashes are recorded, also for books that the export
        left out; with exported (snapshots of exactly what was exported) those and their hashes are."""
        with self._exports.lock:
            state = self.books()
            if exported is not None:
                mine = ["entry_hashes", "highlight_hashes", "content_hash", "highlight_hash"]
                state = state.drop(*mine).join(exported.select("book_key", *mine), "book_key")
            number = self._exports.claim()
            self._add(self._exports, export_events(keys, state, formats, exported_at, number * SPAN), number)

    def import_document(self, path: str) -> None:
        """Take over a history that was one JSON document, with its events."""
        documents = self.spark.read.text(path, wholetext=True)
        done, sent = imported_events(documents, self.most)
        for log, events in ((self._processing, done), (self._exports, sent)):
            with log.lock:
                number = log.claim()
                self._add(log, events.withColumn("event_no", F.lit(number * SPAN) + F.col("event_no")), number)


# -- the JSON document of older versions --------------------------------------------------------------------------

_EVENT = (
    "struct<process_id:string,processed_at:string,forced:boolean,detected_status:string,new_highlights_count:bigint,export_id:string,exported_at:string,formats:array<string>,"
    "content_signature_hash:string,highlight_signature_hash:string,highlight_signature_hashes:array<string>,entry_signature_hashes:array<string>,"
    "highlight_count:bigint,note_count:bigint,bookmark_count:bigint,reexport_without_changes:boolean>"
)
# Events and books are taken as text first: one of another shape is then empty and spoils nothing beside it.
_BOOK = (
    "struct<title:string,author:string,entry_signature_hashes:array<string>,entry_signatures:array<string>,highlight_signature_hashes:array<string>,highlight_signatures:array<string>,"
    "content_signature_hash:string,highlight_signature_hash:string,highlight_count:string,note_count:string,bookmark_count:string,last_analysis_at:string,last_processed_at:string,"
    "last_export_at:string,last_exported_at:string,last_export_formats:array<string>,last_export_signature:string,last_export_highlight_signature_hashes:array<string>,"
    "last_export_entry_signature_hashes:array<string>,last_export:string,last_detected_processing:string,processing_history:string,export_history:string>"
)


def _event(text: Column) -> Column:
    return F.when(text.startswith("{"), F.from_json(text, _EVENT))


def _events(text: Column, most: int) -> Column:
    """The last events of a list, those that are objects; of anything but a list none."""
    objects = F.filter(F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>")), lambda e: e.startswith("{"))
    kept = F.slice(objects, F.greatest(F.size(objects) - most + 1, F.lit(1)), F.lit(most))
    return F.transform(kept, _event)


def _first(*values: Column) -> Column:
    """The first that is there and not empty, as text."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def _first_list(*values: Column) -> Column:
    return F.coalesce(*[F.when(F.size(v) > 0, v) for v in values])


def _documents(documents: DataFrame, most: int = HISTORY_KEPT) -> DataFrame:
    """(book_key, b, done, sent, detected, x) of JSON documents (column value): books, their events, the last of each kind.
    Text that is not a JSON object gives no rows; a book that is none has defaults only."""
    parsed = documents.filter(F.col("value").startswith("{")).select(F.from_json("value", "struct<books:map<string,string>>").alias("d"))
    rows = parsed.select(F.explode("d.books").alias("book_key", "raw")).select("book_key", F.from_json("raw", _BOOK).alias("b"))
    rows = rows.withColumns({"done": _events(F.col("b.processing_history"), most), "sent": _events(F.col("b.export_history"), most)})
    last = lambda name, events: F.coalesce(_event(F.col(f"b.{name}")), F.try_element_at(F.col(events), F.lit(-1)))
    return rows.withColumns({"detected": last("last_detected_processing", "done"), "x": last("last_export", "sent")})


def sanitise(documents: DataFrame) -> DataFrame:
    """CURRENT rows of JSON documents: names of older versions are read, what is missing gets defaults."""
    return _sanitised(_documents(documents))


def _sanitised(rows: DataFrame, *more: str) -> DataFrame:
    b = lambda name: F.col(f"b.{name}")
    entry = clean_hashes(_first_list(b("entry_signature_hashes"), b("entry_signatures")))
    high = clean_hashes(_first_list(b("highlight_signature_hashes"), b("highlight_signatures")))
    number = lambda name: F.coalesce(b(name).try_cast("bigint"), F.lit(0).cast("bigint"))
    return rows.select(
        "book_key",
        F.coalesce(b("title"), F.lit("")).alias("title"),
        F.coalesce(_first(b("author")), F.lit(UNKNOWN_AUTHOR)).alias("author"),
        entry.alias("entry_hashes"),
        high.alias("highlight_hashes"),
        F.coalesce(_first(b("content_signature_hash")), set_hash(entry)).alias("content_hash"),
        F.coalesce(_first(b("highlight_signature_hash")), set_hash(high)).alias("highlight_hash"),
        *[number(n).alias(n) for n in ("highlight_count", "note_count", "bookmark_count")],
        _first(b("last_analysis_at"), b("last_processed_at")).alias("last_analysis_at"),
        _first(b("last_export_at"), b("last_exported_at")).alias("last_export_at"),
        clean_strings(b("last_export_formats")).alias("last_export_formats"),
        _first(b("last_export_signature"), F.col("x.content_signature_hash")).alias("last_export_signature"),
        clean_hashes(_first_list(b("last_export_highlight_signature_hashes"), F.col("x.highlight_signature_hashes"))).alias("last_export_highlight_hashes"),
        clean_hashes(_first_list(b("last_export_entry_signature_hashes"), F.col("x.entry_signature_hashes"))).alias("last_export_entry_hashes"),
        *more,
    )


def imported_events(documents: DataFrame, most: int = HISTORY_KEPT) -> tuple[DataFrame, DataFrame]:
    """(PROCESSING, EXPORT) rows of JSON documents; event_no is the place in the book's list. The last event of each kind
    carries the book's state, also where its list is missing; earlier ones have what was kept of them."""
    books = _sanitised(_documents(documents, most), "done", "sent", "detected", "x")
    none = lambda kind: F.lit(None).cast(kind)
    seen = books.filter("last_analysis_at is not null or size(done) > 0 or size(entry_hashes) > 0")
    # The last of the list is the one that was detected last; without a list that one stands alone.
    lists = F.when(F.size("done") > 0, F.col("done")).otherwise(F.array("detected"))
    done = seen.withColumn("n", F.size(lists)).select("*", F.posexplode(lists).alias("at", "e")).withColumn("last", F.col("at") == F.col("n") - 1)
    state = ("entry_hashes", "highlight_hashes")
    done = done.select(
        "book_key", "title", "author",
        *[F.when(F.col("last"), F.col(c)).alias(c) for c in state],
        F.when(F.col("last"), F.col("content_hash")).otherwise(F.col("e.content_signature_hash")).alias("content_hash"),
        F.when(F.col("last"), F.col("highlight_hash")).otherwise(F.col("e.highlight_signature_hash")).alias("highlight_hash"),
        *[F.when(F.col("last"), F.col(c)).otherwise(F.col(f"e.{c}")).alias(c) for c in ("highlight_count", "note_count", "bookmark_count")],
        F.col("at").cast("bigint").alias("event_no"),
        F.col("e.process_id").alias("process_id"),
        F.when(F.col("last"), F.coalesce("last_analysis_at", "e.processed_at")).otherwise(F.col("e.processed_at")).alias("processed_at"),
        F.coalesce("e.forced", F.lit(False)).alias("forced"),
        F.col("e.detected_status").alias("detected_status"),
        F.col("e.new_highlights_count").alias("new_highlights_count"),
    )
    lists = F.when(F.size("sent") > 0, F.col("sent")).otherwise(F.array("x"))
    sent = books.filter("last_export_at is not null or size(sent) > 0").withColumn("n", F.size(lists))
    sent = sent.select("*", F.posexplode(lists).alias("at", "e")).withColumn("last", F.col("at") == F.col("n") - 1)
    own = lambda ours, theirs: F.when(F.col("last"), F.col(ours)).otherwise(theirs)
    sent = sent.select(
        "book_key",
        F.col("at").cast("bigint").alias("event_no"),
        F.col("e.export_id").alias("export_id"),
        F.coalesce(F.when(F.col("last"), F.col("last_export_at")), F.col("e.exported_at")).alias("exported_at"),
        F.when(F.col("last") & (F.size("last_export_formats") > 0), F.col("last_export_formats")).otherwise(clean_strings(F.col("e.formats"))).alias("formats"),
        own("last_export_signature", F.col("e.content_signature_hash")).alias("content_hash"),
        F.coalesce("e.highlight_signature_hash", none("string")).alias("highlight_hash"),
        own("last_export_highlight_hashes", clean_hashes(F.col("e.highlight_signature_hashes"))).alias("highlight_hashes"),
        own("last_export_entry_hashes", clean_hashes(F.col("e.entry_signature_hashes"))).alias("entry_hashes"),
        F.coalesce("e.processed_at", F.when(F.col("last"), F.col("last_analysis_at"))).alias("processed_at"),
        F.coalesce("e.reexport_without_changes", F.lit(False)).alias("reexport_without_changes"),
    )
    return done.select(*_names(PROCESSING)), sent.select(*_names(EXPORT))
