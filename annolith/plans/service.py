"""The lifecycle as plans: analyse, list entries, clip, export. What clients did wrong is a typed error."""

from __future__ import annotations

import json
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolith.operators import dedup, parsing, render, selection, snapshots, status
from annolith.session import scratch_folder
from annolith.settings import ANALYSES_KEPT, Settings
from annolith.sources import clippings, sinks
from annolith.sources.analyses import Analyses
from annolith.sources.history import History


class NotReadable(ValueError):
    """The upload is not UTF-8."""


class UnknownAnalysis(LookupError):
    """No such analysis is stored; it must be uploaded again."""


class UnknownBook(LookupError):
    """The analysis has no such book."""


class NothingToExport(ValueError):
    """No book was chosen, none of those chosen is known, or no file came of it."""


def iso(moment: datetime | None = None) -> str:
    moment = moment or datetime.now(UTC)
    return (moment if moment.tzinfo else moment.replace(tzinfo=UTC)).astimezone(UTC).isoformat()


class Opened:
    """Analyses held in memory: the least recently used one is released beyond `most`."""

    def __init__(self, most: int = ANALYSES_KEPT):
        self.most, self.held = most, OrderedDict()

    def get(self, analysis_id: str, make: Callable[[], Analysis]) -> Analysis:
        return self.put(analysis_id, self.held[analysis_id] if analysis_id in self.held else make())

    def put(self, analysis_id: str, made: Analysis) -> Analysis:
        """Hold an analysis as the one used last; another one of the same id is released."""
        before = self.held.pop(analysis_id, made)
        if before is not made:
            before.release()
        self.held[analysis_id] = made
        while len(self.held) > self.most:
            self.held.popitem(last=False)[1].release()
        return made


@dataclass
class Analysis:
    """An analysis as tables in a folder of its own: they survive a lost executor, and an upload that is gone or changed."""

    settings: Settings
    parsed: DataFrame
    decisions: DataFrame
    entries: DataFrame
    snapshots: DataFrame
    analysis_id: str = ""
    uploaded_name: str = ""
    folder: str = ""

    def stats(self) -> DataFrame:
        """Counters by analysis, with the errors of parsing."""
        return dedup.metrics(self.decisions).join(parsing.errors(self.parsed), "analysis_id", "full_outer").fillna(0)

    def report(self) -> DataFrame:
        return dedup.report(parsing.entries(self.parsed), self.decisions)

    def release(self) -> None:
        context = self.parsed.sparkSession.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(self.folder)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)

    def export_totals(self, keys: list[str]) -> tuple[int, int]:
        """(books asked for, entries of those that there are)."""
        wanted = self.entries.sparkSession.createDataFrame([(k,) for k in keys], "book_key string")
        return tuple(selection.export_totals(self.entries, wanted).first())

    def book(self, book_key: str) -> DataFrame:
        found = self.entries.filter(F.col("book_key") == book_key)
        if found.isEmpty():
            raise UnknownBook(book_key)
        return found

    def book_entries(self, book_key: str) -> DataFrame:
        """The served fields of a book's entries, in its order."""
        return parsing.served(self.book(book_key).orderBy(*render.sort_key()))


def analyse_uploads(uploads: DataFrame, settings: Settings) -> Analysis:
    return analyse_entries(parsing.parse(clippings.segments(uploads)), settings)


def analyse_entries(parsed: DataFrame, settings: Settings) -> Analysis:
    folder = scratch_folder(parsed.sparkSession, "analysis")

    def held(table: DataFrame, name: str) -> DataFrame:
        table.write.parquet(f"{folder}/{name}")
        return table.sparkSession.read.schema(table.schema).parquet(f"{folder}/{name}")

    parsed = held(parsed, "parsed")
    found = parsing.entries(parsed)
    decisions = held(dedup.decide(found, settings), "decisions")
    kept = held(dedup.survivors(found, decisions), "entries")
    return Analysis(settings, parsed, decisions, kept, snapshots.snapshots(kept), folder=folder)


class Service:
    """Analyses and exports over a folder of history and stored uploads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.history = History(spark, f"{folder}/history")
        self.analyses = Analyses(spark, f"{folder}/analyses")
        self.opened = Opened()

    def analyse(self, path: str, settings: Settings, at: datetime | None = None, forced: bool = False) -> tuple[Analysis, list[dict]]:
        """Analyse one file, record it, keep its bytes: the analysis and the rows of its books table."""
        uploads = clippings.read_uploads(self.spark, path)
        if not clippings.quarantined(uploads).isEmpty():
            raise NotReadable(path)
        first = uploads.select("analysis_id", F.element_at(F.split("path", "/"), -1).alias("name")).first()
        made = replace(analyse_uploads(uploads, settings), analysis_id=first["analysis_id"], uploaded_name=first["name"])
        rows = [r.asDict() for r in status.books_table(made.snapshots, self.history.books(), iso(at), forced).collect()]
        self.history.record_analysis(made.snapshots, iso(at), forced)
        self.opened.put(made.analysis_id, made)
        self.analyses.save(uploads, iso(at), json.dumps(settings.as_request(), sort_keys=True))
        return made, rows

    def reopen(self, analysis_id: str | None = None, settings: Settings | None = None) -> Analysis:
        """An analysis that is held, or a stored one (by default the latest) computed again, with the settings that it was
        stored with unless others are given; nothing is recorded."""
        if analysis_id in self.opened.held and settings in (None, self.opened.held[analysis_id].settings):
            return self.opened.put(analysis_id, self.opened.held[analysis_id])
        upload = self.analyses.latest() if analysis_id is None else self.analyses.get(analysis_id)
        first = upload.select("analysis_id", "path", "config").first()
        if first is None:
            raise UnknownAnalysis(analysis_id or "latest")
        held = self.opened.held.get(first["analysis_id"])
        if held is not None and settings in (None, held.settings):
            return self.opened.put(first["analysis_id"], held)
        wanted = settings or Settings.of_stored(first["config"])
        made = replace(analyse_uploads(upload, wanted), analysis_id=first["analysis_id"], uploaded_name=first["path"])
        return self.opened.put(made.analysis_id, made)

    def response(self, analysis: Analysis) -> dict:
        """What a client gets of an analysis."""
        rows = status.books_table(analysis.snapshots, self.history.books())
        listed = [r.asDict() for r in rows.collect()]
        return {
            "analysisId": analysis.analysis_id,
            "uploadedName": analysis.uploaded_name,
            "rows": listed,
            "stats": [r.asDict() for r in analysis.stats().collect()],
            "selectionMap": {r["book_key"]: r["default_selected"] for r in listed},
            "statusOptions": status.status_options(bool(listed)),
            "authorOptions": sorted({r["author"] for r in listed}),
        }

    def _chosen(self, analysis: Analysis, keys: list[str], only_new: bool) -> DataFrame:
        wanted = self.spark.createDataFrame([(k,) for k in keys], "book_key string")
        entries = analysis.entries.join(selection.known_keys(wanted, analysis.snapshots), "book_key", "left_semi")
        if only_new:
            entries = status.fresh_entries(snapshots.with_hashes(entries), self.history.books()).drop("entry_hash", "highlight_hash")
        return entries

    def clip(self, analysis: Analysis, book_key: str, only_new: bool = False, metadata: bool = True) -> str:
        analysis.book(book_key)
        entries = self._chosen(analysis, [book_key], only_new)
        pages = render.clip_page(entries, analysis.settings, metadata).select("content").collect()
        return pages[0]["content"] if pages else ""

    def export_files(self, analysis: Analysis, keys: Iterable[str], settings: Settings, at: datetime | None = None) -> DataFrame:
        """The files of the chosen books, which are then marked as exported."""
        keys = list(keys)
        if not keys:
            raise NothingToExport("no book was chosen")
        wanted = self.spark.createDataFrame([(k,) for k in keys], "book_key string")
        if selection.known_keys(wanted, analysis.snapshots).isEmpty():
            raise NothingToExport("none of the chosen books is in this analysis")
        entries = self._chosen(analysis, keys, settings.export_only_new)
        # Written before the export is marked: what was new must not be computed again from the history after it.
        path = f"{self.folder}/exports/{uuid.uuid4().hex}"
        render.files(entries, settings).write.parquet(path)
        files = self.spark.read.parquet(path)
        if files.isEmpty():
            raise NothingToExport("nothing new since the last export" if settings.export_only_new else "no export format is enabled")
        sent = analysis.snapshots.join(entries.select("book_key").distinct(), "book_key", "left_semi") if settings.strict_marking else None
        marked = sent.select("book_key") if sent is not None else wanted
        self.history.mark_exported(marked, settings.format_labels(), iso(at), sent)
        return files

    def export_zip(self, analysis: Analysis, keys: Iterable[str], settings: Settings, at: datetime | None = None) -> bytes:
        return sinks.zip_archive(self.export_files(analysis, keys, settings, at))

    def export_book(self, analysis: Analysis, book_key: str, settings: Settings, at: datetime | None = None) -> list[dict]:
        return [r.asDict() for r in sinks.encoded(self.export_files(analysis, [book_key], settings, at)).collect()]
