"""Delimited files of any size, read by ranges: many tasks take one file, and each segment is there once.

Spark's own reader cuts files at line breaks, so paths may be in any store that it reads. A task goes through the lines of
its ranges in order and cuts them at delimiters (which hold no line break, so none lies across two lines). What stands
before the first delimiter of a range continues the segment that the range before left open; these edges alone are
gathered, by segment. A segment's place in its file is the number of delimiters before it: those of earlier ranges, added
up over the few ranges of a file, and those before it in its own.

Files that are not UTF-8 give no segments and are listed by quarantined(). Empty files give nothing at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annolith.functions.text import strip
from annolith.session import scratch_folder
from annolith.sources.clippings import DELIMITER

#: Characters of a batch that goes back to Spark, about.
BATCH = 1 << 20
PIECES = pa.schema([("path", pa.string()), ("start", pa.int64()), ("place", pa.int64()), ("last", pa.bool_()), ("valid", pa.bool_()), ("raw", pa.string())])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as bytes, with the range they are from. A range's rows are in the order of the file within a task."""
    meta = {"path": "file_path", "start": "file_block_start", "size": "file_size"}
    return spark.read.option("lineSep", "\n").text(path).select(*(F.col(f"_metadata.{c}").alias(n) for n, c in meta.items()), F.col("value").cast("binary").alias("line"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each range in order; the open one is held until its end is seen."""
    key, place, open_, valid = None, 0, [], True
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for path, start, line in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "line")), strict=True):
            if (path, start) != key:
                if key:
                    rows.append((*key, place, True, valid, "\n".join(open_)))
                key, place, open_, valid = (path, start), 0, [], True
            try:
                text = line.decode()
            except UnicodeDecodeError:
                valid, text = False, ""
            size += len(text) + 50
            first, *others = text.split(DELIMITER)
            open_.append(first)
            for piece in others:
                rows.append((*key, place, False, valid, "\n".join(open_)))
                place, open_ = place + 1, [piece]
        if size >= BATCH:
            yield _batch(rows)
            rows, size = [], 0
    if key:
        rows.append((*key, place, True, valid, "\n".join(open_)))
    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(PIECES.names, r, strict=True)) for r in rows], schema=PIECES)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, analysis_id): the SHA-1 of each file's bytes, made line by line in one task for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, rest = None, None, 0
        done: list[tuple] = []

        def close() -> None:
            if state:
                done.append((*now, state.hexdigest()))

        for batch in batches:
            for path_, size, line in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "line")), strict=True):
                if (path_, size) != now:
                    close()
                    now, state, rest = (path_, size), hashlib.sha1(), size
                # The line break that the reader took away; the last line may have had none.
                rest -= len(line) + 1
                state.update(line if rest < 0 else line + b"\n")
        close()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in ((0, pa.string()), (1, pa.int64()), (2, pa.string()))], names=["path", "size", "analysis_id"])

    lines = _lines(spark, path).withColumn("at", F.monotonically_increasing_id())
    return lines.repartition("path").sortWithinPartitions("path", "start", "at").select("path", "size", "line").mapInArrow(run, "path string, size long, analysis_id string")


class Scan:
    """The segments of the files at a path. What the ranges gave is written once and read from there."""

    def __init__(self, spark: SparkSession, path: str):
        written = scratch_folder(spark, "pieces")
        _lines(spark, path).mapInArrow(_pieces, "path string, start long, place long, last boolean, valid boolean, raw string").write.parquet(written)
        self.pieces = spark.read.parquet(written)

    def quarantined(self) -> DataFrame:
        return self.pieces.filter(~F.col("valid")).select("path", F.lit("not UTF-8").alias("reason")).distinct()

    def segments(self) -> DataFrame:
        """(path, seq, raw): what stands between delimiters, stripped, without blank ones."""
        ranges = self.pieces.filter("last").select("path", "start", F.col("place").alias("breaks"))
        before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.withColumn("first", F.coalesce(F.sum("breaks").over(before), F.lit(0)))
        rows = self.pieces.join(ranges.select("path", "start", "first"), ["path", "start"]).join(self.quarantined().select("path"), "path", "left_anti")
        rows = rows.withColumn("seq", F.col("first") + F.col("place"))
        inside = rows.filter(~F.col("last") & (F.col("place") > 0)).select("path", "seq", "raw")
        edges = rows.filter(F.col("last") | (F.col("place") == 0)).groupBy("path", "seq").agg(F.array_sort(F.collect_list(F.struct("start", "raw"))).alias("parts"))
        whole = edges.select("path", "seq", F.array_join(F.transform("parts", lambda p: p["raw"]), "\n").alias("raw"))
        return inside.unionByName(whole).select("path", "seq", strip(F.col("raw")).alias("raw")).filter("raw <> ''")
