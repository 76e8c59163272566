"""Rendered files out: as a table, into a folder, as a ZIP archive, as base64. A selection is a reader's choice of books,
so write_folder() and zip_archive() gather it on the driver; write_table() and zip_pieces() are for everything."""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annolith.operators.render import unique_files
from annolith.session import scratch_folder

MIME = {"md": "text/markdown; charset=utf-8", "html": "text/html; charset=utf-8", "txt": "text/plain; charset=utf-8"}


def write_table(files: DataFrame, path: str) -> None:
    """path, content by format, in parallel."""
    unique_files(files).write.partitionBy("format").parquet(path)


def write_folder(files: DataFrame, folder: str) -> int:
    """Write each file under folder; the number of files that could not be written is returned, not raised."""
    failed = 0
    for row in unique_files(files).toLocalIterator():
        target = Path(folder) / row["path"]
        try:
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(row["content"], encoding="utf-8")
        except OSError:
            failed += 1
    return failed


#: Bytes of an archive's end; the most that its numbers of entries and of bytes hold without ZIP64.
END, MOST_ENTRIES, MOST_BYTES = 22, 0xFFFF, 0xFFFFFFFF


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each file as the member and the directory's entry of an archive of its own."""
    for batch in batches:
        for path, content in zip(*(batch.column(c).to_pylist() for c in ("path", "content")), strict=True):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr(path, content or "")
            data = out.getvalue()
            row = {"path": path, "member": data[: archive.start_dir], "entry": data[archive.start_dir : -END]}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("path", pa.string()), ("member", pa.binary()), ("entry", pa.binary())]))


def _placed(entry: bytes, start: int) -> bytes:
    """The entry of a member that begins at start."""
    if start < MOST_BYTES:
        return entry[:42] + struct.pack("<I", start) + entry[46:]
    extra = struct.unpack_from("<H", entry, 30)[0]
    return entry[:6] + struct.pack("<H", 45) + entry[8:30] + struct.pack("<H", extra + 12) + entry[32:42] + struct.pack("<I", MOST_BYTES) + entry[46:] + struct.pack("<HHQ", 1, 8, start)


def _end(entries: int, size: int, start: int) -> bytes:
    """What follows a directory of so many entries and bytes that begins at start."""
    big = b""
    if entries >= MOST_ENTRIES or size >= MOST_BYTES or start >= MOST_BYTES:
        big = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, entries, entries, size, start) + struct.pack("<4sIQI", b"PK\x06\x07", 0, start + size, 1)
    return big + struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, min(entries, MOST_ENTRIES), min(entries, MOST_ENTRIES), min(size, MOST_BYTES), min(start, MOST_BYTES), 0)


def zip_pieces(files: DataFrame) -> DataFrame:
    """A deflated archive, entries sorted by path, in pieces: place, start (where the member begins), path, member, entry.
    The archive is all members by place, all entries (placed at their start), and an end. Made in tasks by ranges of paths,
    of which the driver sees none."""
    spark = files.sparkSession
    path = scratch_folder(spark, "zip")
    ranged = unique_files(files).select("path", "content").repartitionByRange("path").sortWithinPartitions("path")
    packed = ranged.mapInArrow(_packed, "path string, member binary, entry binary")
    packed.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id(), "size": F.length("member").cast("long")}).write.parquet(path)
    made = spark.read.parquet(path)
    # One row a range of paths, then the lengths of each range's members.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = made.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size"))
    parts = parts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("size_before"))
    own = Window.partitionBy("part").orderBy("row")
    spots = made.select("part", "row", (F.row_number().over(own) - 1).alias("at"), (F.sum("size").over(own) - F.col("size")).alias("from"))
    spots = spots.join(parts, "part").select("row", (F.col("at") + F.col("rows_before")).alias("place"), (F.col("from") + F.col("size_before")).alias("start"))
    return made.join(spots, "row").select("place", "start", "path", "member", "entry")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for place, member, entry in zip(*(batch.column(c).to_pylist() for c in ("place", "member", "entry")), strict=True):
            with zipfile.ZipFile(io.BytesIO(member + entry + _end(1, len(entry), len(member)))) as archive:
                (info,) = archive.infolist()
                rows.append({"place": place, "path": info.filename, "deflated": info.compress_type == zipfile.ZIP_DEFLATED, "sha1": hashlib.sha1(archive.read(info)).hexdigest()})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("place", pa.int32()), ("path", pa.string()), ("deflated", pa.bool_()), ("sha1", pa.string())]))


def zip_listing(pieces: DataFrame) -> DataFrame:
    """What an archive's members hold, read back from their bytes in tasks: place, path, deflated, sha1."""
    return pieces.mapInArrow(_listed, "place int, path string, deflated boolean, sha1 string")


def zip_archive(files: DataFrame) -> bytes:
    """The archive's bytes."""
    out, entries = io.BytesIO(), []
    for row in zip_pieces(files).orderBy("place").toLocalIterator():
        out.write(row["member"])
        entries.append(_placed(bytes(row["entry"]), row["start"]))
    start, directory = out.tell(), b"".join(entries)
    out.write(directory + _end(len(entries), len(directory), start))
    return out.getvalue()


def encoded(files: DataFrame) -> DataFrame:
    """(filename, format, mime_type, content_base64), sorted by path."""
    rows = unique_files(files).orderBy("path")
    kind = F.element_at(F.split("path", r"\."), -1)
    mime = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair]), kind), F.lit("application/octet-stream"))
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "format", mime.alias("mime_type"), F.regexp_replace(F.base64(F.encode("content", "UTF-8")), "[\\r\\n]", "").alias("content_base64"))
