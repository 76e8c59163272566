"""Content-addressed WARC archive.

An archive is a folder with two tables: `blobs` holds every payload once, compressed, under its SHA-256, and `headers`
holds each record's exact header block. Reading joins them again: every record comes back as its original bytes, with
the full payload beside it also where it is a revisit. Every blob is verified when it is read (its digest is computed
anew), so a damaged archive raises an error instead of giving wrong records. A payload that very many records share
is one row of `blobs`; in the join its records are one key, which Spark's skew handling splits on their side.

Null payload counts as empty; null page_id sorts last among records of one payload. Repeated rows (same id and
payload) give as many records, all of one type. Empty tables give an empty archive. Columns that are not named are
ignored. Records whose payload is smaller than `min_revisit_bytes` are responses, each of them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterable, Iterator

import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annolith.llm.common import map_batches

#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NIL_DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def pack(payload: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(payload)


def unpack(blob: bytes) -> bytes:
    """The payload of a blob; an error unless the blob is exactly one whole frame."""
    reader = zstandard.ZstdDecompressor().decompressobj()
    try:
        payload = reader.decompress(blob)
    except zstandard.ZstdError as e:
        raise ValueError("archive damaged: a blob cannot be read") from e
    if not reader.eof or reader.unused_data:
        raise ValueError("archive damaged: a blob is not one whole frame")
    return payload


def _digests(cols: dict[str, list]) -> dict[str, list]:
    return {
        **{c: cols[c] for c in ("page_id", "url")},
        "payload": [pack(p) for p in cols["payload"]],
        "n_bytes": [len(p) for p in cols["payload"]],
        "sha256": [hashlib.sha256(p).hexdigest() for p in cols["payload"]],
        "sha1": [base32_sha1(p) for p in cols["payload"]],
    }


def _verify(cols: dict[str, list]) -> dict[str, list]:
    payloads = [unpack(b) for b in cols["payload"]]
    for want, payload in zip(cols["sha256"], payloads, strict=True):
        if hashlib.sha256(payload).hexdigest() != want:
            raise ValueError(f"archive damaged: the blob of {want} has other bytes")
    return {"sha256": cols["sha256"], "blob": cols["payload"]}


def record_uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _header(first: Column, length: Column) -> Column:
    """The header block of one record as its exact text, by the rules of the format (CRLF lines, empty last line)."""
    revisit = F.col("revisit")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    nothing = F.lit("")
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_uri(F.col("page_id"))),
        line("WARC-Date", F.lit(NIL_DATE)),
        F.when(F.col("url").isNull(), nothing).otherwise(line("WARC-Target-URI", F.regexp_replace(F.col("url"), "[\\r\\n]", ""))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", record_uri(first)), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(nothing),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(length.cast("string"))),
        F.lit("\r\n"),
    )


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0) -> None:
    """Write one record per row of pages to the archive at path."""
    spark = pages.sparkSession
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = map_batches(rows, _digests, "page_id long, url string, payload binary, n_bytes long, sha256 string, sha1 string")
    # One row for each payload and partition is shuffled, not one for each record.
    order = F.struct(F.col("page_id").isNull(), F.col("page_id"))
    blobs = rows.groupBy("sha256").agg(F.min_by("payload", order).alias("payload"), F.min("page_id").alias("first_id"), F.max("n_bytes").alias("n_bytes"))
    blobs.write.option("compression", "zstd").parquet(f"{path}/blobs")
    firsts = spark.read.parquet(f"{path}/blobs").select("sha256", "first_id", "n_bytes")
    records = rows.select("page_id", "url", "sha256", "sha1").join(firsts, "sha256", "left")
    records = records.withColumn("revisit", ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("n_bytes") >= min_revisit_bytes))
    headers = records.select("page_id", "sha256", _header(F.col("first_id"), F.col("n_bytes")).alias("header"))
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")


def _unpacked(cols: dict[str, list]) -> dict[str, list]:
    return {**cols, "payload": [unpack(b) for b in cols.pop("blob")]}


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record: page_id, header, sha256 and the full payload (verified). Compressed blobs meet the headers."""
    headers = spark.read.parquet(f"{path}/headers")
    blobs = spark.read.parquet(f"{path}/blobs").select("sha256", "payload")
    joined = headers.join(map_batches(blobs, _verify, "sha256 string, blob binary"), "sha256", "left")
    blob = F.when(F.col("blob").isNull(), F.raise_error(F.lit("archive damaged: a blob is missing")).cast("binary")).otherwise(F.col("blob"))
    return map_batches(joined.select("page_id", "header", "sha256", blob.alias("blob")), _unpacked, "page_id long, header string, sha256 string, payload binary")


def header_field(name: str, header: Column | None = None) -> Column:
    """The value of a header field, null where the record has none."""
    found = F.regexp_extract(header if header is not None else F.col("header"), f"\\r\\n{name}: ([^\\r]*)\\r\\n", 1)
    return F.when(found != "", found)


def record_bytes(records: DataFrame) -> DataFrame:
    """Original records (column record): header block, payload (none in a revisit), two line ends; and the full payload."""
    body = F.when(header_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.select("page_id", F.concat(F.encode("header", "UTF-8"), body, F.lit(b"\r\n\r\n")).alias("record"), "payload")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a WARC file, plain or gzipped."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: file, fields (map), block. A file is read by one task, so keep files to some hundred MB."""

    def run(batches: Iterable):
        import pandas as pd

        for frame in batches:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows = [(name, f, b) for f, b in parse_records(bytes(content))]
                yield pd.DataFrame(rows, columns=["file", "fields", "block"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, fields map<string,string>, block binary")


def _told(cols: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
    for page_id, record, payload in zip(cols["page_id"], cols["record"], cols["payload"], strict=True):
        ((fields, block),) = parse_records(record)
        kind, full = fields["warc-type"], payload
        if kind == "response":
            full = block
        digest = base32_sha1(full)
        if fields["warc-payload-digest"] != f"sha1:{digest}":
            raise ValueError("archive damaged: a record's payload has another digest than its header says")
        refers = re.fullmatch("<urn:page:(-?[0-9]+)>", fields.get("warc-refers-to", ""))
        for column, value in zip(out.values(), (page_id, len(full), digest, kind, int(refers[1]) if refers else None), strict=True):
            column.append(value)
    return out


def summary(records: DataFrame) -> DataFrame:
    """What each reconstructed record (record_bytes) says of itself when it is parsed again: size and digest of its
    payload, taken from its own block or, for a revisit, from the payload that it refers to."""
    return map_batches(records.select("page_id", "record", "payload"), _told, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
