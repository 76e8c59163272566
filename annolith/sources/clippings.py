"""Raw clippings: uploads as bytes, split into segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolith.functions.text import strip

DELIMITER = "=========="


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(analysis_id, path, size, content, text) of the files at path; the id is the SHA-1 of the bytes.

    text is null where the bytes are not UTF-8: those files are for quarantined(), not for segments().
    """
    files = spark.read.format("binaryFile").load(path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return files.select(F.sha1("content").alias("analysis_id"), "path", F.col("length").alias("size"), "content", text.alias("text"))


def quarantined(uploads: DataFrame) -> DataFrame:
    return uploads.filter(F.col("text").isNull()).select("analysis_id", "path", "size", F.lit("not UTF-8").alias("reason"))


def segments(uploads: DataFrame) -> DataFrame:
    """(analysis_id, seq, raw): what stands between delimiters, stripped, without blank ones; seq is the place in the file."""
    cut = uploads.filter(F.col("text").isNotNull()).select("analysis_id", F.posexplode(F.split("text", DELIMITER, -1)).alias("seq", "raw"))
    return cut.select("analysis_id", F.col("seq").cast("long").alias("seq"), strip(F.col("raw")).alias("raw")).filter("raw <> ''")
