"""Line dedup: lines that spread over many sites are boilerplate and go.

A line's spread is its number of distinct sites. HyperLogLog sketches of the sites, one per line hash, are built in
each partition and merged by aggregation. Lines whose estimate is clearly above the threshold go, clearly below stay;
near the threshold (six standard errors of the sketch) the distinct sites are counted exactly.

Lines are compared without white space at their ends; blank lines are kept and count nowhere. Null text counts as
empty (and stays null); a null site is a site of its own. Repeated rows are treated alike. An empty table gives an
empty result. Columns that are not named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolith.llm.common import materialize

LG_K = 12
#: Relative standard error of the sketch: 1.04 / sqrt(2 ** LG_K).
ERROR = 1.04 / (1 << (LG_K // 2))
BLANKS = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _exploded(rows: DataFrame) -> DataFrame:
    lines = rows.select("row", "site", F.posexplode(_lines(F.col("text"))).alias("pos", "line")).withColumn("line", F.btrim("line", F.lit(BLANKS)))
    # 96 bits identify a line.
    return lines.filter("line <> ''").select("row", "site", "pos", F.xxhash64("line").alias("h1"), F.crc32("line").alias("h2"))


def widespread(lines: DataFrame, min_sites: int) -> DataFrame:
    """(h1, h2, sites) of the lines on at least min_sites distinct sites."""
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch")).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = materialize(spread.filter(F.col("sites") >= min_sites * (1 - 6 * ERROR) - 1), "spread")
    clear = F.col("sites") > min_sites * (1 + 6 * ERROR) + 1
    near = lines.join(_bounded(spread.filter(~clear).select("h1", "h2")), ["h1", "h2"], "left_semi")
    exact = near.select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites"))
    return spread.filter(clear).unionByName(exact.filter(F.col("sites") >= min_sites))


def _bounded(keys: DataFrame, most: int = 1_000_000) -> DataFrame:
    """keys (two numbers a row) with a broadcast hint if there are at most so many; beyond, Spark shuffles both sides."""
    return F.broadcast(keys) if keys.count() <= most else keys


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 8) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_removed, text (without the boilerplate lines)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit("null")).alias("site"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    lines = _exploded(rows)
    boilerplate = materialize(widespread(lines, min_sites).select("h1", "h2"), "boilerplate")
    gone = lines.select("row", "pos", "h1", "h2").join(_bounded(boilerplate), ["h1", "h2"], "left_semi")
    gone = gone.groupBy("row").agg(F.collect_set("pos").alias("gone"))
    joined = rows.join(gone, "row", "left").withColumn("lines", _lines(F.col("text")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    return joined.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")).alias("text"),
    )
