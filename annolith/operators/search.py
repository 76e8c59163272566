"""Substring search by an index: which entries hold each run of three characters.

The index is a table of runs in order, each with the rows that hold it, in parts that a task made (a run that every row
holds is many parts). Files are sorted by run with small row groups, so a search reads the few that may hold its runs.
Rows that hold all runs asked for are then compared, so results equal those of a scan. Shorter searches scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = 3
#: Runs of a search that are looked up; Spark hands up to ten values of an IN to Parquet.
ASKED = 8


def runs(text: str) -> set[str]:
    return {text[i : i + RUN] for i in range(len(text) - RUN + 1)}


def asked(text: str) -> list[str]:
    """Up to ASKED runs, spread over the text."""
    found = sorted(runs(text), key=text.index)
    step = max(1, -(-len(found) // ASKED))
    return found[::step]


def _inverted(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[int]] = {}
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["run", "rows"])

    for part in batches:
        for row, text in zip(part.column("row").to_pylist(), part.column("text").to_pylist(), strict=True):
            own = runs(text)
            for run in own:
                held.setdefault(run, []).append(row)
            size += len(own)
            if size >= most:
                yield batch()
                held, size = {}, 0
    yield batch()


class SearchIndex:
    """The index at a path: `entries` with a row number each, and `runs`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, entries: DataFrame, group: int = 1 << 18) -> SearchIndex:
        """Index entries (content and any other columns); null content counts as empty. group: bytes of a row group."""
        entries.withColumn("_row", F.monotonically_increasing_id()).write.parquet(f"{self.path}/entries")
        texts = self._entries().select(F.col("_row").alias("row"), F.lower(F.coalesce("content", F.lit(""))).alias("text"))
        found = texts.mapInArrow(_inverted, "run string, rows array<long>")
        found.repartitionByRange("run").sortWithinPartitions("run").write.option("parquet.block.size", group).option("parquet.page.size", group // 4).parquet(f"{self.path}/runs")
        return self

    def _entries(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/entries")

    def candidates(self, search: str) -> DataFrame:
        """(row) of the rows that hold all runs that are looked up."""
        wanted = asked(search.strip().lower())
        listed = self.spark.read.parquet(f"{self.path}/runs").filter(F.col("run").isin(wanted))
        rows = listed.select("run", F.explode("rows").alias("row"))
        return rows.groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted)).select("row")

    def search(self, search: str, kind: str | None = None) -> DataFrame:
        """The entries of a type that hold the text, in lower case: as selection.search_entries finds them."""
        entries, text = self._entries(), search.strip().lower()
        if len(text) >= RUN:
            entries = entries.join(self.candidates(text).withColumnRenamed("row", "_row"), "_row", "left_semi")
        if text:
            entries = entries.filter(F.contains(F.lower("content"), F.lit(text)))
        if kind:
            entries = entries.filter(F.col("type") == kind)
        return entries.drop("_row")
