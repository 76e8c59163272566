"""Stored analyses: numbered index entries and the raw bytes beside them; the last few saved count, others are removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolith.settings import ANALYSES_KEPT
from annolith.sources.log import BatchLog

INDEX = "analysis_id string, filename string, uploaded_at string, size bigint, config string, saved_no bigint"
CONTENT = "analysis_id string, content binary"


def retained(index: DataFrame, most: int = ANALYSES_KEPT) -> DataFrame:
    """The analyses most recently saved, latest first; saving one again moves it up. Top-k, not a full sort."""
    rest = [c for c in index.columns if c not in ("analysis_id", "saved_no")]
    once = index.groupBy("analysis_id").agg(F.max("saved_no").alias("saved_no"), F.max_by(F.struct(*rest), "saved_no").alias("_r"))
    return once.select("analysis_id", "saved_no", "_r.*").orderBy(F.desc("saved_no")).limit(most)


class Analyses:
    def __init__(self, spark: SparkSession, path: str, most: int = ANALYSES_KEPT):
        self.spark, self.path, self.most = spark, path.rstrip("/"), most
        self._index, self._content = BatchLog(spark, f"{self.path}/index", INDEX), BatchLog(spark, f"{self.path}/content", CONTENT)

    def save(self, uploads: DataFrame, uploaded_at: str, config: str = "{}") -> None:
        """Add uploads (analysis_id, path, size, content) as the newest. The bytes come first, so that an index entry always
        has them; then whatever no longer counts is removed."""
        with self._index.lock:
            number = self._index.claim()
            self._content.append(uploads.select("analysis_id", "content"), number)
            rows = uploads.select("analysis_id", F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit(uploaded_at).alias("uploaded_at"), F.col("size").cast("bigint").alias("size"), F.lit(config).alias("config"), F.lit(number).cast("bigint").alias("saved_no"))
            self._index.append(rows, number)
            listed = {log: log.names() for log in (self._index, self._content)}
            counted = {r["saved_no"] for r in retained(self._index.read(listed[self._index]), self.most).select("saved_no").collect()}
            for log, names in listed.items():
                # The bytes of an upload come before its entry, so later numbers are not judged by this list of entries.
                newest = max(map(log.number, listed[self._index]))
                log.retire(n for n in names if log.number(n) not in counted and log.number(n) <= newest)

    def list(self) -> DataFrame:
        return retained(self._index.read(), self.most).drop("saved_no")

    def uploads(self) -> DataFrame:
        """The retained uploads whose bytes are there, as sources.clippings reads them, with saved_no and config."""
        batches = [(self._content.number(name), f"{self._content.path}/{name}") for name in self._content.names()]
        listed = retained(self._index.read(), self.most)
        found = None
        for number, path in batches:  # as many as are retained
            bytes_ = self.spark.read.schema(CONTENT).parquet(path).withColumn("saved_no", F.lit(number).cast("bigint"))
            found = bytes_ if found is None else found.unionByName(bytes_)
        if found is None:
            found = self.spark.createDataFrame([], CONTENT + ", saved_no bigint")
        rows = listed.join(found, ["analysis_id", "saved_no"])
        text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
        return rows.select("analysis_id", F.col("filename").alias("path"), "size", "content", text.alias("text"), "config", "saved_no")

    def get(self, analysis_id: str) -> DataFrame:
        """The upload of an analysis, or no rows."""
        return self.uploads().filter(F.col("analysis_id") == analysis_id).drop("saved_no")

    def latest(self) -> DataFrame:
        """The newest upload whose bytes are there."""
        return self.uploads().orderBy(F.desc("saved_no")).limit(1).drop("saved_no")
