"""Importance resampling: documents drawn so that their hashed n-grams resemble those of a target corpus.

Every run of 1 to max_n consecutive words is a feature and falls into a bucket. Documents become inverted postings, dealt
by bucket; where both corpora's counts of a bucket meet, the gain of the bucket is worked out, and each posting sends count
* gain back to its document. A document's weight is the floored mean over its features. With Gumbel noise from a seeded
hash of its id added, the highest scores are a draw without replacement in proportion to exp(weight / 1000).

Postings of a bucket may be any share of all: they are cut into slices of documents, and gains go to each slice. Null text
has no words. Null ids count as empty text in the hash, and come after all ids among equal scores; rows of one id and
score come in any order. Repeated rows are documents of their own. Without a target corpus gains still follow the formula,
with no counts on that side. An empty table gives an empty result. Columns that are not named are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolith.llm.common import CACHES, Scratch, in_order, map_batches, materialize, release

BUCKETS = 10_000
#: ASCII letters lower-cased, everything in ASCII that is neither a letter nor a digit a space.
_SEEN = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_SEEN).split()


class _Hashes(dict):
    most = 200_000

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[feature] = value = zlib.crc32(feature)
        return value


_HASHES = _Hashes()
CACHES.append(_HASHES)


def features(words: list[bytes], max_n: int, buckets: int) -> np.ndarray:
    """The bucket of every feature, repeats too."""
    found = [_HASHES[w] for w in words]
    for n in range(2, max_n + 1):
        found += [zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]
    return np.array(found, np.int64) % buckets


def _counted(docs: DataFrame, max_n: int, buckets: int) -> DataFrame:
    """docs with n_words, n_features, and the document's buckets with their counts, in place of text."""

    def make(cols: dict[str, list]) -> dict[str, list]:
        out = {**cols, "n_words": [], "n_features": [], "buckets": [], "counts": []}
        for text in cols["text"]:
            words = words_of(text)
            own = features(words, max_n, buckets)
            found, counts = np.unique(own, return_counts=True)
            out["n_words"].append(len(words))
            out["n_features"].append(len(own))
            out["buckets"].append(found.astype(np.int32))
            out["counts"].append(counts.astype(np.int32))
        return out

    kept = [f"{n} {t}" for n, t in docs.dtypes if n != "text"]
    return map_batches(docs, make, ", ".join([*kept, "n_words long, n_features long, buckets array<int>, counts array<int>"]))


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, first, docs, counts): the postings of each bucket in a batch of documents, ordered by bucket."""
    for batch in batches:
        lists = batch.column("buckets")
        sizes = np.diff(lists.offsets.to_numpy())
        of, counts = lists.flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
        if not len(of):
            continue
        docs = np.repeat(batch.column("row").to_numpy(), sizes)
        order = np.argsort(of, kind="stable")
        of, docs, counts = of[order], docs[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        offsets = pa.array(np.append(starts, len(of)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (docs, counts)]
        yield pa.RecordBatch.from_arrays([pa.array(of[starts]), pa.array(docs[starts]), *lists], names=["bucket", "first", "docs", "counts"])
    release()


def _sums(counted: DataFrame) -> DataFrame:
    """(bucket, n) of a corpus, added up in each partition first."""
    pairs = counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("p"))
    return pairs.groupBy(F.col("p.buckets").alias("bucket")).agg(F.sum("p.counts").alias("n"))


def gain(s: Column, t: Column, all_s: int, all_t: int, buckets: int) -> Column:
    ratio = ((t + 1) * (F.lit(all_s) + buckets)) / ((s + 1) * (F.lit(all_t) + buckets))
    return F.floor(F.lit(1000.0) * F.log(ratio)).cast("long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Floored Gumbel noise in thousandths, from 32 bits of a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", max_n: int = 1, buckets: int = BUCKETS, min_words: int = 20, percent: int = 10, seed: int = 2024, slice_docs: int = 1_000_000) -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, rank (of the drawn, else null).

    Drawn are floor(percent * N / 100) of the N documents with at least min_words words. Buckets are cut into one slice
    for each slice_docs documents, 16 at least.
    """
    with Scratch(docs.sparkSession, "resampling") as scratch:
        base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        counted = scratch.table(_counted(base, max_n, buckets).withColumn("row", F.monotonically_increasing_id()))
        aimed = _counted(target.select(F.col(target_col).cast("string").alias("text")), max_n, buckets)
        slices = max(16, math.ceil(counted.count() / slice_docs))

        # Both corpora's sums of a bucket meet.
        none = F.lit(0).cast("long")
        sides = _sums(counted).select("bucket", F.col("n").alias("s"), none.alias("t")).unionByName(_sums(aimed).select("bucket", none.alias("s"), F.col("n").alias("t")))
        met = scratch.table(sides.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
        all_s, all_t = (int(x or 0) for x in met.agg(F.sum("s"), F.sum("t")).first())
        gains = met.filter("s > 0").select("bucket", gain(F.col("s"), F.col("t"), all_s, all_t, buckets).alias("gain"))
        gains = gains.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

        postings = counted.select("row", "buckets", "counts").mapInArrow(_inverted, "bucket int, first long, docs array<long>, counts array<int>")
        postings = postings.withColumn("slice", F.pmod(F.hash("first"), F.lit(slices))).drop("first")
        sent = postings.join(gains.hint("merge"), ["bucket", "slice"]).select("gain", F.explode(F.arrays_zip("docs", "counts")).alias("p"))
        sums = sent.groupBy(F.col("p.docs").alias("row")).agg(F.sum(F.col("p.counts") * F.col("gain")).alias("sum"))

        sized = counted.select("row", "doc_id", "n_words", "n_features").join(sums, "row", "left")
        mean = F.expr("(sum - pmod(sum, n_features)) div n_features")
        weighed = sized.withColumn("weight", F.when(F.col("n_features") > 0, mean).otherwise(none))
        scored = scratch.table(weighed.select("row", "doc_id", "n_words", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score")))
        fit = scored.filter(F.col("n_words") >= min_words)
        drawn = fit.count() * percent // 100
        ranked = in_order(fit.select("row", "doc_id", "score"), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()], scratch)
        ranks = ranked.filter(F.col("place") < drawn).select("row", (F.col("place") + 1).alias("rank"))
        return materialize(scored.join(ranks, "row", "left").select("doc_id", "n_features", "weight", "score", "rank"), "resampled")
