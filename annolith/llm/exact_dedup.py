"""Exact dedup: counting quotient filters find repeated fingerprints, bytes decide.

1. Every row gets a 64-bit fingerprint (of the SHA-256 of its text without white space).
2. Each partition counts its fingerprints in a counting quotient filter. The filters are cut by quotient range,
   merged range by range (sorted remainders, counts added: nothing is lost), and give the fingerprints seen twice
   or more. A fingerprint enters the merge once per partition, however many rows carry it.
3. Rows of those fingerprints are verified by their bytes; all other rows are alone in their group.

Null text counts as empty. Empty texts are equal to each other. Of repeated rows (same id and text) one stays.
Null ids sort last. An empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolith.llm.common import BLANK, map_batches, materialize, repeat_rows, row_key

#: Share of the slots of a filter that are in use at most.
LOAD = 0.75


class CountingQuotientFilter:
    """Counts of 64-bit fingerprints in the slots of a quotient filter.

    The upper `bits` of a fingerprint are its quotient, the slot where it belongs; the rest is its remainder, which is
    what a slot stores, with a count. Remainders of one quotient are a sorted run; runs follow each other in the order
    of their quotients and are shifted right where a slot is taken. Three bits a slot say how to read that: `occupied`
    (some fingerprint has this quotient), `continuation` (not the first of its run), `shifted` (not where it belongs).
    """

    def __init__(self, bits: int, occupied: np.ndarray, continuation: np.ndarray, shifted: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.bits, self.occupied, self.continuation, self.shifted = bits, occupied, continuation, shifted
        self.remainders, self.counts = remainders, counts

    @classmethod
    def of_sorted(cls, values: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        """Slots for sorted distinct fingerprints."""
        bits = max(1, int(np.ceil(np.log2(max(1, len(values)) / LOAD))))
        quotients = (values >> np.uint64(64 - bits)).astype(np.int64)
        order = np.arange(len(values))
        # Each stands where it belongs or right behind the one before it.
        slots = np.maximum.accumulate(quotients - order) + order if len(values) else order
        size = max(1 << bits, int(slots[-1]) + 1 if len(slots) else 0)
        occupied, continuation, shifted = (np.zeros(size, bool) for _ in range(3))
        occupied[quotients] = True
        continuation[slots[1:]] = quotients[1:] == quotients[:-1]
        shifted[slots] = slots != quotients
        remainders, stored = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        remainders[slots] = values & np.uint64((1 << (64 - bits)) - 1)
        stored[slots] = counts
        return cls(bits, occupied, continuation, shifted, remainders, stored)

    @classmethod
    def build(cls, fingerprints: np.ndarray) -> CountingQuotientFilter:
        values, counts = np.unique(fingerprints.astype(np.uint64), return_counts=True)
        return cls.of_sorted(values, counts.astype(np.int64))

    def _used(self) -> np.ndarray:
        """Slots in use: those with a shifted or continued remainder, or where a fingerprint stands that belongs there."""
        return np.flatnonzero(self.counts)

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints, counts), by walking the slots: the k-th run is that of the k-th occupied quotient."""
        slots = self._used()
        run = np.cumsum(~self.continuation[slots]) - 1
        quotients = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        return (quotients << np.uint64(64 - self.bits)) | self.remainders[slots], self.counts[slots]

    def count_of(self, fingerprints: np.ndarray) -> np.ndarray:
        """Count of each fingerprint, 0 where it is not in the filter: its run is found by rank, and searched."""
        quotients = (fingerprints >> np.uint64(64 - self.bits)).astype(np.int64)
        slots = self._used()
        first = np.append(np.flatnonzero(~self.continuation[slots]), len(slots))
        rank = np.cumsum(self.occupied)[quotients] - 1
        out = np.zeros(len(fingerprints), np.int64)
        mask = np.uint64((1 << (64 - self.bits)) - 1)
        for i in np.flatnonzero(self.occupied[quotients]):
            run = slots[first[rank[i]] : first[rank[i] + 1]]
            at = np.searchsorted(self.remainders[run], fingerprints[i] & mask)
            if at < len(run) and self.remainders[run[at]] == fingerprints[i] & mask:
                out[i] = self.counts[run[at]]
        return out

    def merged(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """The filter of all rows that went into either. Both are walked in order and zipped: nothing is sorted again."""
        (a, m), (b, n) = self.sorted(), other.sorted()
        values, counts = np.empty(len(a) + len(b), np.uint64), np.empty(len(a) + len(b), np.int64)
        mine, theirs = np.arange(len(a)) + np.searchsorted(b, a, "left"), np.arange(len(b)) + np.searchsorted(a, b, "right")
        values[mine], values[theirs], counts[mine], counts[theirs] = a, b, m, n
        again = np.flatnonzero(values[1:] == values[:-1]) + 1  # at most the second of two
        counts[again - 1] += counts[again]
        keep = np.ones(len(values), bool)
        keep[again] = False
        return self.of_sorted(values[keep], counts[keep])

    @staticmethod
    def merged_all(filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Two by two, so that each fingerprint takes part in a logarithmic number of merges."""
        while len(filters) > 1:
            filters = [f[0].merged(f[1]) if len(f) > 1 else f[0] for f in (filters[i : i + 2] for i in range(0, len(filters), 2))]
        return filters[0]

    def ranges(self, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
        """(range, packed fingerprints, packed counts) of each range of quotients that has any."""
        values, counts = self.sorted()
        which = (values >> np.uint64(64 - bits)).astype(np.int64)
        starts = np.flatnonzero(np.diff(which, prepend=-1))
        for start, end in zip(starts, [*starts[1:], len(values)], strict=True):
            yield int(which[start]), values[start:end].tobytes(), counts[start:end].tobytes()

    @classmethod
    def unpacked(cls, values: bytes, counts: bytes) -> CountingQuotientFilter:
        return cls.of_sorted(np.frombuffer(values, np.uint64), np.frombuffer(counts, np.int64))


def _normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, BLANK)


def _describe(cols: dict[str, list]) -> dict[str, list]:
    digests = [hashlib.sha256(_normalised(t)) for t in cols["text"]]
    return {
        **cols,
        "n_points": [len(t or "") for t in cols["text"]],
        "text_sha256": [d.hexdigest() for d in digests],
        "fp": [int.from_bytes(d.digest()[:8], "big", signed=True) for d in digests],
    }


def _with_bytes(cols: dict[str, list]) -> dict[str, list]:
    texts = [_normalised(t) for t in cols["text"]]
    digests = [hashlib.sha256(t) for t in texts]
    return {
        "doc_id": cols["doc_id"],
        "fp": [int.from_bytes(d.digest()[:8], "big", signed=True) for d in digests],
        "text_sha256": [d.hexdigest() for d in digests],
        "norm": texts,
    }


def repeated_fingerprints(described: DataFrame, rows: int, per_range: int = 250_000) -> DataFrame:
    """Fingerprints (column fp) that more than one row of `described` has, by merged quotient filters."""
    bits = min(24, max(5, int(np.ceil(np.log2(max(1, rows / per_range))))))

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [CountingQuotientFilter.build(frame["fp"].to_numpy(np.int64).view(np.uint64)) for frame in frames if len(frame)]
        if parts:
            yield pd.DataFrame(list(CountingQuotientFilter.merged_all(parts).ranges(bits)), columns=["range", "fps", "counts"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        whole = CountingQuotientFilter.merged_all([CountingQuotientFilter.unpacked(v, c) for v, c in zip(frame["fps"], frame["counts"], strict=True)])
        values, counts = whole.sorted()
        return pd.DataFrame({"fp": values[counts > 1].view(np.int64)})

    blocks = described.select("fp").mapInPandas(build, "range long, fps binary, counts binary")
    return blocks.groupBy("range").applyInPandas(merge, "fp long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 250_000, row: Column | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    broadcast_rows: up to so many repeated fingerprints (8 bytes each) are broadcast to the second scan; more are joined.
    row: what tells rows of one id apart; it comes back as a further column.
    """
    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    base, names = docs.select(*columns), [] if row is None else ["row"]
    own = base if row is None else docs.select(*columns, row.alias("row"))
    described = map_batches(own, _describe, f"doc_id long, n_points long, text_sha256 string, fp long{', row long' if names else ''}")
    described = materialize(described.withColumn("token", F.monotonically_increasing_id()), "described")
    repeated = materialize(repeated_fingerprints(described, described.count()), "repeated")
    small = repeated.count() <= broadcast_rows
    side = F.broadcast(repeated) if small else repeated

    texts = map_batches(base, _with_bytes, "doc_id long, fp long, text_sha256 string, norm binary").join(side, "fp", "left_semi")
    # Equal bytes meet here: partial sums first, so that a group of any size sends a row for each partition.
    exact = ["fp", "text_sha256", "norm"]
    if not small:  # a salted exchange, so that Spark may split a hot fingerprint in the join below it
        texts = texts.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
        texts = texts.repartition(docs.sparkSession.sparkContext.defaultParallelism * 4, "fp", "salt")
        sums = texts.groupBy(*exact, "salt").agg(F.count(F.lit(1)).alias("n")).groupBy(*exact).agg(F.sum("n").alias("n"))
    else:
        sums = texts.groupBy(*exact).agg(F.count(F.lit(1)).alias("n"))
    classes = sums.groupBy("text_sha256").agg(F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("byte_classes"))
    classes = classes.select(
        "text_sha256",
        F.when(F.col("byte_classes") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("one SHA-256, different bytes")).cast("long")).alias("group_size"),
    )
    best = F.min(F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("d"), F.col("token").alias("t")))
    keepers = described.join(side, "fp", "left_semi").groupBy("text_sha256").agg(best.alias("best"))
    # Written first, so that the last join has two plain exchanges and Spark may split a hot group in it.
    groups = materialize(keepers.join(classes, "text_sha256").select("text_sha256", "group_size", "best"), "groups")
    joined = described.join(groups, "text_sha256", "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.d")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("best.t") == F.col("token"))).alias("kept"),
        "text_sha256",
        *names,
    )


def keep_rows(docs: DataFrame, broadcast_rows: int = 250_000) -> DataFrame:
    """The rows of docs (with all columns) that stay: of each group of equal texts one row, whatever its id."""
    told = dedup(docs, broadcast_rows=broadcast_rows, row=row_key(docs)).select("doc_id", "row", F.col("kept").cast("long").alias("copies"))
    return repeat_rows(docs, materialize(told, "told"), broadcast_rows)
