"""Mixing sources to target weights by fitting a word budget for each source.

Sizes are word counts. A source's budget beyond whole copies is a subset-sum problem over its counts of documents
by exact length: an even share of each length first, then a bounded knapsack (dynamic programming over the remaining
budget). Which documents of a length are taken is decided by a seeded hash, so reruns agree.

Null text has size 0; null source is a source of its own, after all others. Documents of size 0 take 0 words.
Repeated rows count each for itself. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolith.llm.common import BLANK, map_batches, materialize, repeat_rows, row_key, salted_rank, salts_for

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Most words that the knapsack's table has (five bytes each), and most words times choices that it goes through.
WORDS, WORK = 1 << 24, 2_000_000_000


def water_fill(sizes: list[int], weights: list[int], share: Fraction, most: int) -> list[Fraction]:
    """Targets that sum to share * sum(sizes), by weight, none above most * its size."""
    targets, left = [Fraction(0)] * len(sizes), share * sum(sizes)
    open_ = [i for i, s in enumerate(sizes) if s]
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > most * sizes[i]]
        for i in full or open_:
            targets[i] = Fraction(most * sizes[i]) if full else weights[i] * unit
        if not full:
            break
        left -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def _steps(lengths: list[int], counts: list[int], budget: int) -> list[tuple[int, int]]:
    """(length's place, documents) of each choice: counts in powers of two, so that every number can be made."""
    out = []
    for k, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        left, times = min(count, budget // length if length else 0), 1
        while left:
            out.append((k, min(times, left)))
            left, times = left - min(times, left), times * 2
    return out


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take for the largest sum that does not exceed budget, exactly (bounded counts)."""
    steps = _steps(lengths, counts, budget)
    reach = np.zeros(budget + 1, bool)  # sums that can be made
    first = np.zeros(budget + 1, np.int32)  # the choice that made each sum first: all it stands on came before
    reach[0] = True
    for i, (k, n) in enumerate(steps):
        size = n * lengths[k]
        if size > budget:
            continue
        made = reach[:-size] & ~reach[size:]
        first[size:][made] = i
        reach[size:] |= made
        if reach[budget]:
            break
    at, taken = int(np.flatnonzero(reach)[-1]), [0] * len(lengths)
    while at:
        k, n = steps[first[at]]
        taken[k] += n
        at -= n * lengths[k]
    return taken


def fit_budget(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """Documents to take of each length so that their words come as near to budget as it finds, never above.

    An even share of each length, then the knapsack for what is left of the budget. Where that would be more than
    WORK steps (only with thousands of lengths), whole documents from the longest down come between.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    taken = [c * budget // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, taken, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    most = min(WORDS, WORK // max(1, len(_steps(lengths, [c - t for c, t in zip(counts, taken, strict=True)], left))))
    for i in order:
        if left <= most:
            break
        more = min(counts[i] - taken[i], left // lengths[i] if lengths[i] else 0)
        taken[i] += more
        left -= more * lengths[i]
    left = min(left, most)
    usable = [i for i in order if 0 < lengths[i] <= left and counts[i] > taken[i]]
    for i, more in zip(usable, knapsack([lengths[i] for i in usable], [counts[i] - taken[i] for i in usable], left), strict=True):
        taken[i] += more
    return taken


def _sizes(cols: dict[str, list]) -> dict[str, list]:
    return {
        **cols,
        "size": [len((t or "").encode("utf-8", "surrogatepass").split()) for t in cols["text"]],
    }


assert b"".join((b"a" + BLANK + b"b").split()) == b"ab"  # bytes.split() cuts at exactly the white space of the contract


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: str = "1.5", most: int = 2, seed: int = 17, row: Column | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies.

    The driver gets one row per source (the list of sources with their sizes, a registry that does not grow with the
    documents of a source), nothing else. row: what tells rows of one id apart; it comes back as a further column.
    """
    spark = docs.sparkSession
    names = [] if row is None else ["row"]
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), *(row.alias(n) for n in names))
    sized = materialize(map_batches(base, _sizes, f"doc_id long, source string, size long, text_hash long{', row long' if names else ''}"), "sizes")
    sized = sized.withColumn("skey", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    lengths = sized.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n"))
    found = sorted((r["skey"] == "null", r["skey"], int(r["words"])) for r in lengths.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect())
    targets = water_fill([w for _, _, w in found], [weights[i % len(weights)] for i in range(len(found))], Fraction(share), most)
    table = [(k, w, float(t), round(t)) for (_, k, w), t in zip(found, targets, strict=True)]
    plan = spark.createDataFrame(table, "skey string, source_size long, target double, budget long")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size")
        words, counts = [int(x) for x in frame["size"]], [int(x) for x in frame["n"]]
        budget, whole = int(frame["budget"].iloc[0]), int(frame["source_size"].iloc[0])
        base_copies = budget // whole if whole else 0
        extra = fit_budget(words, counts, budget - base_copies * whole) if whole else [0] * len(words)
        return pd.DataFrame({"skey": frame["skey"], "size": np.array(words, np.int64), "base": np.int64(base_copies), "extra": np.array(extra, np.int64)})

    quota = lengths.join(plan, "skey").groupBy("skey").applyInPandas(fit, "skey string, size long, base long, extra long")
    salts = salts_for(sized.count())
    # Slices of the seeded hash order the documents of a length; a hot length is ranked slice by slice, and texts spread
    # those of a repeated or missing id.
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_hash"))
    ranked = salted_rank(sized.withColumn("_h", key), ["skey", "size"], [F.col("_h"), F.col("doc_id").asc_nulls_last(), *names], F.floor((F.shiftrightunsigned("_h", 32) * salts) / F.lit(float(1 << 32))).cast("int"))
    out = ranked.join(quota, ["skey", "size"]).join(plan, "skey")
    copies = F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(F.col("base") + (F.col("rank") < F.col("extra")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), *names)


def mixed_rows(docs: DataFrame, broadcast_rows: int = 250_000) -> DataFrame:
    """The mixture itself: every row of docs as often as it is taken (once or twice by default), none of size 0."""
    told = mix(docs, row=row_key(docs)).select("doc_id", "row", "copies")
    return repeat_rows(docs, materialize(told, "told"), broadcast_rows)
