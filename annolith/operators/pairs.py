"""Analytic pair views: which entries of a book and type are near each other, by a binned join.

Equal bins join; a pair is kept in one bin only. A busy book is so cut into bins, and no pair outside a bin is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolith.functions.similarity import Side

FIELDS = {"start": "start_pos", "end": "end_pos", "content": "content", "date": "date_obj", "type": "type", "seq": "seq"}


def _sides(entries: DataFrame, bins: Column, low: Column, extra: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    rows = entries.withColumns({"bin": F.explode(bins), "low_bin": low} | extra)
    made = []
    for side in ("old", "new"):
        columns = [F.col(c).alias(f"{side}_{n}") for n, c in FIELDS.items()] + [F.col(c).alias(f"{side}_{c}") for c in ("low_bin", *extra)]
        made.append(rows.select("analysis_id", "book_key", F.col("type").alias("kind"), "bin", *columns))
    return made[0], made[1]


def _joined(old: DataFrame, new: DataFrame) -> DataFrame:
    pairs = old.join(new, ["analysis_id", "book_key", "kind", "bin"]).filter("old_seq < new_seq")
    return pairs.filter(F.col("bin") == F.greatest("old_low_bin", "new_low_bin"))


def overlapping(entries: DataFrame, width: int = 64, extra: dict[str, Column] | None = None) -> DataFrame:
    """Pairs whose ranges touch: columns old_* and new_*."""
    low, high = F.least("start_pos", "end_pos"), F.greatest("start_pos", "end_pos")
    first, last = F.floor(low / width), F.floor(high / width)
    placed = entries.filter(F.col("start_pos").isNotNull() & F.col("end_pos").isNotNull())
    a, b = Side("new"), Side("old")
    pairs = _joined(*_sides(placed, F.sequence(first, last), first, extra or {}))
    return pairs.filter((a.low() <= b.high()) & (b.low() <= a.high()))


def in_session(entries: DataFrame, minutes: float) -> DataFrame:
    """Pairs of dated entries at most so many minutes apart."""
    width = int(minutes * 60_000_000)
    place = F.floor(F.unix_micros(F.col("date_obj").cast("timestamp")) / width)
    dated = entries.filter(F.col("date_obj").isNotNull())
    rows = dated.withColumn("low_bin", place)
    # The later of two entries at most a width apart is in the bin of the earlier or the next.
    pairs = _joined(*_sides(rows.drop("low_bin"), F.sequence(place, place + 1), place, {}))
    from annolith.functions.similarity import within_session

    return pairs.filter(within_session(Side("new"), Side("old"), minutes))


def within_books(entries: DataFrame, extra: dict[str, Column] | None = None, block: int = 1000) -> DataFrame:
    """All pairs of a book and type. A book of more than `block` entries is cut into blocks, and each two blocks meet in a
    cell of their own, so that no task gets a whole book."""
    book = ["analysis_id", "book_key", "type"]
    blocks = entries.groupBy(*book).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    rows = entries.join(blocks, book).withColumn("_own", F.pmod(F.xxhash64("seq"), F.col("_blocks")).cast("int"))
    cell = lambda a, b: F.least(a, b) * F.col("_blocks") + F.greatest(a, b)
    cells = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda other: cell(F.col("_own"), other))
    old, new = _sides(rows, cells, F.col("_own"), (extra or {}) | {"blocks": F.col("_blocks")})
    pairs = old.join(new, ["analysis_id", "book_key", "kind", "bin"]).filter("old_seq < new_seq")
    # Two entries of one block meet in all its cells: only the one on the diagonal counts.
    low, high = F.least("old_low_bin", "new_low_bin"), F.greatest("old_low_bin", "new_low_bin")
    return pairs.filter(F.col("bin") == low * F.col("old_blocks") + high).drop("old_blocks", "new_blocks")
