"""The dedup fold over a stream: clippings that arrive as files, slots kept as state by book and type.

The batch fold and this one take the same step for each entry; only where the slots live differs. Entries of a
micro-batch are taken in file order; files that arrive in different micro-batches are taken in order of arrival.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from annolith.operators.dedup import entries_of, step
from annolith.operators.slots import Slots
from annolith.settings import Settings
from annolith.sources.clippings import segments

OUT = "book_key string, type string, seq long, action string, reason string, matched_slot long"


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Segments of the files that arrive at path."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).load(path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return segments(files.select(F.sha1("content").alias("analysis_id"), text.alias("text")))


def fold_stream(entries: DataFrame, settings: Settings) -> DataFrame:
    """A decision for each entry of the stream."""

    def take(key: tuple[str, str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        slots = Slots(settings, pickle.loads(bytes(state.get[0])) if state.exists else ())
        frame = pd.concat(list(frames), ignore_index=True)
        rows = []
        for entry in entries_of(frame):
            action, reason, _, _, slot = step(slots, entry)
            rows.append((*key, entry.seq, action, reason, slot))
        state.update((pickle.dumps(slots.slots),))
        yield pd.DataFrame(rows, columns=["book_key", "type", "seq", "action", "reason", "matched_slot"])

    return entries.groupBy("book_key", "type").applyInPandasWithState(take, OUT, "slots binary", "append", GroupStateTimeout.NoTimeout)
