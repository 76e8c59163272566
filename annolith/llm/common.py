"""What the corpus operators share: shared-folder tables, Arrow batches and salted ranks."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from annolith.session import scratch_folder

#: The white space that every contract here names, and nothing else.
BLANK = b" \t\n\x0b\x0c\r"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later steps neither recompute it nor depend on one executor."""
    return _written(df, scratch_folder(df.sparkSession, name))


class Scratch:
    """Tables of one computation in the shared folder, removed together once what they lead to is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.tables = spark, scratch_folder(spark, name), 0

    def table(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        return _written(df, f"{self.path}/{self.tables}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.remove()

    def remove(self) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Caches of a worker; they are worth their memory within a partition only.
CACHES: list[dict] = []


def release() -> None:
    """Give memory back to the system: workers are reused, and what one step took would count against the next."""
    for cache in CACHES:
        cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


#: Rows and bytes that are Python objects at once; single texts can be very long.
SLICE_ROWS, SLICE_BYTES = 1000, 8 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    step = max(1, min(SLICE_ROWS, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def map_batches(df: DataFrame, make: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """mapInArrow over columns as Python lists; make gets {column: values} and returns the columns of schema.

    Spark bounds an Arrow batch in bytes by itself; here it is cut further, so no session setting is touched.
    """
    spark_schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                got = make({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)
                del got
        release()

    return df.mapInArrow(run, spark_schema)


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns of a row: rows of one id that differ in anything have different keys, equal rows have one.

    Rows are told apart by doc_id and key together, so only rows of one id could clash (chance 2 ** -64 a pair). Values that
    Spark does not hash (maps and variants, also within others) count by their JSON.
    """

    def hashed(field: StructField) -> Column:
        value = F.col(f"`{field.name}`")
        return F.to_json(F.struct(value.alias("v"))) if re.search(r"\bmap<|\bvariant\b", field.dataType.simpleString()) else value

    return F.xxhash64(*(x for field in docs.schema for x in (hashed(field), F.col(f"`{field.name}`").isNull())))


def repeat_rows(docs: DataFrame, told: DataFrame, broadcast_rows: int = 250_000) -> DataFrame:
    """Every row of docs as often as told (doc_id, row: its row_key, copies; one for each row of docs) says, also not at all.

    Null and repeated ids may be any share of the rows, and columns may have any names: a row travels as one struct.
    Rows equal in all columns cannot be told apart; together they are there as often as all of them should be. Up to
    broadcast_rows decisions (24 bytes each; only those other than: once) are broadcast, so that texts are not
    shuffled; with more, Spark joins both sides.
    """
    sums = told.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").cast("long").alias("whole"))
    sums = sums.filter("whole <> n").select(F.col("doc_id").alias("id"), F.col("row").alias("key"), F.expr("whole div n").alias("times"), F.expr("whole % n").alias("over"))
    side = materialize(sums, "copies")
    size, uneven, most = side.agg(F.count(F.lit(1)), F.count_if(F.col("over") > 0), F.max("times")).first()
    rows = docs.select(F.struct(*(F.col(f"`{name}`") for name in docs.columns)).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("key"))
    small = lambda df, n: F.broadcast(df) if n <= broadcast_rows else df
    once = F.lit(1).cast("long")
    out = rows.join(small(side.drop("over"), size), same, "left").select("doc", F.coalesce("times", once).alias("times")).filter("times > 0")
    if (most or 0) > 1:
        out = out.select("doc", F.explode(F.sequence(once, F.col("times"))).alias("copy"))
    out = out.select("doc")
    if uneven:
        # What is over, fewer than there are such rows, is made from one of them, in blocks that any task may take.
        one = rows.join(small(side.filter("over > 0").select("id", "key", "over"), uneven), same)
        one = one.groupBy("id", "key").agg(F.first("doc").alias("doc"), F.first("over").alias("over"))
        one = one.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(over - 1) div 1000")))).repartition("id", "key", "block")
        out = out.unionByName(one.select("doc", F.explode(F.sequence(once, F.least(F.lit(1000).cast("long"), F.expr("over - 1000 * block")))).alias("copy")).select("doc"))
    return out.select("doc.*")


def in_order(df: DataFrame, order: list[Column], scratch: Scratch, sums: tuple[str, ...] = ()) -> DataFrame:
    """df with place, the 0-based place of each row in the order of all rows, and for each column named in sums the sum
    over the rows up to and with this one, as through_<column>.

    Rows are dealt by ranges of the order, sorted there and written; each range starts where the counts of those before it
    end. No key's rows need to meet in a task: where order ends in something unique, a key of any share is cut as well.
    The driver gets a row for each range.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = scratch.table(dealt).withColumn("_range", F.shiftright("_at", 33))
    totals = [F.sum(F.col(c).cast("long")).alias(c) for c in sums]
    starts, before = [], [0] * (1 + len(sums))
    for found in sorted(rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *totals).collect()):
        starts.append((found["_range"], *before))
        before = [x + (y or 0) for x, y in zip(before, found[1:], strict=True)]
    names = ["_start", *(f"_start_{c}" for c in sums)]
    told = df.sparkSession.createDataFrame(starts, ", ".join(f"{n} long" for n in ["_range", *names]))
    rows = rows.join(F.broadcast(told), "_range")
    within = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    through = {f"through_{c}": F.col(f"_start_{c}") + F.coalesce(F.sum(F.col(c).cast("long")).over(within), F.lit(0)) for c in sums}
    rows = rows.withColumns({"place": F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)} | through)
    return rows.drop("_at", "_range", *names)


def salts_for(rows: int) -> int:
    """Salts that keep the share of one salt in a hot key, and the salts of one key, small at any size."""
    return max(64, rows // 250_000)


def salted_rank(df: DataFrame, keys: list[str], order: list[Column], salt: Column, name: str = "rank") -> DataFrame:
    """Rows of df with their 0-based rank among the rows of the same keys, by (salt, *order).

    A key may hold any share of all rows: rows are ranked within (keys, salt), and each salt starts where
    the counts of the salts before it end. Equal rows get different ranks.
    """
    df = df.withColumn("_salt", salt)
    counts = df.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, "_salt").orderBy(*order)
    return (
        df.join(starts, [*keys, "_salt"])
        .withColumn(name, F.col("_start") + F.row_number().over(within) - 1)
        .drop("_salt", "_start")
    )
