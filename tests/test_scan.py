"""Files read by ranges against the same files read whole."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from annolith.sources import clippings, scan


@pytest.fixture
def small_ranges(spark):
    """Ranges of 200 bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k) if k not in old else spark.conf.set(k, old[k])


def bodies():
    rng = random.Random(4)
    parts = ["\n", "==========", "==========\r\n", "===========", "====================", "=====", "título (É)\n", "日本 \n\n", " ", "long " * 90, "\r", "a\n"]
    made = ["".join(rng.choices(parts, k=rng.randrange(1, 120))) for _ in range(25)]
    return [*made, "", "\n", "x", "==========", "no end\n==========\nlast", "\n" * 500, "y" * 3000]


def test_segments_are_those_of_whole_files(spark, tmp_path, small_ranges):
    want, sums = set(), {}
    for i, body in enumerate(bodies()):
        (tmp_path / f"f{i}.txt").write_bytes(body.encode())
        want |= {(f"f{i}.txt", k, piece) for k, piece in enumerate(body.split(clippings.DELIMITER))}
        if body:
            sums[f"f{i}.txt"] = (len(body.encode()), hashlib.sha1(body.encode()).hexdigest())
    (tmp_path / "bad.txt").write_bytes(b"fine\n==========\n" + b"\xff\xfe" + b"\n==========\nx" * 60)
    name = F.element_at(F.split("path", "/"), -1)
    read = scan.Scan(spark, str(tmp_path))
    assert scan._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 60
    got = read.segments().select(name.alias("name"), "seq", "raw").collect()
    whole = clippings.segments(clippings.read_uploads(spark, str(tmp_path)).withColumn("analysis_id", name)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole)) and {(r.name, r.seq) for r in got} <= {w[:2] for w in want}
    assert [r[0] for r in read.quarantined().select(name).collect()] == ["bad.txt"]
    found = {r.name: (r.size, r.analysis_id) for r in scan.digests(spark, str(tmp_path)).select(name.alias("name"), "size", "analysis_id").collect()}
    bad = found.pop("bad.txt")
    assert found == sums and bad[1] == hashlib.sha1((tmp_path / "bad.txt").read_bytes()).hexdigest()


def test_one_file_is_taken_by_many_tasks(spark, tmp_path, small_ranges):
    (tmp_path / "one.txt").write_text("".join(f"T{i} (A)\n- Seu destaque | posição {i} |\n\ntexto {i}\n==========\n" for i in range(200)))
    read = scan.Scan(spark, str(tmp_path / "one.txt"))
    assert read.pieces.select("start").distinct().count() >= 8
    got = read.segments().orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(200)) and got[150].raw.endswith("texto 150")
