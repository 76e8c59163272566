"""The search index against a scan, and what it reads."""

import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from annolith.operators import search, selection

SCHEMA = "seq long, type string, content string, row long, run string, text int"


def table(spark, n=300):
    rng = random.Random(2)
    words = ["Größe", "ação", "sol", "İ", "mar", "日本語", "the", "𝒳y", "a", "tion", "lua-rio"]
    rows = [(i, rng.choice(["note", "highlight"]), rng.choice([None, "", "ab", " ".join(rng.choices(words, k=rng.randrange(1, 40)))]) if rng.random() < 0.3 else " ".join(rng.choices(words, k=9)), 1, "r", 2) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("text", ["", " ", "a", "so", "SOL", "tion the", "größe", "ação sol mar lua-rio", "日本語", "𝒳y a", "nowhere", "the the the the the", "sol mar lua-rio the tion a größe ação sol"])
def test_index_equals_a_scan(spark, tmp_path_factory, text):
    path = tmp_path_factory.getbasetemp() / "index"
    entries = table(spark)
    index = search.SearchIndex(spark, str(path))
    if not path.exists():
        index.build(entries)
    for kind in (None, "note"):
        got = index.search(text, kind)
        assert got.columns == entries.columns
        assert sorted(r.seq for r in got.collect()) == sorted(r.seq for r in selection.search_entries(entries, kind, text).collect())


def test_runs_of_batches_and_their_bound():
    import pyarrow as pa

    texts = ["abcd", "", "ab", "xabc", "zzzzz"]
    batch = pa.RecordBatch.from_pydict({"row": list(range(5)), "text": texts})
    for most in (1, 1000):
        found: dict[str, list[int]] = {}
        for out in search._inverted(iter([batch]), most):
            for run, rows in zip(out.column("run").to_pylist(), out.column("rows").to_pylist()):
                found.setdefault(run, []).extend(rows)
        assert found == {"abc": [0, 3], "bcd": [0], "xab": [3], "zzz": [4]}
    assert set(search.asked("abcdefghijklmnop")) <= search.runs("abcdefghijklmnop") and 4 <= len(search.asked("abcdefghijklmnop")) <= search.ASKED


def test_a_rare_search_reads_few_row_groups(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "note", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=400)) + (" Zürich" if i == 77 else ""), 0, "", 0) for i in range(2500)]
    index = search.SearchIndex(spark, str(tmp_path / "index")).build(spark.createDataFrame(rows, SCHEMA), 1 << 12)
    assert [r.seq for r in index.search("zürich").collect()] == [77]
    wanted, read, there = search.asked("zürich"), 0, 0
    for file in Path(tmp_path / "index/runs").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for i in range(meta.num_row_groups):
            column = next(meta.row_group(i).column(c) for c in range(meta.num_columns) if meta.row_group(i).column(c).path_in_schema == "run")
            there += 1
            read += any(column.statistics.min <= w <= column.statistics.max for w in wanted)
    assert there > 40 and read <= max(len(wanted), 0.1 * there)
    plan = index.candidates("zürich")._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "In(run" in plan
