"""Nearest neighbours against brute force: exact on small tables, recall on larger ones, edge cases."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

pytest.importorskip("annolith.llm")
from annolith.llm import neighbours  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, node long, g long, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, x, 0, 1, 2, "clash") for i, x in rows], SCHEMA).repartition(3)


def brute(rows, every=20, k=20):
    ok = [(i, x) for i, x in rows if x and len(x) == 3 and all(c is not None and math.isfinite(c) for c in x) and any(x)]
    out = []
    for a, (i, x) in enumerate(ok):
        if i is not None and i % every == 0:
            near = sorted((-sum(p * q for p, q in zip(x, y)), j is None, j or 0) for b, (j, y) in enumerate(ok) if b != a)[:k]
            out += [(i, r, None if none else j, round(-s, 6)) for r, (s, none, j) in enumerate(near, 1)]
    return sorted(map(str, out))


def test_small_tables_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.5, 1.0, 2.0]) for _ in range(3)]) for i in range(130)]
    rows += [(i, [1.0, 1.0, 1.0]) for i in range(200, 260)]  # one common vector: ties go to smaller ids
    rows += [(300, None), (320, [0.0, 0.0, 0.0]), (340, [1.0, None, 1.0]), (360, [1.0, float("nan"), 1.0]), (380, [float("inf"), 1.0, 1.0]), (400, [1.0]), (None, [1.0, 1.0, 1.0]), (40, [2.0, 2.0, 2.0])]
    got = neighbours.nearest(table(spark, rows)).collect()
    assert sorted(str((r.query_id, r.rank, r.vec_id, round(r.score, 6))) for r in got) == brute(rows)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (1, [1.0, 0.0, 0.0]), (20, [0.0, 1.0, 0.0])]
    got = neighbours.nearest(table(spark, rows)).collect()
    assert sorted(str((r.query_id, r.rank, r.vec_id, round(r.score, 6))) for r in got) == brute(rows)
    assert neighbours.nearest(table(spark, [(0, [1.0, 2.0, 3.0])])).count() == 0
    assert neighbours.nearest(table(spark, [])).count() == 0


def recall(vectors, found, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 512):
    """Share of the true k nearest in found, by brute force: blocks of the stated queries against all rows."""
    rows = neighbours._rows(vectors, id_col, vector_col)
    asked = rows.filter(F.col("vec_id") % every == 0).withColumn("b", F.floor(F.row_number().over(Window.orderBy("vec_id")) / block))
    blocks = asked.groupBy("b").agg(F.collect_list(F.struct("vec_id", "v")).alias("qs")).collect()
    hits = total = 0
    for b in blocks:
        ids, q = [r["vec_id"] for r in b["qs"]], neighbours._matrix([bytes(r["v"]) for r in b["qs"]], np.float64)

        def scan(frames, ids=ids, q=q):
            for frame in frames:
                if len(frame):
                    sim = neighbours._matrix(frame["v"], np.float64) @ q.T
                    own = frame["vec_id"].to_numpy()
                    for j, i in enumerate(ids):
                        s = np.where(own == i, -np.inf, sim[:, j])
                        top = np.argsort(-s, kind="stable")[:k]
                        top = top[np.isfinite(s[top])]
                        yield pd.DataFrame({"query_id": i, "vec_id": own[top], "score": s[top]})

        top = rows.mapInPandas(scan, "query_id long, vec_id long, score double")
        top = top.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k)
        total += top.count()
        hits += top.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"]).count()
    return hits / total if total else 1.0


def test_recall_over_many_groups(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "GROUP", 400)
    monkeypatch.setattr(neighbours, "BLOCK", 150)
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(3000)]
    rows = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    found = neighbours.nearest(rows, every=100)
    assert found.count() == 600
    assert recall(rows, found, every=100) >= 0.95


def test_long_vectors_are_hubs_that_no_group_is_asked_for(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "GROUP", 300)
    monkeypatch.setattr(neighbours, "BLOCK", 150)
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) * (100 if i % 250 == 7 else 1) for _ in range(16)]) for i in range(2500)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    seen = []
    monkeypatch.setattr(neighbours, "find_hubs", lambda *a, own=neighbours.find_hubs: seen.append(own(*a)) or seen[-1])
    found = neighbours.nearest(table, every=50)
    assert recall(table, found, every=50) >= 0.95
    hubs = seen[0]
    assert len(hubs.ids) >= 10 and np.sort(np.linalg.norm(hubs.x, axis=1))[-10:].min() > 100
    held = type("B", (), {"value": hubs})
    pool = pd.DataFrame({"node": [-1], "ids": [np.append(hubs.ids[:5], [-2, -3]).tobytes()], "done": [b"\0" * 7]})
    asked = pd.concat(list(neighbours._frontier(held, 7)([pool])))
    assert sorted(x for b in asked["ids"] for x in neighbours._ints(b).tolist()) == [-3, -2]
    (near,) = list(neighbours._hub_lists(held)([pool]))
    assert set(neighbours._ints(near["ids"][0]).tolist()) == {x for b in hubs.lists[:5] for x in neighbours._ints(b).tolist()}


def test_halves_keep_three_digits_at_any_scale():
    x = np.random.default_rng(1).normal(size=(50, 8)) * np.logspace(-20, 20, 50)[:, None]
    back = neighbours._singles(b"".join(neighbours._halves(x)), 50)
    assert (np.abs(back - x) <= 6e-4 * np.abs(x).max(axis=1, keepdims=True)).all()
