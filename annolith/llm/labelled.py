"""What the two classifiers share: a bounded sample of labelled rows, fitting in one task, calibrated scores."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolith.llm.common import map_batches, release


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus))


def class_counts(labels: DataFrame, target: str, learn: Column) -> tuple[int, int]:
    """Rows of class 0 and 1 among all labelled rows one may learn from."""
    rows = labels.filter(learn).groupBy(F.col(target).alias("y")).agg(F.count(F.lit(1)).alias("n")).filter("y in (0, 1)").collect()
    found = {int(r["y"]): int(r["n"]) for r in rows}
    return found.get(0, 0), found.get(1, 0)


def sample(docs: DataFrame, labels: DataFrame, target: str, learn: Column, per_class: int, seed: int) -> DataFrame:
    """(text, y) of at most per_class labelled rows of each class, those with the smallest seeded hash of their id."""
    labelled = labels.filter(learn).select("doc_id", F.col(target).cast("int").alias("y")).filter("y in (0, 1)")
    order = [F.xxhash64(F.lit(seed), F.col("doc_id")), F.col("doc_id")]
    chosen = reduce(DataFrame.unionByName, [labelled.filter(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)])
    # At most 2 * per_class rows of two numbers: a proven bound for the broadcast. An id that several rows have (or that
    # is labelled twice) counts once, with the text of the smallest hash, so that the bound holds for texts as well.
    found = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by(F.struct("text", "y"), F.struct(F.xxhash64("text"), "y")).alias("r")).select("doc_id", "r.text", "r.y")


def fit_in_tasks(rows: DataFrame, fit: Callable[[pd.DataFrame, int], dict[str, np.ndarray]], parts: int = 1) -> dict[int, dict[str, np.ndarray]]:
    """fit(all rows, part) for each part, each in a task of its own over a sample of bounded size; only what it returns
    comes to the driver. Every task sees the rows in the same order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = list(frames)
        frame = pd.concat(whole, ignore_index=True) if whole else None
        del whole
        if frame is not None and len(frame):
            frame = frame.sort_values("doc_id", ignore_index=True)
            for part, own in frame.groupby("part"):
                out = io.BytesIO()
                np.savez(out, **fit(own.reset_index(drop=True), int(part)))
                yield pd.DataFrame({"part": [part], "model": [out.getvalue()]})
        del frame
        release()

    # Numbers whose hashes lie in different partitions stand for the parts, so that no task gets two.
    spread = rows.sparkSession.range(200 * parts).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("p")).agg(F.min("id").alias("id")).collect()
    told = F.create_map(*(c for r in spread for c in (F.lit(int(r["p"])), F.lit(int(r["id"])).cast("long"))))
    dealt = rows.withColumn("part", F.explode(F.array(*map(F.lit, range(parts))))).repartition(parts, told[F.col("part")])
    found: dict[int, dict[str, np.ndarray]] = {}
    for row in dealt.mapInPandas(run, "part int, model binary").collect():
        with np.load(io.BytesIO(bytes(row["model"]))) as stored:
            found[row["part"]] = {k: stored[k] for k in stored.files}
    return found


def calibrate(margins: np.ndarray, y: np.ndarray, prior: tuple[int, int]) -> tuple[float, float]:
    """(a, c) of sigmoid(a * margin + c), with the classes weighted as in all labelled rows.

    Score 0.5 lies where the most rows are told apart (in the middle, if several places are as good): a few rows with
    a wrong label do not move it, as they would move a logistic fit. The slope is then a logistic fit's.
    """
    n1 = max(1, int(y.sum()))
    n0 = max(1, len(y) - n1)
    total = max(1, sum(prior))
    weight = np.where(y == 1, prior[1] / total / n1, prior[0] / total / n0)
    order = np.argsort(margins, kind="stable")
    m, signed = margins[order], np.where(y[order] == 1, -1.0, 1.0) * weight[order]
    gain = np.concatenate([[0.0], np.cumsum(signed)])  # of calling the first k rows class 0
    edges = np.concatenate([[m[0] - 1], (m[1:] + m[:-1]) / 2, [m[-1] + 1]])
    usable = np.concatenate([[True], m[1:] > m[:-1], [True]])
    best = np.flatnonzero(usable & (gain >= gain[usable].max() - 1e-12))
    at = float(edges[best[len(best) // 2]])
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, slope = margins - at, 1.0 / (np.abs(margins - at).mean() + 1e-9)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(slope * x, -30, 30)))
        step = (weight * (p - goal) * x).sum() / ((weight * p * (1 - p) * x**2).sum() + 1e-9)
        slope = min(max(slope - step, slope / 3, 1e-6), slope * 3)
        if abs(step) < 1e-9:
            break
    return slope, -slope * at


def scored(docs: DataFrame, modulus: int, held: int, score: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. score: whole texts to probabilities."""

    def make(cols: dict[str, list]) -> dict[str, list]:
        p = [float(x) for x in score([t or "" for t in cols["text"]])]
        return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "score": p, "predicted": [int(x >= 0.5) for x in p]}

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_batches(base, make, "doc_id long, held_out boolean, score double, predicted int")
