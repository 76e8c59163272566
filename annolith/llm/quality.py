"""Quality classifier: Naive Bayes support vectors.

Features are indicators of hashed n-grams: character n-grams (1 to 3 bytes), and n-grams of word shapes (case, closing
marks, digits, length, repeat of the word before), the latter once for each rate from 1/2 down to 1/128 of the words
that they reach. Indicators are scaled by the classes' log-count ratio, then a linear hinge-loss model is fitted by
dual coordinate descent. Scores are calibrated to the class shares of all labelled rows.

The fit uses at most `per_class` labelled rows of each class (a documented bound; those with the smallest seeded hash).
Null text counts as empty; empty text gets a score like any other. Without labelled rows of both classes every score
is the smoothed share of class 1. Repeated rows score alike; an empty table gives an empty result; columns that are
not named (labels, lang, source, doc_id among them) never enter a score. Long texts are read whole.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolith.llm import labelled
from annolith.llm.common import CACHES, release

BITS = 18
RATES = 7
MODULUS, HELD = 3, 1
PER_CLASS = 6000


class _Shapes(dict):
    """Word (bytes) to the hash of its shape; kept while it has fewer than `most` words."""

    most = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        text = word.decode("utf-8", "replace")
        core = text.rstrip(_CLOSERS)
        if core.isalpha():  # most words: letters, then perhaps closing marks
            tail, digit = text[len(core) :][:3], False
        else:
            marks = "".join(c for c in set(text) if not c.isalnum())
            core = text.strip(marks)
            tail = text[len(text.rstrip(marks)) :][:3]
            digit = any(c.isdigit() for c in core)
        case = "l" if core.islower() else "u" if core.isupper() and len(core) > 1 else "c" if core[:1].isupper() and core[1:].islower() else "m" if any(c.isalpha() for c in core) else "n"
        shape = f"{case}{'d' if digit else ''}{bisect_left(_SIZES, len(core))}{tail}"
        self[word] = value = zlib.crc32(shape.encode())
        return value


#: Marks that often close a word.
_CLOSERS = ".,;:!?*$&%#|)\"'"
_SIZES = (0, 1, 3, 6, 11, 19)
_SHAPES = _Shapes()
CACHES.append(_SHAPES)
_FLAGS = np.zeros(1 << BITS, bool)


def _mix(values: np.ndarray) -> np.ndarray:
    return (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


def features(text: str) -> np.ndarray:
    """Sorted distinct feature numbers (below 2 ** BITS) of a text."""
    data = text.encode("utf-8", "replace")
    found = []
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    gram = raw + np.uint64(1 << 40)
    for n in (1, 2, 3):
        if len(raw) >= n:
            if n > 1:
                gram = gram[: len(raw) - n + 1] * np.uint64(256) + raw[n - 1 :]
            found.append(_mix(gram))
    words = data.split()
    if words:
        shapes = np.fromiter(map(_SHAPES.__getitem__, words), np.uint64, len(words))
        again = np.fromiter((a == b for a, b in zip(words, words[1:], strict=False)), np.uint64, len(words) - 1)
        shapes[1:] += again << np.uint64(33)
        for n, grams in ((1, shapes), (2, shapes[:-1] * np.uint64(1000003) + shapes[1:] if len(words) > 1 else shapes[:0])):
            distinct, counts = np.unique(grams, return_counts=True)
            level = np.floor(np.log2(len(words) / counts)).astype(np.int64)
            for k in range(RATES):
                found.append(_mix(distinct[level <= k] * np.uint64(31) + np.uint64((n << 60) + (k << 50))))
    found.append(_mix(np.array([1 << 62, (1 << 62) + 1 + min(len(words).bit_length(), 20)], np.uint64)))
    for f in found:
        _FLAGS[f.astype(np.int64)] = True
    out = np.flatnonzero(_FLAGS).astype(np.int32)
    _FLAGS[out] = False
    return out


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    counts = np.full((2, 1 << BITS), alpha)
    for row, label in zip(rows, y, strict=True):
        counts[label, row] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    ratio[counts.sum(axis=0) < 2 * alpha + 3] = 0  # seen in fewer than three rows
    return ratio


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 3) -> np.ndarray:
    """Weights of the L1-loss linear SVM; a row's alpha stays within [0, its cost]."""
    w, alpha = np.zeros((1 << BITS) + 1), np.zeros(len(rows))
    norms = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    bias = 1 << BITS
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            g = sign[i] * (w[rows[i]] @ values[i] + w[bias]) - 1
            new = min(max(alpha[i] - g / norms[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[rows[i]] += step * values[i]
                w[bias] += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def _scaled(row: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    v = ratio[row].astype(np.float32)
    return v / np.float32(np.linalg.norm(v) + 1e-9)


def fit_rows(rows: list[np.ndarray], y: np.ndarray, prior: tuple[int, int]) -> dict[str, np.ndarray]:
    ratio = log_count_ratio(rows, y)
    values = [_scaled(r, ratio) for r in rows]
    share = np.bincount(y, minlength=2) / len(y)
    w = dual_coordinate_descent(rows, values, np.where(y == 1, 1.0, -1.0), 0.5 / share[y])
    # Calibrated on folds that the model has not seen, so that its scores are no surer than it is.
    fold = np.arange(len(rows)) % 3
    margins = np.zeros(len(rows))
    for k in range(3):
        inside = np.flatnonzero(fold != k)
        r = log_count_ratio([rows[i] for i in inside], y[inside])
        wk = dual_coordinate_descent([rows[i] for i in inside], [_scaled(rows[i], r) for i in inside], np.where(y[inside] == 1, 1.0, -1.0), 0.5 / share[y[inside]], epochs=6)
        for i in np.flatnonzero(fold == k):
            margins[i] = wk[rows[i]] @ _scaled(rows[i], r) + wk[-1]
    a, c = labelled.calibrate(margins, y, prior)
    return {"ratio": ratio.astype(np.float32), "weights": w.astype(np.float32), "line": np.array([a, c])}


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", per_class: int = PER_CLASS, seed: int = 11) -> dict[str, np.ndarray]:
    """The model: log-count ratios, weights, calibration line; or only the prior, if a class has no rows."""
    learn = labelled.remainder(F.col("doc_id"), MODULUS) != HELD
    prior = labelled.class_counts(labels, target, learn)
    share = np.array([(prior[1] + 1) / (sum(prior) + 2)])
    if not min(prior):
        return {"prior": share}

    def featurise(frames):
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "y": frame["y"], "features": [features(t).tobytes() for t in frame["text"]]})
        release()

    def fit(frame: pd.DataFrame, part: int) -> dict[str, np.ndarray]:
        y = frame["y"].to_numpy(np.int64)
        return fit_rows([np.frombuffer(b, np.int32) for b in frame["features"]], y, prior) if len(set(y.tolist())) == 2 else {}

    chosen = labelled.sample(docs, labels, target, learn, per_class, seed).mapInPandas(featurise, "doc_id long, y int, features binary")
    return labelled.fit_in_tasks(chosen, fit).get(0) or {"prior": share}


def score_texts(model: dict[str, np.ndarray], texts: list[str]) -> np.ndarray:
    if "prior" in model:
        return np.full(len(texts), model["prior"][0])
    ratio, w, (a, c) = model["ratio"], model["weights"], model["line"]
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        row = features(text)
        out[i] = w[row] @ _scaled(row, ratio) + w[-1]
    return 1 / (1 + np.exp(-np.clip(a * out + c, -30, 30)))


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class=per_class))  # two arrays of 2 ** BITS
    return labelled.scored(docs, MODULUS, HELD, lambda texts: score_texts(model.value, texts))


def keep_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts, scored in place: nothing is shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score_texts(model.value, [t or "" for t in texts]))
        release()

    return docs.filter(score(F.col("text")) >= 0.5)
