"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is what stands between white space, without marks at its ends; digits and marks inside stay, and digits and
marks that stand for letters are read as those. It is the bag of its hashed character n-grams (3 to 6 bytes of the
lower-cased word between < and >, and the word itself), so unseen misspellings share vectors with the words they
resemble. Embeddings are averaged over a word, words over windows of consecutive words, and these go through a linear
softmax; a text is as toxic as its most toxic window, in training too. Windows cover the whole text.

The fit uses at most `per_class` labelled rows of each class (a documented bound; those with the smallest seeded hash).
The model is fitted on all of them; its scores are calibrated on the margins of FOLDS further models, each for the rows
that it has not seen. Those models are fitted in parallel tasks.
Null text counts as empty; a text without words has the score of an empty window. Without labelled rows of both
classes every score is the smoothed share of class 1. Repeated rows score alike; an empty table gives an empty result;
columns that are not named never enter a score.
"""

from __future__ import annotations

import re
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolith.llm import labelled
from annolith.llm.common import CACHES

BITS, DIM, WINDOW = 17, 8, 6
ORDERS = (3, 4, 5, 6)
MODULUS, HELD = 5, 0
PER_CLASS = 6000
FOLDS = 4
#: From the first letter or digit to the last one before white space.
WORD = re.compile(r"[^\W_](?:\S*[^\W_])?")
#: Digits and marks that stand for letters inside a word.
LOOKS_LIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})


def spelled(word: str) -> str:
    """The word as its n-grams see it; empty where it holds no letter (a number is no word)."""
    if word.isalpha():
        return word
    return word.translate(LOOKS_LIKE) if any(c.isalpha() for c in word) else ""


class _Spellings(dict):
    most = 200_000

    def __missing__(self, word: str) -> str:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = spelled(word)
        return value


_SPELLINGS = _Spellings()
CACHES.append(_SPELLINGS)


def words_of(text: str) -> list[str]:
    """Lower-cased words; a word said many times in a row counts once, else it would fill a window alone."""
    return [word for word, _ in groupby(map(_SPELLINGS.__getitem__, WORD.findall(text.lower()))) if word]


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, words in order; where each word's n-grams begin), for all words at once."""
    joined = [b"<" + w.encode("utf-8", "replace") + b">" for w in words]
    sizes = np.array([len(w) for w in joined], np.int64)
    raw = np.frombuffer(b"".join(joined), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    prime, spread = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
    owners, buckets = [], []
    value = raw + np.uint64(1)
    for n in range(2, max(ORDERS) + 1):
        value = value[:-1] * prime + raw[n - 1 :] + np.uint64(1) if len(value) > 1 else value[:0]
        if n in ORDERS and len(value):
            inside = owner[: len(value)] == owner[n - 1 :]
            owners.append(owner[: len(value)][inside])
            buckets.append((value[inside] * spread) >> np.uint64(64 - BITS))
    power = prime ** np.arange(64, dtype=np.uint64)
    place = np.arange(len(raw)) - np.repeat(ends - sizes, sizes)
    whole = np.add.reduceat((raw + np.uint64(7)) * power[place % 64], ends - sizes) if len(words) else raw
    owners.append(np.arange(len(words)))
    buckets.append((whole * spread + np.uint64(0xABCDEF)) >> np.uint64(64 - BITS))
    owners_, buckets_ = np.concatenate(owners), np.concatenate(buckets).astype(np.int64)
    order = np.argsort(owners_, kind="stable")
    starts = np.searchsorted(owners_[order], np.arange(len(words)))
    return buckets_[order], starts


def _windows(n_words: int) -> np.ndarray:
    """Starts of the windows: half overlapping, so that a short insult lies whole in one of them."""
    return np.arange(0, max(1, n_words - WINDOW // 2), WINDOW // 2)


def _window_means(values: np.ndarray) -> np.ndarray:
    """Means of values (words first) over each window."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    starts = _windows(len(values))
    ends = np.minimum(starts + WINDOW, len(values))
    return (total[ends] - total[starts]) / (ends - starts)


class _Bags:
    """The n-grams of a list of words, and means of what n-grams have over the words' bags."""

    chunk = 20_000  # words that are cut into n-grams at once

    def __init__(self, words: list[str]):
        parts = [(b.astype(np.int32), np.diff(np.append(s, len(b)))) for b, s in (subwords(words[at : at + self.chunk]) for at in range(0, len(words), self.chunk))]
        self.buckets = np.concatenate([b for b, _ in parts]) if parts else np.zeros(0, np.int32)
        self.counts = np.concatenate([n for _, n in parts]) if parts else np.zeros(0, np.int64)
        self.starts = np.cumsum(self.counts) - self.counts

    def places(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(buckets of the words, where each word's begin)."""
        n = self.counts[which]
        first = np.concatenate(([0], np.cumsum(n)[:-1]))
        return self.buckets[np.repeat(self.starts[which] - first, n) + np.arange(n.sum())], first

    def means(self, table: np.ndarray, which: np.ndarray) -> np.ndarray:
        found, first = self.places(which)
        n = self.counts[which]
        return np.add.reduceat(table[found], first, axis=0) / (n if table.ndim == 1 else n[:, None])


def train_texts(texts: list[str], y: np.ndarray, epochs: int = 6, steps: int = 300, batch: int = 32, rate: float = 0.5, seed: int = 13, refresh: int = 16) -> dict[str, np.ndarray]:
    """Embeddings and softmax, trained together by sparse Adagrad on each text's most toxic window, for that many epochs,
    or more if there would be fewer steps (batches).

    Which window that is, is looked up for `refresh` batches at a time; gradients are always those of the model as it is.
    """
    rng = np.random.default_rng(seed)
    place: dict[str, int] = {}
    docs = [np.array([place.setdefault(w, len(place)) for w in words_of(t)], np.int64) for t in texts]
    bags = _Bags(list(place))
    table = rng.normal(0, 1 / DIM, (1 << BITS, DIM))
    soft, bias = rng.normal(0, 1 / DIM, (DIM, 2)), np.zeros(2)
    seen_table, seen_soft, seen_bias = np.full(1 << BITS, 1e-6), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    balance = len(y) / (2 * np.maximum(1, np.bincount(y, minlength=2)))
    known, score = np.zeros(len(place), bool), np.zeros(len(place))
    usable = np.array([i for i, d in enumerate(docs) if len(d)], np.int64)

    def most_toxic(some: np.ndarray) -> list[np.ndarray]:
        """The words of each text's most toxic window."""
        for i in some:
            known[docs[i]] = True
        words = np.flatnonzero(known)
        known[words] = False
        score[words] = bags.means(table @ (soft[:, 1] - soft[:, 0]), words)
        first = [int(_windows(len(docs[i]))[np.argmax(_window_means(score[docs[i]]))]) for i in some]
        return [docs[i][at : at + WINDOW] for i, at in zip(some, first, strict=True)]

    for _ in range(max(epochs, steps * batch // max(1, len(usable)))):
        order = rng.permutation(usable)
        for block in (order[at : at + batch * refresh] for at in range(0, len(order), batch * refresh)):
            chosen = most_toxic(block)
            for at in range(0, len(block), batch):
                windows, label = chosen[at : at + batch], y[block[at : at + batch]]
                sizes = np.array([len(w) for w in windows])
                words = np.concatenate(windows)
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                mean = np.add.reduceat(bags.means(table, words), starts, axis=0) / sizes[:, None]
                logit = mean @ soft + bias
                p = np.exp(logit - logit.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(label)), label] -= 1
                p *= balance[label][:, None]
                g_soft, g_bias = mean.T @ p / len(label), p.mean(axis=0)
                each = np.repeat(p @ soft.T / sizes[:, None], sizes, axis=0) / bags.counts[words][:, None]
                found, _ = bags.places(words)
                rows, back = np.unique(found, return_inverse=True)
                each = np.repeat(each, bags.counts[words], axis=0)
                total = np.stack([np.bincount(back, each[:, d], len(rows)) for d in range(DIM)], axis=1)
                seen_table[rows] += (total**2).mean(axis=1)
                table[rows] -= rate * total / np.sqrt(seen_table[rows])[:, None]
                seen_soft += g_soft**2
                seen_bias += g_bias**2
                soft -= 0.1 * g_soft / np.sqrt(seen_soft)
                bias -= 0.1 * g_bias / np.sqrt(seen_bias)
    return {"table": table.astype(np.float32), "soft": soft, "bias": bias}


class Scorer:
    """Margins of whole texts. Each word's margin is computed once and kept while there are fewer than `most`."""

    most = 200_000

    def __init__(self, model: dict[str, np.ndarray]):
        direction = model["soft"][:, 1] - model["soft"][:, 0]
        self.flat = model["table"].astype(np.float64) @ direction  # of each bucket, as the softmax sees it
        self.bias = float(model["bias"][1] - model["bias"][0])
        self.known: dict[str, float] = {}

    def margins(self, texts: list[str]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        if len(self.known) > self.most:
            self.known.clear()
        new = list({w for words in split for w in words if w not in self.known})
        for at in range(0, len(new), 50_000):
            some = new[at : at + 50_000]
            self.known.update(zip(some, _Bags(some).means(self.flat, np.arange(len(some))).tolist(), strict=True))
        out = np.full(len(texts), self.bias)
        for i, words in enumerate(split):
            if words:
                out[i] += _window_means(np.fromiter(map(self.known.__getitem__, words), float, len(words))).max()
        return out


def fold_of(rows: int, seed: int = 13) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, FOLDS, rows)


def fit_part(texts: list[str], y: np.ndarray, part: int) -> dict[str, np.ndarray]:
    """Part FOLDS is the model of all rows; a lower one gives the margins of its fold's rows by a model of all others."""
    if part == FOLDS:
        return train_texts(texts, y)
    fold = fold_of(len(texts))
    inside, outside = np.flatnonzero(fold != part), np.flatnonzero(fold == part)
    if not len(outside) or len(set(y[inside].tolist())) < 2:
        return {}
    model = train_texts([texts[i] for i in inside], y[inside])
    return {"margins": Scorer(model).margins([texts[i] for i in outside]), "y": y[outside]}


def calibrated(parts: dict[int, dict[str, np.ndarray]], prior: tuple[int, int]) -> dict[str, np.ndarray]:
    """The model of all rows with its line, by the margins of rows that the models in question have not seen.

    Where those hold one class only (a handful of rows), the line is one through the margins of the centre: 0.
    """
    model, folds = parts[FOLDS], [p for k, p in sorted(parts.items()) if k < FOLDS and len(p)]
    margins, y = (np.concatenate([p[c] for p in folds]) if folds else np.zeros(0) for c in ("margins", "y"))
    both = len(set(y.tolist())) == 2
    return model | {"line": np.array(labelled.calibrate(margins, y.astype(np.int64), prior) if both else (1.0, 0.0))}


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", per_class: int = PER_CLASS, seed: int = 19) -> dict[str, np.ndarray]:
    learn = labelled.remainder(F.col("doc_id"), MODULUS) != HELD
    prior = labelled.class_counts(labels, target, learn)
    share = np.array([(prior[1] + 1) / (sum(prior) + 2)])
    if not min(prior):
        return {"prior": share}

    def fit(frame: pd.DataFrame, part: int) -> dict[str, np.ndarray]:
        y = frame["y"].to_numpy(np.int64)
        return fit_part(frame["text"].tolist(), y, part) if len(set(y.tolist())) == 2 else {}

    rows = labelled.sample(docs, labels, target, learn, per_class, seed)
    parts = labelled.fit_in_tasks(rows, fit, FOLDS + 1)
    return calibrated(parts, prior) if parts.get(FOLDS) else {"prior": share}


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class=per_class))  # 2 ** BITS vectors of DIM
    kept: list[Scorer] = []

    def score(texts: list[str]) -> np.ndarray:
        if "prior" in model.value:
            return np.full(len(texts), model.value["prior"][0])
        if not kept:
            kept.append(Scorer(model.value))
        a, c = model.value["line"]
        return 1 / (1 + np.exp(-np.clip(a * kept[0].margins(texts) + c, -30, 30)))

    return labelled.scored(docs, MODULUS, HELD, score)
