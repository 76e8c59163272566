"""A hidden Markov language model of words, trained by Baum-Welch over all training documents.

Every word falls into a bucket by a hash (the end of a text has one of its own); there is a bucket for every KINDS distinct
words, BUCKETS at most, so that few buckets are without words. A latent state emits a bucket, and within
its bucket a word has its smoothed share of the bucket's counts, so that the model gives every text a probability and
needs only tables of bounded size besides the counts: p(word | state) = e(bucket | state) * (c + 0.5) / D(bucket), where
D(bucket) = C + 0.5 * (V + 1) over the bucket's C tokens and V distinct words. Each bucket so keeps a share for one unknown
word. The scaled forward recursion gives the exact likelihood of a text's buckets; the rest is a sum over its words.

Baum-Welch: tasks go forward and backward through their documents and give expected counts by bucket and state, Spark adds
them up, the driver gets the sums (one row a bucket) and makes the next model. Starting values are
the words' own distribution, disturbed by a seed; all `passes` iterations go over all training documents.

Counts of words are joined, not collected. The FREQUENT most frequent words of the training documents, of bounded length,
are broadcast, less those that tie for the last places; every word that holds one in FREQUENT tokens is among them, so no key of the
join is hot. A word of over 40 bytes
is represented by its SHA-256. Texts of over `LONG` words are cut into segments for the recursions, and joined again
exactly by the segments' transfer matrices.

Null text counts as empty: its one token is the end. Null ids count as empty text in the hash that holds documents out. Repeated
rows are documents of their own. Without training documents the counts are 0, and scores follow the formulas. An empty table gives an
empty result. Columns that are not named are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolith.llm.common import Scratch, materialize, release, slices
from annolith.llm.labelled import remainder

STATES, BUCKETS, KINDS = 8, 65_535, 4
FREQUENT = 250_000
#: Words of a text that goes through the recursion at once, of a segment of a longer one, tokens of a block, and rows of it, if
#: that makes it larger.
LONG, SEGMENT, BLOCK, WIDE = 2048, 128, 1 << 18, 256
#: Steps between two scalings in double precision and in single. With emissions of 1 in the likeliest state a step keeps of
#: what there is at least the least transition, in next_model about EVEN in a state's tokens: single precision holds two such.
TURN, TURN_SINGLE = 8, 2
#: Tokens whose numbers stay in a cache.
NEAR = 1 << 13
#: Tokens of each bucket that count as spread over the states like all tokens, and evenness of the transitions.
SPREAD, EVEN = 4.0, 1.0
PLAIN = 40


def key_of(word: bytes) -> bytes:
    """The word itself, or a blank and its digest: no word holds a blank."""
    return word if len(word) <= PLAIN else b" " + hashlib.sha256(word).digest()


def _keys(words: pa.Array) -> list[bytes]:
    """The key of each word, cut from the array's own bytes."""
    _, ends, data = words.buffers()
    if not len(words):
        return []
    ends, data = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1].tolist(), data.to_pybytes()
    return [data[a:b] if b - a <= PLAIN else key_of(data[a:b]) for a, b in pairwise(ends)]


def _listed(owner: np.ndarray, values: pa.Array, rows: int) -> pa.Array:
    """A list for each row, of the values that it owns; owners ascend."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)), values)


def encode(texts: pa.Array) -> dict[str, pa.Array]:
    """n_tokens, ids (the tokens' buckets, the end too, as unsigned 16-bit numbers), words and their times of each text."""
    n = len(texts)
    # Both take ASCII alone for letters and for white space.
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    row, flat = np.repeat(np.arange(n), split.value_lengths().to_numpy(zero_copy_only=False)), split.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # blanks at either end leave an empty word
    row, coded = row[full], flat.filter(pa.array(full)).dictionary_encode()
    known = coded.dictionary.cast(pa.binary())
    keys = _keys(known)
    if (pc.max(pc.binary_length(known)).as_py() or 0) > PLAIN:
        known = pa.array(keys, pa.binary())
    code, kinds = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(keys))
    n_tokens = np.bincount(row, minlength=n) + 1
    ends = np.cumsum(n_tokens)
    ids = np.zeros(n_tokens.sum(), "<u2")
    ids[np.arange(len(code)) + row] = np.array([1 + zlib.crc32(k) % BUCKETS for k in keys], "<u2")[code]
    sizes = pa.array(np.concatenate([[0], 2 * ends]).astype(np.int32)).buffers()[1]
    pairs = np.sort(row * kinds + code)
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    owner, code = np.divmod(pairs[first], kinds)
    words = known.take(pa.array(code))
    times = pa.array(np.diff(first, append=len(pairs)).astype(np.int32))
    return {"n_tokens": pa.array(n_tokens), "ids": pa.Array.from_buffers(pa.binary(), n, [None, sizes, pa.py_buffer(ids)]), "words": _listed(owner, words, n), "times": _listed(owner, times, n)}


def _binary(ends: np.ndarray, data: pa.Buffer | np.ndarray) -> pa.Array:
    """Values that lie in data one after another; ends start with 0."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def packed(words: pa.Array, times: pa.Array) -> dict[str, pa.Array]:
    """Lists of words and times as one value a row each: the words' bytes, their lengths and times as numbers of 8 and 32 bits."""
    rows, flat = words.offsets.to_numpy(), words.flatten()
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy())])
    lengths, data = np.diff(ends).astype("u1"), flat.buffers()[2] or pa.py_buffer(b"")
    return {"words": _binary(ends[rows], data), "lengths": _binary(rows, lengths), "times": _binary(4 * rows.astype(np.int64), times.flatten().to_numpy().astype("<i4"))}


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of each word of the batch's texts: row in the batch, the word, times."""
    data, lengths, times = (b"".join(batch.column(n).to_pylist()) for n in ("words", "lengths", "times"))
    row = np.repeat(np.arange(batch.num_rows), pc.binary_length(batch.column("lengths")).to_numpy())
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, "u1"), dtype=np.int64)])
    return row, _binary(ends, data), np.frombuffer(times, "<i4")


def _encoded(docs: DataFrame) -> DataFrame:
    """doc_id and held_out of docs, and what encode gives, words and times packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = encode(part.column("text").cast(pa.string()))
                made |= packed(made.pop("words"), made.pop("times"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *made.values()], names=["doc_id", "held_out", *made])
                del made
        release()

    return docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, ids binary, words binary, lengths binary, times binary")


def _counted(encoded: DataFrame) -> DataFrame:
    """word and c, its times in all texts; each batch is counted in its task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, "times", 1 << 24):
            _, words, times = unpacked(batch)
            coded = words.dictionary_encode()
            sums = np.bincount(coded.indices.to_numpy(), times, len(coded.dictionary))  # exact: far below 2 ** 53
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(sums.astype(np.int64))], names=["word", "c"])
            del words, coded
        release()

    return encoded.select("words", "lengths", "times").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def least_count(words: list[tuple[int, int]], room: int) -> int | None:
    """The least count that at most room words reach, of (count, words that have it)."""
    least = None
    for count, n in sorted(words, reverse=True):
        if n > room:
            break
        least, room = count, room - n
    return least


# -- the model and its recursions --------------------------------------------------------------------------------------


@dataclass
class Model:
    start: np.ndarray  # (K)
    move: np.ndarray  # (K, K)
    emit: np.ndarray  # (buckets + 1, K)

    @property
    def states(self) -> int:
        return len(self.start)

    @property
    def turn(self) -> int:
        return TURN_SINGLE if self.emit.dtype == np.float32 else TURN

    @cached_property
    def tops(self) -> np.ndarray:
        """Emission of each bucket's likeliest state."""
        return self.emit.max(1)

    @cached_property
    def likely(self) -> np.ndarray:
        """Emissions with 1 for the likeliest state, and a last bucket that no state emits."""
        return np.concatenate([self.emit / self.tops[:, None], np.zeros_like(self.emit[:1])])


def first_model(shares: np.ndarray, states: int, seed: int) -> Model:
    """The words' own distribution in every state, disturbed; states tend to stay."""
    rng = np.random.default_rng(seed)
    emit = shares[:, None] * rng.gamma(2.0, 1.0, (len(shares), states))
    return Model(np.full(states, 1 / states), np.full((states, states), 0.3 / states) + 0.7 * np.eye(states), emit / emit.sum(0))


def next_model(starts: np.ndarray, moves: np.ndarray, emitted: np.ndarray, shares: np.ndarray) -> Model:
    """From expected counts, smoothed. What is known of a bucket's states is little if it has few tokens: then it is spread
    over the states as all tokens are. Every bucket keeps its share of all tokens."""
    start, move = starts + EVEN, moves + EVEN
    used = (emitted.sum(0) + EVEN) / (emitted + EVEN / len(emitted)).sum()
    states = (emitted + SPREAD * used) / (emitted.sum(1, keepdims=True) + SPREAD)
    emit = shares[:, None] * states
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _padded(rows: list[np.ndarray], blank: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens by place and row, blank after a row's end; rows that have a token at each place); rows come longest first."""
    lengths = np.array([len(r) for r in rows])
    out = np.full((lengths[0], len(rows)), blank, np.int64)
    for i, r in enumerate(rows):
        out[: len(r), i] = r
    return out, (lengths[None, :] > np.arange(lengths[0])[:, None]).sum(1)


def _forward(model: Model, rows: list[np.ndarray], prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward recursion, scaled at every model.turn places. prior: (rows, K), states before the first token is seen.

    (tokens, alive, seen, alphas): by place and row, with states between where there are any, so that a step goes through
    memory in order. seen holds each token's emissions, divided by its scale. Numbers are of the model's precision.
    """
    tokens, alive = _padded(rows, len(model.emit))
    places, wide = tokens.shape
    seen, step = np.empty((places, model.states, wide), model.emit.dtype), max(1, NEAR // wide)
    for i in range(0, places, step):
        seen[i : i + step] = model.likely.take(tokens[i : i + step], 0).transpose(0, 2, 1)
    alphas, onward = np.zeros_like(seen), np.ascontiguousarray(model.move.T)
    for t, n in enumerate(alive.tolist()):
        now, own = alphas[t, :, :n], seen[t, :, :n]
        if t:
            np.matmul(onward, before[:, :n], out=now)
        else:
            now[:] = prior.T
        if t and t % model.turn == 0:
            own *= 1 / before[:, :n].sum(0)
        now *= own
        before = now
    return tokens, alive, seen, alphas


def _last(alphas: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    return alphas[[len(r) - 1 for r in rows], :, np.arange(len(rows))]


def _logs(model: Model, rows: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of each row's probability, by the forward recursion alone."""
    tokens, alive = _padded(rows, len(model.emit))
    now, onward, logs = np.repeat(model.start[:, None], len(rows), 1), np.ascontiguousarray(model.move.T), np.zeros(len(rows))
    for t, n in enumerate(alive):
        if n < now.shape[1]:
            logs[n : now.shape[1]] += np.log(now[:, n:].sum(0))
            now = now[:, :n]
        if t:
            now = onward @ now
        now *= model.likely.take(tokens[t, :n], 0).T
        if t % model.turn == model.turn - 1:
            scale = now.sum(0)
            now /= scale
            logs[:n] += np.log(scale)
    logs[: now.shape[1]] += np.log(now.sum(0))
    tops = np.log(model.tops, dtype=np.float64)
    return logs + [tops[r].sum() for r in rows]


class Segments:
    """The long ones of some texts, cut; all segments go through the recursion together, longest first."""

    def __init__(self, model: Model, texts: list[np.ndarray]):
        self.model = model
        self.texts = [i for i, t in enumerate(texts) if len(t) > LONG]
        cut = [[texts[i][j : j + SEGMENT] for j in range(0, len(texts[i]), SEGMENT)] for i in self.texts]
        parts = [p for own in cut for p in own]
        self.starts = np.cumsum([0, *map(len, cut)])
        self.order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
        self.parts = [parts[i] for i in self.order]

    def transfers(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each segment (segments, K, K) the probability of its tokens and its last state given its first state, divided
        by exp of (segments)."""
        k, n, turn, kind = self.model.states, len(self.parts), self.model.turn, self.model.emit.dtype
        found, logs = np.zeros((n, k, k)), np.zeros(n)
        emit, tops = self.model.likely, np.log(self.model.tops, dtype=np.float64)
        onward = np.ascontiguousarray(self.model.move.T)
        step = max(1, 16 * NEAR // (k * k * kind.itemsize))
        for i in range(0, n, step):
            parts, at = self.parts[i : i + step], self.order[i : i + step]
            tokens, alive = _padded(parts, len(self.model.emit))
            # Last state by first state and segment.
            now, log = np.repeat(np.eye(k, dtype=kind)[:, :, None], len(parts), 2), np.zeros(len(parts))
            for t, m in enumerate(alive):
                own = now[:, :, :m]
                if t:
                    own = (onward @ own.reshape(k, -1)).reshape(k, k, m)
                seen = np.ascontiguousarray(emit.take(tokens[t, :m], 0).T)
                if t and t % turn == 0:
                    seen /= most[:m]
                    log[:m] += np.log(most[:m])
                own *= seen[:, None]
                if t % turn == turn - 1:
                    most = own.max((0, 1))
                if m == len(parts):
                    now = own
                else:
                    now[:, :, :m] = own
            whole = now.max((0, 1))
            found[at] = (now / whole).transpose(2, 1, 0)
            logs[at] = log + np.log(whole) + [tops[p].sum() for p in parts]
        return found, logs

    def chained(self, transfers: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihood of each text, states before the first token of each segment)."""
        priors, totals = np.zeros((len(transfers), self.model.states)), np.zeros(len(self.texts))
        sizes = np.diff(self.starts)
        order = np.argsort(-sizes, kind="stable")  # the j-th segments of all texts that have one go together
        prior = np.tile(self.model.start.astype(np.float64), (len(order), 1))
        for j in range(sizes.max(initial=0)):
            own = order[: np.count_nonzero(sizes > j)]
            at = self.starts[own] + j
            priors[at] = prior[: len(own)]
            end = (priors[at, None] @ transfers[at])[:, 0]
            whole = end.sum(1)
            totals[own] += np.log(whole) + logs[at]
            prior = (end / whole[:, None]) @ self.model.move
        return totals, priors


def _blocks(texts: list[np.ndarray]) -> Iterator[list[int]]:
    """Numbers of texts, longest first, that together fill at most a block, or one of WIDE rows, when padded."""
    order = sorted((i for i, t in enumerate(texts) if len(t) <= LONG), key=lambda i: -len(texts[i]))
    while order:
        n = max(WIDE, BLOCK // len(texts[order[0]]))
        yield order[:n]
        order = order[n:]


def log_likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of each text's probability; a text is the buckets of its tokens, the end included."""
    out = np.zeros(len(texts))
    for own in _blocks(texts):
        out[own] = _logs(model, [texts[i] for i in own])
    cut = Segments(model, texts)
    if cut.texts:
        out[cut.texts] = cut.chained(*cut.transfers())[0]
    return out


class Counts:
    """Expected counts of starts, moves and emissions of the texts that were added."""

    def __init__(self, model: Model):
        self.model, k = model, model.states
        self.starts, self.moves, self.emitted = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape[::-1]).T

    def _rows(self, rows: list[np.ndarray], prior: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and back; after: (rows, K), how likely what follows a row is given its last state, in any scale. Returns
        the states at each row's first and last token, the last without what follows."""
        model = self.model
        tokens, alive, seen, alphas = _forward(model, rows, prior)
        last = _last(alphas, rows)
        # All in the scales of the forward recursion: states given the whole text then sum to 1 without another division.
        after = (after / (last * after).sum(1, keepdims=True)).T.astype(seen.dtype)
        betas, n = np.zeros_like(seen), 0
        for t, m in zip(range(len(alive) - 1, -1, -1), alive[::-1].tolist(), strict=True):
            if n:
                ahead = seen[t + 1, :, :n]  # from here on emissions and all that follows
                ahead *= betas[t + 1, :, :n]
                np.matmul(model.move, ahead, out=betas[t, :, :n])
            if m > n:
                betas[t, :, n:m] = after[:, n:m]
            n = m
        moves, step = np.zeros_like(self.moves), max(1, NEAR // tokens.shape[1])
        for i in range(0, len(alive), step):
            own, ahead = alphas[i : i + step], seen[i + 1 : i + 1 + step]
            moves += np.matmul(own[: len(ahead)], ahead.transpose(0, 2, 1)).sum(0)
            own *= betas[i : i + step]
        self.moves += moves * model.move
        flat = tokens.ravel()
        for k in range(model.states):
            self.emitted[:, k] += np.bincount(flat, alphas[:, k].ravel(), len(self.emitted) + 1)[:-1]
        return alphas[0].T, last

    def add(self, texts: list[np.ndarray]) -> None:
        k = self.model.states
        for own in _blocks(texts):
            rows = [texts[i] for i in own]
            first, _ = self._rows(rows, np.tile(self.model.start, (len(rows), 1)), np.ones((len(rows), k)))
            self.starts += first.sum(0)
        cut = Segments(self.model, texts)
        if cut.texts:
            self._long(cut)

    def _long(self, cut: Segments) -> None:
        move, (transfers, logs) = self.model.move, cut.transfers()
        _, priors = cut.chained(transfers, logs)
        after, ahead, ends = np.ones_like(priors), np.ones_like(priors), np.zeros_like(priors)
        sizes = np.diff(cut.starts)
        for j in range(1, sizes.max() + 1):  # the j-th segments from the end
            at = cut.starts[1:][sizes >= j] - j
            ahead[at] = (transfers[at] @ after[at, :, None])[:, :, 0]
            ahead[at] /= ahead[at].sum(1, keepdims=True)
            at = cut.starts[1:][sizes > j] - j
            after[at - 1] = ahead[at] @ move.T
        firsts, step = np.zeros_like(priors), max(1, BLOCK // SEGMENT)
        for i in range(0, len(cut.parts), step):
            at = cut.order[i : i + step]
            firsts[at], ends[at] = self._rows(cut.parts[i : i + step], priors[at], after[at])
        self.starts += firsts[cut.starts[:-1]].sum(0)
        # Steps from one segment to the next.
        follows = np.ones(len(priors), bool)
        follows[cut.starts[:-1]] = False
        later = np.flatnonzero(follows)
        whole = (ends[later - 1] * after[later - 1]).sum(1, keepdims=True)
        self.moves += ends[later - 1].T @ (ahead[later] / whole) * move


# -- training and scoring over Spark -----------------------------------------------------------------------------------


def folded(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The hashes 1 to BUCKETS as buckets 1 to buckets; 0, the end, stays."""
    every = np.arange(BUCKETS + 1)
    return np.where(every == 0, 0, 1 + (every - 1) % buckets)[ids]


def _texts(batch: pa.RecordBatch, model: Model) -> list[np.ndarray]:
    texts = batch.column("ids")
    flat = folded(np.frombuffer(b"".join(texts.to_pylist()), "<u2"), len(model.emit) - 1)
    return np.split(flat, np.cumsum(pc.binary_length(texts).to_numpy() // 2)[:-1]) if len(texts) else []


def _small(batches: Iterator[pa.RecordBatch], column: str = "ids", most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Batches of so many bytes of the column, or one row."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most // max(1, batch.column(column).nbytes)))
        yield from (batch.slice(i, step) for i in range(0, batch.num_rows, step))


def baum_welch(texts: DataFrame, model: Model, shares: np.ndarray) -> Model:
    """One iteration over all texts (ids). Counts come from tasks by bucket and are added up by Spark; rows below 0 hold
    the starts and moves."""
    k = model.states
    names = [f"k{i}" for i in range(k)]
    single = Model(*(x.astype(np.float32) for x in (model.start, model.move, model.emit)))  # sums below are of doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(single)
        for batch in _small(batches):
            counts.add(_texts(batch, single))
        rows = np.concatenate([counts.starts[None], counts.moves, counts.emitted])
        used = np.flatnonzero(rows.any(1))
        columns = [pa.array((used - 1 - k).astype(np.int32)), *(pa.array(rows[used, i].astype(np.float32)) for i in range(k))]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", *names])
        del counts, rows
        release()

    sums = texts.select("ids").mapInArrow(run, ", ".join(["bucket int", *(f"{n} float" for n in names)])).groupBy("bucket").agg(*(F.sum(F.col(n).cast("double")).alias(n) for n in names))
    whole = np.zeros((1 + k + len(shares), k))
    for row in sums.collect():
        whole[row["bucket"] + 1 + k] = row[1:]
    return next_model(whole[0], whole[1 : 1 + k], whole[1 + k :], shares)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, held: int = 1, states: int = STATES, passes: int = 6, seed: int = 11) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32(id as text) leaves the remainder held by modulus are held out; all others train. Logarithms are
    decimal. base_score is that of single words, smoothed by a half.
    """
    with Scratch(docs.sparkSession, "sequence-lm") as scratch:
        base = docs.select(F.col(id_col).cast("long").alias("doc_id"), (remainder(F.col(id_col), modulus) == held).alias("held_out"), F.col(text_col).cast("string").alias("text"))
        encoded = scratch.table(_encoded(base).withColumn("row", F.monotonically_increasing_id()))
        training = encoded.filter("not held_out")
        counts = scratch.table(_counted(training))
        n_docs = training.count()

        buckets = int(min(BUCKETS, 1 + counts.count() // KINDS))
        hashed = F.crc32("word") % BUCKETS
        told = counts.groupBy((1 + hashed % buckets).cast("int").alias("bucket")).agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("kinds")).collect()
        tokens, kinds = np.zeros(buckets + 1, np.int64), np.zeros(buckets + 1, np.int64)
        for r in told:
            tokens[r["bucket"]], kinds[r["bucket"]] = r["tokens"], r["kinds"]
        tokens[0], kinds[0] = n_docs, min(1, n_docs)
        all_, whole = int(tokens.sum()), int(tokens.sum()) + 0.5 * (int(kinds.sum()) + 1)
        weight = tokens + 0.5 * (kinds + 1)
        weight[0] = n_docs + 0.5  # the end is no unknown word
        shares = weight / weight.sum()

        model = first_model(shares, states, seed)
        for _ in range(passes):
            model = baum_welch(training, model, shares)

        # The driver gets a row for each count there is, at most the root of twice the tokens, and FREQUENT short keys at most.
        least = least_count([tuple(r) for r in counts.groupBy("c").agg(F.count(F.lit(1))).collect()], FREQUENT) or all_ + 1
        often = counts.filter(F.col("c") >= least).toArrow()
        known, known_logs = often.column("word").combine_chunks(), np.log10(often.column("c").to_numpy() + 0.5)
        log_weight = np.log10(weight)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _small(batches):
                texts = _texts(batch, model)
                found = log_likelihoods(model, texts) / np.log(10) - np.array([log_weight[t].sum() for t in texts])
                row, word, times = unpacked(batch)
                place = pc.index_in(word, value_set=known)
                often = place.is_valid().to_numpy(zero_copy_only=False)
                mine, logs = row[often], known_logs[place.drop_null().to_numpy()]
                sums = [np.bincount(mine, w, batch.num_rows) for w in (logs * times[often], times[often])]
                # A row for each text, under a key that no word has, and one for each other word.
                marks = pa.array([b" " + r.to_bytes(8, "little") for r in batch.column("row").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("row"), marks, pa.array(sums[1].astype(np.int32)), pa.array(sums[0].astype(np.float64)), pa.array(found, pa.float64())], names=names)
                at = np.flatnonzero(~often)
                none = pa.nulls(len(at), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(row[at])), word.take(pa.array(at)), pa.array(times[at].astype(np.int32)), none, none], names=names)
            release()

        names = ["row", "word", "times", "often", "latent"]
        words = encoded.select("row", "ids", "words", "lengths", "times").mapInArrow(run, "row long, word binary, times int, often double, latent double")
        each = words.join(counts.filter(F.col("c") < least), "word", "left")
        value = F.coalesce("often", F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5))
        found = F.when(F.col("often").isNotNull() | (F.col("c") > 0), F.col("times")).otherwise(0)
        sums = each.groupBy("row").agg(F.sum(value).alias("logs"), F.sum(found).alias("known"), F.sum("latent").alias("latent"))
        ends = float(np.log10(n_docs + 0.5))
        out = encoded.select("row", "doc_id", "held_out", "n_tokens").join(sums, "row")
        logs = F.col("logs") + F.lit(ends)
        return materialize(
            out.select(
                "doc_id", "held_out", "n_tokens", (F.col("known") + F.lit(min(1, n_docs))).cast("long").alias("n_known"), F.lit(all_).cast("long").alias("train_tokens"),
                (logs - F.col("n_tokens") * F.lit(float(np.log10(whole)))).alias("base_score"), (logs + F.col("latent")).alias("score"),
            ),
            "scored",
        )
