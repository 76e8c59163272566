"""Prefix trie, hidden Markov language model, importance resampling: brute force, enumeration, edge cases."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("annolith.llm")
from annolith.llm import prefix_trie, resampling, sequence_lm  # noqa: E402
from annolith.llm.common import Scratch, in_order  # noqa: E402

DOCS = "doc_id long, text string, row long, words int, bucket string, score double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, -1, 5, "x", 0.5) for i, t in rows], DOCS).repartition(3)


ODD = [(None, None), (None, "a b"), (0, ""), (1, " \t\n"), (2, "a b"), (2, "a b"), (4, "日本語 ελληνικά \u0085 x A a"), (5, "word " * 6000), (6, "x" * 5000 + " b"), (7, "İ ſ K k")]


# -- order


def test_order_over_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 1, 1, 2]), rng.randrange(4), i) for i in range(300)]
    table = spark.createDataFrame(rows, "k long, v long, u long").repartition(5)
    with Scratch(spark, "t") as scratch:
        got = in_order(table, [F.col("k").asc_nulls_first(), F.col("u").desc()], scratch, ("v",)).collect()
        want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[2]))
        through = list(itertools.accumulate(r[1] for r in want))
        assert sorted((r.place, r.k, r.u, r.through_v) for r in got) == [(i, r[0], r[2], through[i]) for i, r in enumerate(want)]
        assert in_order(table.limit(0), [F.col("u").asc()], scratch).count() == 0


# -- trie

TURNS = "conv_id long, turn long, role string, text string, depth int, node string, path string, n_convs long"


def plain_trie(rows, most=6):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for c in own:
        own[c] = [t[2:] for t in sorted(own[c])]
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        whole[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        under = [k for k in nodes if k[: len(key)] == key]
        inner = {k[:-1] for k in nodes if k}
        ends = sorted(c for c in members if len(whole[c]) == len(key))
        saved = sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in under if k)
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), sum(k[:-1] == key for k in nodes if k), sum(k not in inner for k in under), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows):
    table = spark.createDataFrame([(*r, 7, "n", "p", 3) for r in rows], TURNS).repartition(3)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(table).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_a_plain_one(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(250, 256), -120, -100, 9000]:
        n = rng.choice([1, 2, 3, 5, 7, 9])
        same = rng.random() < 0.4
        rows += [(c, t, "user" if t % 2 else "bot", "same text" if same else rng.choice(["ja", "nein", "ça"])) for t in range(n)]
    rows += [(5, 2, None, None), (5, 2, "", ""), (5, None, "user", "first"), (None, 1, "user", "nobody"), (6, 0, "user", "Ä" * 400 + "x"), (6, 0, "user", "Ä" * 400 + "x")]
    assert trie(spark, rows) == plain_trie(rows)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(None, 1, "a", "b")],
        [(7, 0, "a", "b")],
        [(150, 0, "a", "b"), (151, 0, "a", "b")],  # turnless where the hundred's first is absent and enough turns are taken
        [(c, t, "u", "x") for c in (100, 101, 102, 103, 104) for t in range(c - 97)],  # every one a beginning of the next
        [(c, t, "u", str(t)) for c in range(9) for t in range(30)] + [(99_000_000 + 5000 * c, 0, "u", "far") for c in range(3)],
    ],
)
def test_trie_edge_cases(spark, rows):
    assert trie(spark, rows) == plain_trie(rows)


def test_ids_of_many_slices_are_hashed_in_order(spark):
    members = spark.range(0, 30_000, 3).select(F.col("id"), (F.col("id") % 2).alias("path")).select("path", F.col("id").alias("conv_id")).repartition(7)
    got = {r.path: r.sha for r in prefix_trie._ids_hash(members).collect()}
    for path in (0, 1):
        ids = ",".join(str(i) for i in range(0, 30_000, 3) if i % 2 == path)
        assert got[path] == hashlib.sha256(ids.encode()).hexdigest()


# -- language model


def toy(seed=0, states=3, kinds=6):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return sequence_lm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((kinds, states)), 0))


def enumerated(model, text):
    """(probability, starts, moves, emitted) over all state sequences."""
    k, whole = model.states, 0.0
    starts, moves, emitted = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape)
    for path in itertools.product(range(k), repeat=len(text)):
        p = model.start[path[0]] * math.prod(model.move[a, b] for a, b in itertools.pairwise(path)) * math.prod(model.emit[o, s] for o, s in zip(text, path))
        whole += p
        starts[path[0]] += p
        for a, b in itertools.pairwise(path):
            moves[a, b] += p
        for o, s in zip(text, path):
            emitted[o, s] += p
    return whole, starts / whole, moves / whole, emitted / whole


@pytest.mark.parametrize("long", [2048, 3])
def test_recursions_equal_enumeration(monkeypatch, long):
    monkeypatch.setattr(sequence_lm, "LONG", long)
    monkeypatch.setattr(sequence_lm, "SEGMENT", 2)
    model, rng = toy(), np.random.default_rng(4)
    texts = [rng.integers(0, 6, n) for n in (1, 2, 7, 3, 1, 5, 6, 4)]
    counts = sequence_lm.Counts(model)
    counts.add(texts)
    want = [enumerated(model, t) for t in texts]
    assert np.allclose(np.exp(sequence_lm.log_likelihoods(model, texts)), [w[0] for w in want], rtol=1e-12)
    for got, i in ((counts.starts, 1), (counts.moves, 2), (counts.emitted, 3)):
        assert np.allclose(got, sum(w[i] for w in want), atol=1e-12)


def test_long_texts_do_not_underflow_and_segments_change_nothing(monkeypatch):
    model, text = toy(2, 4, 50), np.random.default_rng(1).integers(0, 50, 5000)
    assert len(text) > sequence_lm.LONG
    cut, one = sequence_lm.log_likelihoods(model, [text]), sequence_lm.Counts(model)
    one.add([text])
    monkeypatch.setattr(sequence_lm, "LONG", 10_000)
    two = sequence_lm.Counts(model)
    two.add([text])
    assert np.isfinite(cut).all() and np.allclose(cut, sequence_lm.log_likelihoods(model, [text]), rtol=1e-12)
    assert np.allclose(one.moves, two.moves) and np.allclose(one.emitted, two.emitted) and np.allclose(one.starts, two.starts)


def test_iterations_gain(spark):
    rng, truth = np.random.default_rng(7), toy(5, 2, 4)
    truth.emit = np.array([[0.7, 0.05], [0.2, 0.05], [0.05, 0.6], [0.05, 0.3]])
    texts = []
    for _ in range(60):
        s, text = rng.choice(2, p=truth.start), []
        for _ in range(40):
            text.append(rng.choice(4, p=truth.emit[:, s]))
            s = rng.choice(2, p=[0.9, 0.1] if s == 0 else [0.1, 0.9])
        texts.append(np.array(text))
    table = spark.createDataFrame([(bytearray(t.astype("<u2").tobytes()),) for t in texts], "ids binary").repartition(4)
    model, shares, seen = toy(9, 2, 4), np.bincount(np.concatenate(texts), minlength=4) / 2400, []
    for _ in range(12):
        seen.append(sequence_lm.log_likelihoods(model, texts).sum())
        model = sequence_lm.baum_welch(table, model, shares)
        assert np.allclose([model.start.sum(), *model.move.sum(1), *model.emit.sum(0)], 1)
    assert all(b > a - 2 for a, b in itertools.pairwise(seen)) and seen[-1] > seen[0] + 50


def test_language_model_over_documents(spark):
    rng = random.Random(4)
    words = {"de": [f"wort{i}" for i in range(80)], "en": [f"Word{i}" for i in range(80)]}
    rows = ODD + [(100 + i, " ".join(rng.choices(words[rng.choice(["de", "en"])], k=rng.randrange(1, 60)))) for i in range(120)]
    got = sequence_lm.score_documents(docs(spark, rows)).collect()
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, (_, t) in enumerate(rows)}
    held = [zlib.crc32(str(i if i is not None else "").encode()) % 5 == 1 for i, _ in rows]
    counts = Counter(t for i in tokens for t in tokens[i] if not held[i])
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(rows[i][0]), held[i], len(t), sum(counts[x] > 0 for x in t), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), 6)) for i, t in tokens.items())
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    mine = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 100]
    assert sum(r.score for r in mine) > sum(r.base_score for r in mine) + 5


def test_language_model_of_nothing(spark):
    assert sequence_lm.score_documents(docs(spark, [])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    got = sequence_lm.score_documents(docs(spark, [(held, "a b"), (held, None)])).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got} == {(3, 0, 0, 0.0), (1, 0, 0, 0.0)}


def test_words_of_any_length_have_short_keys():
    assert sequence_lm.key_of(b"a" * 40) == b"a" * 40 and len(sequence_lm.key_of(b"a" * 41)) == 33
    assert sequence_lm.key_of(b"a" * 41) != sequence_lm.key_of(b"a" * 42)


# -- resampling


def plain_resample(rows, target, max_n=1, buckets=10_000, min_words=20, percent=10):
    def found(text):
        words = "".join(c if c.isalnum() or ord(c) >= 0x80 else " " for c in "".join(c.lower() if c.isascii() else c for c in text or "")).split(" ")
        words = [w for w in words if w]
        runs = [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]
        return len(words), Counter(zlib.crc32(r.encode()) % buckets for r in runs)

    mine, theirs = [found(t) for _, t in rows], [found(t) for t in target]
    s, t = sum((x[1] for x in mine), Counter()), sum((x[1] for x in theirs), Counter())
    gains = {b: math.floor(1000 * math.log(((t[b] + 1) * (s.total() + buckets)) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    out = []
    for (i, _), (n, own) in zip(rows, mine):
        weight = sum(c * gains[b] for b, c in own.items()) // own.total() if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, own.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = Counter((r[0], r[1], r[2], r[3], k + 1) for k, r in enumerate(fit[: percent * len(fit) // 100]))
    return Counter(r[:4] for r in out), ranks


@pytest.mark.parametrize(("max_n", "percent", "slice_docs"), [(1, 10, 1_000_000), (2, 60, 3)])
def test_resampling_equals_a_plain_one(spark, max_n, percent, slice_docs):
    rng = random.Random(6)
    vocabulary = ["the", "Größe", "Don't", "x1", "k-9", "été", "a", "of", "İ"]
    rows = [r for r in ODD if r[0] is not None] + [(100 + i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 5, 19, 20, 40, 90])))) for i in range(90)] + [(None, "the the " * 15)]
    target = [None, "", "the Größe of x1", "of of été"]
    aimed = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    got = resampling.resample(docs(spark, rows), aimed, max_n=max_n, percent=percent, slice_docs=slice_docs).collect()
    everything, ranks = plain_resample(rows, target, max_n, percent=percent)
    assert Counter(tuple(r)[:4] for r in got) == everything
    assert Counter(tuple(r) for r in got if r.rank is not None) == ranks


def test_resampling_of_equal_rows_and_nothing(spark):
    empty = spark.createDataFrame([], "text string")
    assert resampling.resample(docs(spark, []), empty).count() == 0
    rows = [(None, "a " * 25)] * 40 + [(3, "a " * 25)] * 10
    got = resampling.resample(docs(spark, rows), empty).collect()
    assert sorted(r.rank for r in got if r.rank) == [1, 2, 3, 4, 5] and len({(r.doc_id, r.weight, r.score) for r in got}) == 2


def test_every_iteration_of_the_model_goes_over_all_training_documents(spark, monkeypatch):
    from annolith.llm import sequence_lm

    seen, whole = [], sequence_lm.baum_welch
    monkeypatch.setattr(sequence_lm, "baum_welch", lambda texts, *rest: (seen.append(texts.count()), whole(texts, *rest))[1])
    docs = spark.createDataFrame([(i, f"a{i % 7} b c{i % 3}") for i in range(4000)], "doc_id long, text string")
    rows = sequence_lm.score_documents(docs, passes=2).collect()
    assert seen == [sum(not r.held_out for r in rows)] * 2 and seen[0] > 3000


def test_segments_of_long_texts_are_not_gone_through_once_for_each_state(monkeypatch):
    model, text = toy(3, 4, 50), np.random.default_rng(2).integers(0, 50, 6000)
    rows, whole = [], sequence_lm._forward
    monkeypatch.setattr(sequence_lm, "_forward", lambda model, own, *rest, **kept: (rows.append(sum(map(len, own))), whole(model, own, *rest, **kept))[1])
    counts = sequence_lm.Counts(model)
    counts.add([text])
    assert sum(rows) == len(text) and np.isclose(counts.emitted.sum(), len(text)) and np.isclose(counts.moves.sum(), len(text) - 1)


def test_single_precision_counts_like_double():
    model, rng = toy(6, 8, 300), np.random.default_rng(3)
    texts = [rng.integers(0, 300, n) for n in (1, 40, 700, 5000)]
    single = sequence_lm.Model(*(x.astype(np.float32) for x in (model.start, model.move, model.emit)))
    one, two = sequence_lm.Counts(model), sequence_lm.Counts(single)
    one.add(texts)
    two.add(texts)
    assert np.allclose(one.emitted, two.emitted, rtol=1e-4) and np.allclose(one.moves, two.moves, rtol=1e-4)


def test_texts_are_encoded_whole_and_read_once_for_scores(spark, monkeypatch):
    """Words, times and buckets as Python finds them one by one; scoring sends texts to Python once, not once for each sum."""
    import pyarrow as pa

    texts = [t for _, t in ODD] + ["\x0b\x0cA\x1cb\x85  c d a\r\na ", "é" * 30 + " " + "É" * 3]
    got = {k: v.to_pylist() for k, v in sequence_lm.encode(pa.array(texts, pa.string())).items()}
    for i, text in enumerate(texts):
        words = [sequence_lm.key_of(w) for w in (text or "").encode().lower().split()]
        assert dict(zip(got["words"][i], got["times"][i])) == Counter(words) and len(got["words"][i]) == len(set(words))
        assert got["n_tokens"][i] == len(words) + 1
        assert np.frombuffer(got["ids"][i], "<u2").tolist() == [*(1 + zlib.crc32(w) % sequence_lm.BUCKETS for w in words), 0]
    assert sequence_lm.encode(pa.array([], pa.string()))["ids"].to_pylist() == []
    plans = []
    monkeypatch.setattr(sequence_lm, "materialize", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), df)[1])
    sequence_lm.score_documents(docs(spark, ODD), passes=1)
    assert plans[0].count("MapInArrow") == 1


def test_words_travel_packed_and_are_counted_in_their_tasks(spark, monkeypatch):
    """One value a row in place of lists, no row for each word of each text in front of the sums, and counts as before."""
    import pyarrow as pa

    texts = ["a B a", "", None, "é" * 30 + " x", "\x00 " * 300, " \n", "b" * 40 + " b"]
    made = sequence_lm.encode(pa.array(texts, pa.string()))
    batch = pa.RecordBatch.from_pydict(sequence_lm.packed(made["words"], made["times"]))
    for own in (batch, batch.slice(2, 3), batch.slice(1, 1), batch.slice(7)):
        at = texts.index("") if own.num_rows == 1 else 2 if own.num_rows == 3 else 0
        row, words, times = sequence_lm.unpacked(own)
        want = [(i, w, n) for i in range(own.num_rows) for w, n in zip(made["words"][at + i].as_py(), made["times"][at + i].as_py())]
        assert list(zip(row.tolist(), words.to_pylist(), times.tolist())) == want
    table = sequence_lm._encoded(docs(spark, list(enumerate(texts * 3))).selectExpr("doc_id", "true as held_out", "text"))
    assert not any(f.dataType.typeName() == "array" for f in table.schema)
    counts = sequence_lm._counted(table)
    assert "Generate" not in counts._jdf.queryExecution().optimizedPlan().toString()
    want = Counter(sequence_lm.key_of(w) for t in texts for w in (t or "").encode().lower().split())
    assert {bytes(r.word): r.c for r in counts.collect()} == {w: 3 * n for w, n in want.items()}


def test_the_most_frequent_words_are_looked_up_and_the_others_joined(spark, monkeypatch):
    """As many words as there is room for, those of equal counts together; any room gives the same counts."""
    assert [sequence_lm.least_count([(1, 5), (100, 1), (10, 30)], n) for n in (0, 1, 30, 31, 35, 36)] == [None, 100, 100, 10, 10, 1]
    assert sequence_lm.least_count([], 9) is None
    rows = [(i, " ".join(f"w{j}" for j in range(30) if (i + j) % 3 or j < 4)) for i in range(60)]
    found, seen, whole = [], [], sequence_lm.least_count
    monkeypatch.setattr(sequence_lm, "least_count", lambda *args: (seen.append(whole(*args)), seen[-1])[1])
    for room in (0, 4, 40):
        monkeypatch.setattr(sequence_lm, "FREQUENT", room)
        got = sequence_lm.score_documents(docs(spark, rows), passes=1).collect()
        found.append(sorted((r.doc_id, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 6)) for r in got))
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in t.split())
    assert found[0] == found[1] == found[2] and seen == [None, max(counts.values()), min(counts.values())]


@pytest.mark.parametrize("n", [1, 2, 7, 300, 5000])
def test_single_precision_holds_what_is_left_between_two_scalings(n):
    """Transitions and emissions as unlikely as a very large corpus makes them, at every step of a text."""
    least = 1e-11
    model = sequence_lm.Model(np.array([1 - least, least]), np.array([[1 - least, least], [least, 1 - least]]), np.array([[1.0, least], [least, 1.0], [least, least]]))
    texts = [np.arange(n) % 2, (np.arange(n) + 1) % 2, np.full(n, 2)]
    single = sequence_lm.Model(*(x.astype(np.float32) for x in (model.start, model.move, model.emit)))
    one, two = sequence_lm.Counts(model), sequence_lm.Counts(single)
    one.add(texts)
    two.add(texts)
    assert np.isclose(two.emitted.sum(), 3 * n, rtol=1e-4) and np.allclose(one.emitted, two.emitted, rtol=1e-3, atol=1e-3) and np.allclose(one.moves, two.moves, rtol=1e-3, atol=1e-3)
    assert np.isfinite(sequence_lm.log_likelihoods(model, texts)).all()
