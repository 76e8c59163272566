"""Packing, mixing, archive, secrets and the classifiers: brute force, round trips, held-out accuracy, edge cases."""

import gzip
import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pyspark
import pytest
from pyspark.sql import functions as F

pytest.importorskip("annolith.llm")
from annolith.llm import labelled, mixing, packing, quality, secrets, toxicity, warc  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, piece int, rank long, score double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, -1, 5, 6, 0.5) for i, t, s in rows], SCHEMA).repartition(3)


ODD = [(None, None, None), (0, "", "a"), (1, " \t\n", None), (2, "a b", "a"), (2, "a b", "a"), (3, "<|endoftext|> x", "b"), (4, "日本語 ελληνικά \u0085 x", "a"), (5, "word " * 60_000, "b")]


# -- packing


def test_packing_is_a_gapless_round_trip(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    rows = ODD + [(10 + i, " ".join(rng.choices(["the", "Größe", "don't", "123456", "x!!", "\n\n", "été"], k=rng.choice([1, 5, 700, 2500]))), "s") for i in range(70)]
    got = packing.pack(docs(spark, rows)).toPandas()
    assert (got.groupby("sequence_id")["length"].sum() <= 2048).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.concatenate(([0], g["length"].cumsum()[:-1]))).all()
    pieces = []
    for i, t, _ in rows:
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        pieces += [(str(i), k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(packing.cut(len(ids)))]
    i = got["doc_id"].astype("Int64").astype(str).replace("<NA>", "None")
    assert sorted(zip(i, got["piece"], got["start"], got["length"], got["ids_crc32"])) == sorted(pieces)
    stock = got["length"].value_counts().to_dict()
    assert got["sequence_id"].nunique() <= packing.lower_bound(stock, 2048) + 1
    assert packing.pack(docs(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_never_above_best_fit(spark, seed):
    rng = random.Random(seed)
    draw = [lambda: rng.randint(1, 2048), lambda: min(2048, int(rng.lognormvariate(5.6, 1.1)) + 1), lambda: rng.choice([681, 682, 683, 684, 700, 1364]), lambda: rng.randint(500, 900)][seed]
    stock: dict[int, int] = {}
    for _ in range(3000):
        n = draw()
        stock[n] = stock.get(n, 0) + 1
    got = packing.pack_counts(spark, stock)
    found: dict[int, int] = {}
    for pattern, times in got:
        assert packing.used(pattern) <= 2048
        for n, c in pattern:
            found[n] = found.get(n, 0) + c * times
    assert found == stock
    assert packing.lower_bound(stock, 2048) <= packing.bins(got) <= packing.bins(packing.best_fit(stock, 2048))


@pytest.mark.parametrize("n", [1, 2047, 2048, 2049, 5000, 4096])
def test_cut(n):
    got = packing.cut(n)
    assert sum(x for _, x in got) == n and all(x == 2048 for _, x in got[1:]) and got[0][0] == 0
    assert all(a + x == b for (a, x), (b, _) in zip(got, got[1:]))


def test_genetic_operators_keep_every_piece():
    rng = random.Random(1)
    stock = {n: rng.randrange(1, 9) for n in rng.sample(range(300, 1500), 60)}

    def content(p):
        out = {}
        for pattern, times in p:
            assert packing.used(pattern) <= 2048
            for n, c in pattern:
                out[n] = out.get(n, 0) + c * times
        return out

    a, b = packing.best_fit(stock, 2048), packing.best_fit(stock, 2048, rng)
    assert content(a) == content(b) == stock
    child = packing.crossover(a, b, stock, 2048, rng)
    assert content(child) == content(packing.mutate(child, 2048, rng)) == stock
    best = packing.evolve(stock, 2048, 1, 6, 30, [])
    assert content(best[0]) == stock and packing.bins(best[0]) <= packing.bins(a)


def test_evolution_beats_best_fit():
    # Bins of three pieces that fill them exactly: greed takes apart what belongs together.
    rng, stock = random.Random(3), {}
    for _ in range(200):
        a = rng.randint(780, 1000)
        b = rng.randint(500, 1548 - a)
        for n in (a, b, 2048 - a - b):
            stock[n] = stock.get(n, 0) + 1
    first = packing.bins(packing.evolve(stock, 2048, 3, 6, 1, [])[0])
    last = packing.bins(packing.evolve(stock, 2048, 3, 6, 40, [])[0])
    assert packing.lower_bound(stock, 2048) == 200 <= last < packing.bins(packing.best_fit(stock, 2048)) and last < first


def test_evolution_reaches_the_bound_from_scattered_bins():
    rng = random.Random(8)
    stock = {n: rng.randrange(1, 6) for n in rng.sample(range(3, 1200), 500)}
    bound = packing.lower_bound(stock, 2048)
    assert packing.bins(packing.scatter(stock, 2048, rng)) > 1.05 * bound
    seeds = [packing.scatter(stock, 2048, rng) for _ in range(6)]
    assert packing.bins(packing.evolve(stock, 2048, 3, 6, 60, seeds)[0]) == bound


# -- mixing


def brute_targets(sizes):
    w = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    t, left, open_ = [Fraction(0)] * len(sizes), Fraction(3, 2) * sum(sizes), [i for i, s in enumerate(sizes) if s]
    while open_:
        unit = left / sum(w[i] for i in open_)
        over = [i for i in open_ if w[i] * unit > 2 * sizes[i]]
        for i in over or open_:
            t[i] = Fraction(2 * sizes[i]) if over else w[i] * unit
        if not over:
            return t
        left -= sum(t[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    return t


def test_mixing_meets_every_target(spark):
    rng = random.Random(9)
    assert mixing.mix(docs(spark, ODD)).count() == len(ODD)
    rows = ODD[:-1] + [(10 + i, "w " * rng.randrange(0, 60), rng.choice(["a", "b", "é", "Z", None])) for i in range(400)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by: dict = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in by[s]) for s in order]
    for s, size, target in zip(order, sizes, brute_targets(sizes)):
        assert all(r.source_size == size and abs(r.target - float(target)) < 1e-6 and 0 <= r.taken <= 2 * r["size"] for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - target) <= 1
    again = mixing.mix(docs(spark, rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, ODD[:3])).agg({"taken": "sum"}).first()[0] == 0
    for most in (250_000, 0):
        mixed = mixing.mixed_rows(docs(spark, rows), broadcast_rows=most).groupBy("doc_id").count().collect()
        want: dict = {}
        for r in got:
            want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
        assert {r.doc_id: r["count"] for r in mixed} == {i: n for i, n in want.items() if n}


def test_knapsack_equals_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        lengths = rng.sample(range(1, 30), 4)
        counts = [rng.randrange(4) for _ in lengths]
        budget = rng.randrange(80)
        best = {0}
        for n, c in zip(lengths, counts):
            best = {b + k * n for b in best for k in range(c + 1) if b + k * n <= budget}
        got = mixing.knapsack(lengths, counts, budget)
        assert sum(n * t for n, t in zip(lengths, got)) == max(best) and all(t <= c for t, c in zip(got, counts))


def test_budget_of_few_long_documents_is_met():
    assert mixing.fit_budget([50_000, 60_000, 100_000], [1, 1, 1], 110_000) == [1, 1, 0]
    rng = random.Random(4)
    for _ in range(40):
        lengths = rng.sample(range(60_000, 400_000), 5)
        counts = [rng.randrange(1, 3) for _ in lengths]
        budget = rng.randrange(1, sum(n * c for n, c in zip(lengths, counts)))
        made = {0}
        for n, c in zip(lengths, counts):
            made = {m + k * n for m in made for k in range(c + 1) if m + k * n <= budget}
        even = [c * budget // sum(n * c for n, c in zip(lengths, counts)) for c in counts]
        got = sum(n * t for n, t in zip(lengths, mixing.fit_budget(lengths, counts, budget)))
        # The even share is fixed first; the rest is as good as it can be.
        rest = {m for m in made if m >= sum(n * e for n, e in zip(lengths, even))}
        assert got in rest and budget - got <= min(lengths)


def test_budget_is_met_with_thousands_of_lengths(monkeypatch):
    monkeypatch.setattr(mixing, "WORK", 10_000_000)
    rng = random.Random(6)
    lengths = list(range(1, 3000))
    counts = [rng.randrange(1, 5) for _ in lengths]
    budget = sum(n * c for n, c in zip(lengths, counts)) * 5 // 8
    got = mixing.fit_budget(lengths, counts, budget)
    assert sum(n * t for n, t in zip(lengths, got)) == budget and all(t <= c for t, c in zip(got, counts))


# -- archive


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", 1) for i, u, h in rows], "page_id long, url string, html string, payload string, sha1 string".replace("sha1 string", "sha1 long")).repartition(3)


PAGES = [(3, "http://a/", "<p>é</p>"), (1, "http://b/", "<p>é</p>"), (2, None, None), (4, "http://c/\r\nX: y", ""), (5, "http://d/", "z" * 400_000), (6, "http://d/", "<p>中</p>")]


def test_archive_round_trip(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archive(pages(spark, PAGES), path)
    got = {r.page_id: r for r in warc.summary(warc.record_bytes(warc.read_archive(spark, path))).collect()}
    for i, _, h in PAGES:
        body = (h or "").encode()
        first = min(j for j, _, x in PAGES if (x or "") == (h or ""))
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(body), warc.base32_sha1(body))
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if i == first else ("revisit", first))
    assert spark.read.parquet(f"{path}/blobs").count() == len({h or "" for _, _, h in PAGES})
    records = {r.page_id: bytes(r.record) for r in warc.record_bytes(warc.read_archive(spark, path)).collect()}
    stored = tmp_path / "all.warc.gz"
    stored.write_bytes(gzip.compress(b"".join(records[i] for i, _, _ in PAGES)))
    back = warc.read_warc_files(spark, str(stored)).collect()
    assert [(r.fields["warc-type"], bytes(r.block).decode()) for r in back] == [(got[i].record_type, (h or "") if got[i].record_type == "response" else "") for i, _, h in PAGES]


def test_damaged_archive_is_refused(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archive(pages(spark, PAGES), path)
    blobs = spark.read.parquet(f"{path}/blobs").toPandas()
    blobs["payload"] = blobs["payload"].map(lambda b: bytes(b) + b"!")
    spark.createDataFrame(blobs).write.mode("overwrite").parquet(f"{path}/blobs")
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, path).collect()
    blobs["payload"] = [warc.pack(b"other") for _ in blobs["payload"]]
    spark.createDataFrame(blobs).write.mode("overwrite").parquet(f"{path}/blobs")
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, path).collect()
    spark.createDataFrame(blobs).limit(0).write.mode("overwrite").parquet(f"{path}/blobs")
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, path).collect()


def test_archive_of_nothing_and_of_repeated_rows(spark, tmp_path):
    warc.write_archive(pages(spark, []), str(tmp_path / "none"))
    assert warc.read_archive(spark, str(tmp_path / "none")).count() == 0
    warc.write_archive(pages(spark, [(1, "u", "x"), (1, "u", "x"), (None, "u", "x")]), str(tmp_path / "twice"))
    got = warc.summary(warc.record_bytes(warc.read_archive(spark, str(tmp_path / "twice")))).collect()
    assert sorted((str(r.page_id), r.record_type) for r in got) == [("1", "response"), ("1", "response"), ("None", "revisit")]


# -- secrets


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(8)
    bits = ["token = ", "API_KEY:", "passwd=", "ſecret=", "abc", "0f" * 13, "0f" * 11 + "g", "AKIA", "AKIA" + "Q7" * 9, " ", "'", "é", "\n", "secret: token : abcdefgh", "x" * 7, "日本", "A1b2C3d4E5f6G7h8I9j0KkLl"]
    rows = ODD + [(10 + i, "".join(rng.choices(bits, k=12)), "s") for i in range(150)]
    got = {(r.doc_id, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in secrets.find_secrets(docs(spark, rows)).collect()}
    kinds = [(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24)]
    want = set()
    for i, t, _ in rows:
        spans = sorted((m.start(), k, m.end()) for k, (p, g, n) in enumerate(kinds) for m in re.finditer(p, t or "") if len(m[g]) >= n)
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        want.add((i, hashlib.sha256(text.encode()).hexdigest(), *(sum(k == x for _, k, _ in spans) for x in range(3))))
    assert got == want


def test_entropy_windows_and_allow_list():
    found = lambda t: secrets.scan(t)[1]
    key = "q7Zt2Lx9Vb4Nc8Kd1Rf6Wg3Hj5"
    assert [k for _, k, _ in found(f"key {key} end")] == [4]
    assert not found("An ordinary extraordinarilylongwordwithoutdigits stays clean, as does number20240101000000000000.")
    assert not found("id 123e4567-e89b-12d3-a456-426614174000 and example_" + key)
    assert not found("aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1111111111")
    rng = random.Random(4)
    for _ in range(30):
        run = "".join(rng.choices("abcdef0123456789", k=60))
        inside = [False] * 60
        for s in range(41):
            counts = [run[s : s + 20].count(c) for c in set(run[s : s + 20])]
            if -sum(c / 20 * np.log2(c / 20) for c in counts) >= 3.3 - 1e-9:
                inside[s : s + 20] = [True] * 20
        got = [False] * 60
        for a, b in secrets.high_windows(run, 3.3):
            got[a:b] = [True] * (b - a)
        assert got == inside


@pytest.mark.parametrize("chars", ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789ABCDEF"])
def test_random_keys_are_found_whatever_their_digits(chars):
    rng = random.Random(5)
    keys = ["".join(rng.choices(chars, k=32)) for _ in range(200)]
    assert sum(bool(secrets.scan(f"say {k} end")[1]) for k in keys) >= 198


def test_allow_list_looks_at_the_value_and_its_name_only():
    key = "q7Zt2Lx9Vb4Nc8Kd1Rf6Wg3Hj5"
    near = ["        key: {}", "======\n{}", "{} ------", "see api.example.com, {}", "a sample: x {}", "https://h/example/{}", "123e4567-e89b-12d3-a456-426614174000 {}", "example.com:{}"]
    for text in near:
        at = text.index("{}")
        assert any(a <= at and at + len(key) <= b for a, _, b in secrets.scan(text.format(key))[1]), text
    for text in ["your_key = '{}'", '"sampleKey": "{}"', "{}_EXAMPLE", "dummy-{}", "sha256-{}", "id-123e4567-e89b-12d3-a456-426614174000-x"]:
        assert not secrets.scan(text.format(key))[1], text


def test_a_part_already_found_does_not_hide_the_rest():
    for key in ["q7Zt2Lx9Vb4Nc8Kd1Rf6Wg3H+j5Ts0/Ym2Pk8Qe", "q7Zt+2Lx9Vb4Nc8Kd1Rf6Wg3Hj5Ts0-Ym_2Pk8Qe", "0f1e2d3c4b5a69788796a5b4/q7Zt2Lx9Vb4N+c8Kd1Rf6Wg3Hj5"]:
        base, more = secrets.scan(f"say {key} end")
        assert secrets.mask(f"say {key} end", base + more) == "say [SECRET] end"
        assert len(more) == 1
    assert not secrets.scan("token = q7Zt2Lx9Vb4Nc8Kd1Rf6Wg3H+j5Ts0")[1]


def test_time_is_linear_in_runs_whatever_the_alphabet():
    def seconds(text):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            found = secrets.scan(text)
            took.append(time.perf_counter() - began)
        return min(took), found

    unit = "q7Zt2Lx9Vb4Nc8Kd1Rf6Wg3Hj5 " + "word " * 6
    plain, (_, ascii_spans) = seconds(("e " + unit) * 6_000)
    other, (_, spans) = seconds(("é " + unit) * 6_000)
    assert spans == ascii_spans and len(spans) == 6_000
    assert other < 1.5 * plain + 0.2


def test_a_long_random_text_is_one_span_and_equal_spans_are_told_once():
    rng = random.Random(3)
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=100_000))
    base, more = secrets.scan(f"é {long} end")
    covered = sum(b - a for a, _, b in more)
    assert covered >= 0.99 * len(long) and all(2 <= a and b <= 2 + len(long) for a, _, b in more)
    key = "0123fedcba98a7c5e3b1d2f4"[::-1]
    assert len(secrets.scan(f"x {key.upper()} y")[1]) == 1  # hexadecimal, alphanumeric and base64 alike


def test_mask(spark):
    got = secrets.find_secrets(docs(spark, [(1, "é token = abcdef12 x", "s"), (2, None, "s")]), masked=True).collect()
    assert {r.doc_id: r.masked for r in got} == {1: "é [SECRET] x", 2: None}


# -- classifiers


def prose(rng, n):
    return " ".join("".join(rng.choices("etaoinshr", k=rng.randrange(2, 9))) for _ in range(n))


def test_quality_on_held_out_rows(spark):
    rng = random.Random(6)
    rows, labels = list(ODD), [(0, 1, 0), (None, None, None), (1, None, 1)]
    for i in range(10, 410):
        text = prose(rng, rng.randrange(20, 120))
        bad = i % 4 == 0
        rows.append((i, " ".join(w.upper() + "!!" for w in text.split()) if bad else text.capitalize() + ".", "s"))
        labels.append((i, int(not bad), 0))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(docs(spark, rows), table).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 10]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    none = quality.classify(docs(spark, rows[:12]), table.limit(0)).collect()
    assert {round(r.score, 9) for r in none} == {0.5}
    assert quality.classify(docs(spark, []), table).count() == 0


def test_toxicity_catches_unseen_misspellings(spark):
    rng = random.Random(7)
    rows, labels = list(ODD), []
    for i in range(10, 610):
        words = prose(rng, rng.randrange(15, 90)).split()
        bad = i % 3 == 0
        if bad:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "blockheads", "nitwit", "nitwits"]))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(bad)))
    rows += [(5000, "hardly a blockhed here " + prose(rng, 20), "s"), (5001, prose(rng, 40), "s")]
    got = {r.doc_id: r for r in toxicity.classify(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert got[5000].score > got[5001].score
    assert all(0 <= r.score <= 1 for r in got.values())


def test_disguised_spellings_are_one_word_and_share_ngrams():
    assert toxicity.words_of("you 1d10t, st*pid (M0R0N) h4te: 2024 -- x2!") == ["you", "idiot", "st*pid", "moron", "hate", "x2"]
    rng = random.Random(11)
    insults = ["idiot", "stupid", "moron"]
    texts = [" ".join(prose(rng, 20).split() + ([rng.choice(insults)] if i % 2 else [])) for i in range(200)]
    model = toxicity.train_texts(texts, np.array([i % 2 for i in range(200)]), epochs=20)
    clean = toxicity.Scorer(model).margins([prose(rng, 20) for _ in range(20)])
    told = toxicity.Scorer(model).margins([prose(rng, 8) + f" {w} " + prose(rng, 8) for w in ("1d10t", "st*pid", "m0r0n", "1diot!!", "stupidd", "m0ron")])
    assert told.min() > np.median(clean) and np.mean(told > clean.max()) >= 0.8


def test_bags_equal_plain_ngrams():
    rng = np.random.default_rng(4)
    table = rng.normal(size=(1 << toxicity.BITS, 3))
    words, m = ["ab", "stupid", "é*x", "a" * 70], 1 << 64
    bags = toxicity._Bags(words)
    got = bags.means(table, np.array([3, 0, 2, 1]))
    for row, word in zip(got, ["a" * 70, "ab", "é*x", "stupid"]):
        raw, found = b"<" + word.encode() + b">", []
        for n in (3, 4, 5, 6):
            for at in range(len(raw) - n + 1):
                h = raw[at] + 1
                for c in raw[at + 1 : at + n]:
                    h = (h * 0x100000001B3 + c + 1) % m
                found.append((h * 0x9E3779B97F4A7C15 % m) >> (64 - toxicity.BITS))
        whole = sum((c + 7) * pow(0x100000001B3, k % 64, m) for k, c in enumerate(raw)) % m
        found.append(((whole * 0x9E3779B97F4A7C15 + 0xABCDEF) % m) >> (64 - toxicity.BITS))
        assert np.allclose(row, table[found].mean(axis=0))
    values = rng.normal(size=17)
    plain = [values[a : a + toxicity.WINDOW].mean() for a in toxicity._windows(17)]
    assert np.allclose(toxicity._window_means(values), plain)


def test_log_count_ratios_equal_plain_counts():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 50, rng.integers(1, 20))).astype(np.int32) for _ in range(60)]
    y = rng.integers(0, 2, 60)
    got = quality.log_count_ratio(rows, y)
    count = lambda f, c: 1.0 + sum(f in r for r, label in zip(rows, y) if label == c)
    total = {c: sum(count(f, c) for f in range(50)) + (1 << quality.BITS) - 50 for c in (0, 1)}
    for f in range(60):
        p, q = count(f, 1) / total[1], count(f, 0) / total[0]
        assert got[f] == pytest.approx(np.log(p / q) if count(f, 0) + count(f, 1) >= 5 else 0)


def test_dual_coordinate_descent_finds_the_least_hinge_loss():
    rng = np.random.default_rng(7)
    rows = [np.sort(rng.choice(12, 5, replace=False)).astype(np.int32) for _ in range(50)]
    values = [rng.normal(size=5) for _ in rows]
    sign, cost = rng.choice([-1.0, 1.0], 50), rng.uniform(0.2, 1.0, 50)
    w = quality.dual_coordinate_descent(rows, values, sign, cost, epochs=3000)
    bias = 1 << quality.BITS

    def loss(w):
        return 0.5 * w @ w + sum(c * max(0.0, 1 - s * (w[r] @ v + w[bias])) for r, v, s, c in zip(rows, values, sign, cost))

    for _ in range(300):
        step = np.zeros_like(w)
        step[[*range(12), bias]] = rng.normal(size=13) * rng.choice([0.001, 0.01, 0.1])
        assert loss(w + step) >= loss(w) - 1e-3


def test_sample_of_repeated_ids_is_bounded(spark):
    rows = [(7, f"text {i}", "s") for i in range(40)] + [(8, "x", "s"), (None, "y", "s")]
    table = spark.createDataFrame([(7, 1, 0), (7, 1, 0), (8, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = labelled.sample(docs(spark, rows), table, "quality", F.lit(True), 10, 1).collect()
    assert sorted((r.doc_id, r.y) for r in got) == [(7, 1), (8, 0)]


def test_every_part_of_a_fit_has_a_task_of_its_own(spark):
    rows = spark.createDataFrame([(i, str(i), i % 2) for i in range(40)], "doc_id long, text string, y int")
    seen = labelled.fit_in_tasks(rows, lambda frame, part: {"ids": frame["doc_id"].to_numpy(), "task": np.array([pyspark.TaskContext.get().partitionId()])}, 5)
    assert sorted(seen) == list(range(5)) and all(f["ids"].tolist() == list(range(40)) for f in seen.values())
    assert len({int(f["task"][0]) for f in seen.values()}) == 5


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.array(sorted({int(x) for x in rng.integers(10, 90, 6)} | {5 if y else 6}), np.int32) for y in range(2) for _ in range(40)]
    sign = np.array([-1.0] * 40 + [1.0] * 40)
    w = quality.dual_coordinate_descent(rows, [np.ones(len(r)) for r in rows], sign, np.ones(80))
    assert all(np.sign(w[r].sum() + w[-1]) == s for r, s in zip(rows, sign))
