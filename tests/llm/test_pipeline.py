"""The pipeline against a brute-force version on a small fixture, and the corpus part of the entry point."""

import random
import re
import zlib
from fractions import Fraction

import pytest

pytest.importorskip("annolith.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from pyspark.sql import functions as F  # noqa: E402

from annolith.llm import exact_dedup, labelled, mixing, near_dedup, packing, quality, shingles  # noqa: E402


def fixture_rows():
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("etaoinshrdl", k=rng.randrange(2, 9)))
    rows, labels = [], []
    for i in range(160):
        text = " ".join(word() for _ in range(rng.randrange(8, 60)))
        good = i % 4 != 0
        rows.append([i, text + "." if good else " ".join(w.upper() + "!!" for w in text.split()), "en", f"src{i % 4}", 0])
        labels.append((i, int(good), 0))
    for i in range(160, 190):  # copies: exact but for white space, and near
        base = rows[(i * 7) % 160]
        words = base[1].split()
        if i % 2:
            words[-1] = "changed."
        rows.append([i, "  ".join(words), "en", "src9", 0])
    rows += [[190, None, "en", "src1", 0], [191, "", None, None, None]]
    return rows, labels


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, labels = fixture_rows()
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = quality.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    left = [r for r, s in zip(rows, quality.score_texts(model, [r[1] or "" for r in rows])) if s >= 0.5]
    assert {r[0] for r in left} >= {i for i, good, _ in labels if good}
    groups: dict = {}
    for r in left:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    left = sorted(min(g, key=lambda r: (-len(r[1] or ""), r[0])) for g in groups.values())
    sets = {r[0]: set(shingles.shingle_set(r[1], 5).tolist()) for r in left}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    left = [r for r in left if root(r[0]) == r[0]]
    sizes: dict = {}
    for r in left:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    pieces = {(r.doc_id, r.piece): r.ids_crc32 for r in got}
    copies: dict = {}
    for r in got:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    words = {r[0]: (len((r[1] or "").split()), r[3], r[1]) for r in left}
    assert set(copies) <= set(words) and set(copies.values()) <= {1, 2}
    assert sum(words[i][0] * n for i, n in copies.items()) == pytest.approx(1.5 * sum(sizes.values()), abs=len(sizes))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    from test_corpus_ops import brute_targets

    for s, t in zip(order, brute_targets([sizes[s] for s in order])):
        assert abs(sum(words[i][0] * n for i, n in copies.items() if words[i][1] == s) - t) <= 1
    for (i, k), crc in pieces.items():
        ids = [*packing.encode(words[i][2]).tolist(), 0]
        assert k == 0 and crc == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
    assert all(r.offset + r.length <= 2048 for r in got)


def test_stages_take_an_empty_table(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_tell_rows_of_null_and_repeated_ids_apart(spark):
    from annolith.llm import exact_dedup, mixing, near_dedup

    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    rng = random.Random(3)
    words = lambda n: ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]
    kept = lambda stage, rows: sorted(map(str, (tuple(r) for r in stage(table(rows)).collect())))
    texts = [" ".join(words(40)) for _ in range(6)]
    near = " ".join([*texts[0].split()[:-1], "changed"])
    row = lambda i, t, s="a": (i, t, "en", s, 0)

    # Exact: of id 7 one text is a copy that goes, of null two texts stay and one goes.
    rows = [row(1, texts[0] + " "), row(7, texts[0]), row(7, texts[1]), row(None, texts[2]), row(None, texts[3]), row(None, texts[1], "b"), row(None, texts[3])]
    assert kept(exact_dedup.keep_rows, rows) == sorted(str(rows[i]) for i in (0, 2, 3, 4))
    # Near: a copy that goes takes no other row of its id along; of copies with one id or none, one stays.
    rows = [row(1, texts[0]), row(None, near), row(None, texts[1]), row(None, texts[2]), row(None, ""), row(None, "")]
    assert kept(near_dedup.keep_rows, rows) == sorted(str(rows[i]) for i in (0, 2, 3, 4, 5))
    for i in (None, 5):
        assert near_dedup.keep_rows(table([row(i, texts[0]), row(i, near), row(i, texts[3])])).count() == 2
    # Mixing: the words taken are those that the decisions say, also for one text many times under no id.
    rows = [row(None if k % 2 else 7, " ".join(words(1 + k % 9)), "ab"[k % 3 == 0]) for k in range(80)] + [(None, "x y z", "en", "a", k) for k in range(41)]
    told = mixing.mix(table(rows)).groupBy("source").sum("taken").collect()
    got: dict = {}
    for r in mixing.mixed_rows(table(rows)).collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    assert got == {r[0]: r[1] for r in told}
    assert mixing.mixed_rows(table(rows), broadcast_rows=0).count() == mixing.mixed_rows(table(rows)).count()


def test_stages_keep_columns_of_any_name_and_join_where_decisions_are_too_many(spark):
    from annolith.llm import exact_dedup, mixing, near_dedup

    rng = random.Random(21)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    extra = ["_id", "_key", "_times", "_gone", "_keep", "_copy", "copies", "row", "doc", "token", "id", "key", "over", "block", "a.b"]
    base = [words(30) for _ in range(8)] + [words(9_000), "", None]
    rows = []
    for k in range(70):
        text = base[k % len(base)]
        if text and k % 3 == 0:
            text = text.replace(" ", "  ", 1 + k % 4)
        elif text and k % 5 == 0:
            text = text.rsplit(" ", 1)[0] + " other"
        rows.append((None if k % 7 == 0 else k // 2, text, "en", ["a", "b", None][k % 3], k, *(f"{c}{k}" for c in extra)))
    rows += rows[:9] * 3  # repeated rows
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    table = spark.createDataFrame(rows, schema).repartition(4)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")

    got = [tuple(r) for r in exact_dedup.keep_rows(table, broadcast_rows=0).collect()]
    assert set(got) <= set(rows) and len(got) == len({norm(r[1]) for r in rows}) == len({norm(r[1]) for r in got})
    best: dict = {}
    for r in rows:
        best[norm(r[1])] = min(best.get(norm(r[1]), (1,)), (-len(r[1] or ""), r[0] is None, r[0] or 0))
    assert all(best[norm(r[1])] == (-len(r[1] or ""), r[0] is None, r[0] or 0) for r in got)

    sets = [set(shingles.shingle_set(r[1], 5).tolist()) for r in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                up[b] = a
    kept = [tuple(r) for r in near_dedup.keep_rows(table, broadcast_rows=0).collect()]
    assert set(kept) <= set(rows) and len(kept) == len({root(x) for x in range(len(rows))})
    where: dict = {}
    for x, r in enumerate(rows):
        where.setdefault(r, root(x))
    assert sorted(where[r] for r in kept if r[1]) == sorted({root(x) for x, r in enumerate(rows) if r[1]})

    told: dict = {}
    for r in mixing.mix(table).collect():
        told[r.doc_id, r.source, r["size"]] = told.get((r.doc_id, r.source, r["size"]), 0) + r.copies
    mixed: dict = {}
    for r in mixing.mixed_rows(table, broadcast_rows=0).collect():
        assert tuple(r) in set(rows)
        key = (r.doc_id, r.source, len((r.text or "").split()))
        mixed[key] = mixed.get(key, 0) + 1
    assert mixed == {k: n for k, n in told.items() if n}


def test_stages_keep_maps_and_variants(spark):
    """Columns that Spark does not hash, with rows of one id that differ in them alone."""
    texts = {1: "one two three four five six seven", 2: "other words that are here alone", 3: "and a third text of some words"}
    rows = [(i, t, "en", "s", 9, m) for i, t in texts.items() for m in ("a", "b")]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, m string")
    made = made.withColumns({"meta": F.create_map("m", F.lit(1)), "nested": F.struct(F.array(F.create_map("m", "m")).alias("x")), "free": F.try_parse_json(F.concat(F.lit('{"k": "'), "m", F.lit('"}')))})
    shown = lambda df: sorted((r.doc_id, r.m, r.k, r.f) for r in df.select("doc_id", "m", F.map_keys("meta")[0].alias("k"), F.to_json("free").alias("f")).collect())
    for stage in (exact_dedup.keep_rows, near_dedup.keep_rows):
        kept = stage(made)
        assert kept.schema.simpleString() == made.schema.simpleString()
        assert {r[0] for r in shown(kept)} == {1, 2, 3} and all(r[1] == r[2] and r[1] in r[3] for r in shown(kept))
    mixed = mixing.mixed_rows(made)
    assert mixed.count() >= 6 and all(r[1] == r[2] and r[1] in r[3] for r in shown(mixed))


def test_scores_are_calibrated():
    import numpy as np

    rng = np.random.default_rng(1)
    y = (rng.random(4000) < 0.5).astype(int)
    margins = (y - 0.5) * 2 + rng.normal(0, 1, 4000)
    a, c = labelled.calibrate(margins, y, (9000, 1000))
    right = lambda t: (0.9 * (margins[y == 0] < t).mean() + 0.1 * (margins[y == 1] >= t).mean())
    assert a > 0 and right(-c / a) >= max(right(t) for t in np.linspace(-3, 4, 200)) - 0.005
    # A few wrong labels far away leave the threshold where it is.
    apart = np.concatenate([np.full(500, -1.0), np.full(500, 1.0), np.full(20, -30.0)])
    a, c = labelled.calibrate(apart, np.array([0] * 500 + [1] * 520), (500, 500))
    assert -1 < -c / a < 1
    assert all(np.isfinite(labelled.calibrate(np.zeros(4), np.array([0, 0, 1, 1]), (2, 2))))


def test_every_operator_is_registered():
    from annolith.llm import catalogue

    assert [q.split("_")[0] for q in catalogue.queries()] == [f"op{n}" for n in range(1, 14)]
    assert Fraction(3, 2) == Fraction("1.5")
