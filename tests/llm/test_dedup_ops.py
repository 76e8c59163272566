"""Exact dedup, near-dedup and line dedup against brute force, and their defined edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest

pytest.importorskip("annolith.llm")
from annolith.llm import components, exact_dedup, line_dedup, near_dedup, shingles  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_sha256 string, node long, fp long"


def docs(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", s, 0, "clash", 7, 9) for i, t, s in rows], schema).repartition(3)


ODD = [(None, None, None), (0, "", "a"), (1, " \t\n", None), (2, "a b", "a"), (3, "ab", "b"), (3, "ab", "b"), (4, "a b", "a"), (5, "é" * 300_000, "a"), (6, "é " * 300_000, "b"), (None, "ab", None)]


def test_exact_dedup_equals_brute_force(spark):
    rows = ODD + [(10 + i, random.Random(i % 7).choice(["x y z", "xyz", "q", ""]) + str(i % 5), "s") for i in range(60)]
    got = exact_dedup.dedup(docs(spark, rows)).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups: dict = {}
    for i, t, _ in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    want = sorted((str(i), str(min(groups[norm(t)])[3]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, _ in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len(groups)


def test_exact_dedup_joins_when_fingerprints_are_too_many_to_broadcast(spark):
    rows = [(i, f"t{i % 9}", "s") for i in range(40)]
    a = exact_dedup.dedup(docs(spark, rows)).toPandas().sort_values("doc_id").to_dict("list")
    b = exact_dedup.dedup(docs(spark, rows), broadcast_rows=0).toPandas().sort_values("doc_id").to_dict("list")
    assert a == b


def test_exact_dedup_of_nothing_and_of_repeated_rows(spark):
    assert exact_dedup.dedup(docs(spark, [])).count() == 0
    stay = exact_dedup.keep_rows(docs(spark, [(1, "a", "s"), (1, "a", "s"), (2, "a ", "s"), (3, "b", None)]))
    assert sorted(r.doc_id for r in stay.collect()) == [2, 3]
    assert exact_dedup.keep_rows(docs(spark, [(1, "a", "s"), (1, "a", "s")])).count() == 1


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
    parts = [rng.choice(values, 400) for _ in range(4)]
    cqf = exact_dedup.CountingQuotientFilter
    whole = cqf.merged_all([cqf.build(p) for p in parts])
    want, counts = np.unique(np.concatenate(parts), return_counts=True)
    found = whole.sorted()
    assert (found[0] == want).all() and (found[1] == counts).all()
    back = cqf.merged_all([cqf.unpacked(v, c) for _, v, c in whole.ranges(5)]).sorted()
    assert (back[0] == want).all() and (back[1] == counts).all()
    asked = np.concatenate([want, want + np.uint64(1)])
    assert (whole.count_of(asked) == np.concatenate([counts, np.zeros(len(want), int)])).all()


def test_quotient_filter_slots_are_read_by_their_bits():
    # Quotients 1, 1, 2, 5 of 8 slots: the run of 2 is shifted by that of 1, 5 stands where it belongs.
    values = np.array([(1 << 61) + 4, (1 << 61) + 9, (2 << 61) + 7, (5 << 61) + 1], np.uint64)
    f = exact_dedup.CountingQuotientFilter.of_sorted(values, np.array([1, 2, 3, 4]))
    assert f.bits == 3 and np.flatnonzero(f.occupied).tolist() == [1, 2, 5]
    assert np.flatnonzero(f.continuation).tolist() == [2] and np.flatnonzero(f.shifted).tolist() == [2, 3]
    assert f.remainders[[1, 2, 3, 5]].tolist() == [4, 9, 7, 1] and f.counts[[1, 2, 3, 5]].tolist() == [1, 2, 3, 4]
    empty = exact_dedup.CountingQuotientFilter.build(np.zeros(0, np.uint64))
    assert [x.tolist() for x in empty.merged(f).sorted()] == [values.tolist(), [1, 2, 3, 4]]


def near_brute(rows, width):
    sets = [set(shingles.shingle_set(t, width).tolist()) for _, t, _ in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                up[root(x)] = root(y)
    out = []
    for x, (i, _, _) in enumerate(rows):
        ids = [rows[y][0] for y in range(len(rows)) if root(y) == root(x) and rows[y][0] is not None]
        out.append((str(i), len(sets[x]), str(min(ids, default=None)) if sets[x] else str(i)))
    return sorted(out)


def variants(n, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    base = [word() for _ in range(120)]
    out = []
    for i in range(n):
        text = list(base) if i % 3 else [word() for _ in range(60)]
        for _ in range(rng.randrange(9)):
            text[rng.randrange(len(text))] = word()
        out.append((100 + i, " ".join(text), "s"))
    return out


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(near_dedup, "SET_BLOCK", 5)
    rows = [r for r in ODD if len(r[1] or "") < 1000] + variants(90) + [(900, "A b C", "s"), (901, "a B c", "s"), (902, "one", "s")]
    got = near_dedup.near_duplicates(docs(spark, rows), width=4).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == near_brute(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_near_duplicates_of_a_common_bucket_are_found_in_smaller_ones(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LARGE", 2)
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 4)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage = [word() for _ in range(60)]  # that every text shares
    rows = [(i, " ".join(passage + [word() for _ in range(30)]), "s") for i in range(40)]
    for i in range(40, 70):
        text = rows[i % 20][1].split()
        text[-1 - i % 9] = word()
        rows.append((i, " ".join(text), "s"))
    got = near_dedup.near_duplicates(docs(spark, rows), width=4).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == near_brute(rows, 4)


def test_near_duplicates_join_when_candidates_are_too_many_to_broadcast(spark):
    rows = variants(30)
    got = near_dedup.near_duplicates(docs(spark, rows), width=4, broadcast_rows=0).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == near_brute(rows, 4)


def test_near_duplicates_of_nothing_and_of_a_very_long_text(spark):
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0
    long = " ".join(str(i * 7919 % 100_003) for i in range(60_000))
    got = near_dedup.near_duplicates(docs(spark, [(1, long, "s"), (2, long + " end", "s"), (3, "x", "s")]), width=4).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_estimates_are_near_the_similarity():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.8, 0.95):
        a = np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(2 * len(a) * share / (1 + share))], rng.integers(0, 1 << 63, len(a) - int(2 * len(a) * share / (1 + share)), dtype=np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        one, two = (shingles.packed(shingles.minima(x))[None] for x in (a, b))
        assert abs(shingles.estimate(one, two)[0] - true) < 0.12


def test_components_take_logarithmic_rounds(spark, monkeypatch):
    made = []
    monkeypatch.setattr(components.Scratch, "table", lambda self, df, own=components.Scratch.table: made.append(1) or own(self, df))
    rng = random.Random(2)
    order = list(range(1000))
    rng.shuffle(order)
    for nodes in (list(range(2000)), order):
        made.clear()
        got = components.connected(spark.createDataFrame(list(zip(nodes, nodes[1:])), "a long, b long")).collect()
        assert {r.node for r in got} == set(nodes) and {r.comp for r in got} == {0}
        assert len(made) <= 45  # tables written; a step at a time took three for each node of a chain


def test_components_of_random_graphs_equal_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)]
    up = list(range(400))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r.node: r.comp for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in {n for e in edges if e[0] != e[1] for n in e}}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20, 40)] + [(100, i) for i in range(101, 130)] + [(5, 5)]
    got = {r.node: r.comp for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 20 for i in range(20, 41)} | {i: 100 for i in range(100, 130)}


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_line_dedup_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "_bounded", lambda keys, own=line_dedup._bounded: own(keys, most))
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice([" Menu", "Menu ", "Foot\t", f"own {i}", "", "rare"]) for _ in range(6)), f"site{i % 12}" if i % 13 else None) for i in range(80)] + ODD + [(0, "Menu\nx", "a"), (0, "Menu\nx", "a")]
    sites: dict = {}
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if line.strip(" \t\n\x0b\x0c\r"):
                sites.setdefault(line.strip(" \t\n\x0b\x0c\r"), set()).add(s)
    want = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if len(sites.get(x.strip(" \t\n\x0b\x0c\r"), ())) < 8]
        want.append((str(i), len(lines), len(lines) - len(left), t if len(left) == len(lines) else "\n".join(left)))
    got = line_dedup.remove_boilerplate(docs(spark, rows)).collect()
    assert sorted(map(str, want)) == sorted(str((str(r.doc_id), r.n_lines, r.n_removed, r.text)) for r in got)
    assert line_dedup.remove_boilerplate(docs(spark, [])).count() == 0
