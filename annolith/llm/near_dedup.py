"""MinHash near-dedup: b-bit signatures, band candidates, links confirmed on full shingle sets.

1. Every text becomes its set of word shingles, and that a signature of 256 minima. Bands of full minima give
   candidate buckets; low bits of the minima are packed, and similarity is estimated from their agreement, corrected
   for chance. Texts with equal sets become one node.
2. Star round: each node meets the smallest node of each of its buckets; the one with the best estimate is confirmed
   on full sets. That joins nearly all of a group of copies at a cost linear in its size.
3. Rest round, for buckets whose members are still in different components: all pairs between components are estimated
   block by block inside tasks; members of a large bucket are first dealt to smaller ones by further bands, so that
   no work grows with the square of a common bucket. Only a spanning forest of the promising pairs leaves a task.
   Groups of promising nodes meet again with their full sets, block by block; only confirmed links (a forest) leave.
4. Components of all links; each takes its smallest doc_id.

No cap is set on buckets, groups or partners, and no pairs of a group are listed. A pair of similarity 0.8 is missed
if it shares no band (chance below 5e-8) or if its estimate is below FLOOR (six standard errors).

Null and empty texts, and texts of white space, have no shingles and are linked with nothing. Null ids never become a
component's id unless it has no other. Repeated rows are one node. An empty table gives an empty result. Columns that
are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from annolith.llm import shingles
from annolith.llm.common import Scratch, map_batches, materialize, release, repeat_rows, row_key
from annolith.llm.components import connected

#: Similarity in hundredths for a link; estimates below FLOOR are not confirmed.
LINK = 80
FLOOR = 0.65
#: Members of a bucket or group that meet in one task: two blocks at most. Blocks with sets are also bounded in bytes.
BUCKET_BLOCK, SET_BLOCK, SET_BYTES = 1024, 1024, 16 << 20
#: A bucket with more members than this besides its largest component is dealt to smaller ones.
LARGE = 8192


def _describe(width: int):
    def make(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_shingles", "f1", "f2", "bands", "sig")} | {k: cols[k] for k in ("text_hash", "row") if k in cols}
        for doc_id, text in zip(cols["doc_id"], cols["text"], strict=True):
            own = shingles.shingle_set(text, width)
            f = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
            least = shingles.minima(own) if len(own) else None
            row = (doc_id, len(own), int(f[0]), int(f[1]), shingles.band_keys(least) if len(own) else [], shingles.packed(least).tobytes() if len(own) else b"")
            for column, value in zip(list(out.values())[: len(row)], row, strict=True):
                column.append(value)
        return out

    return make


def _with_sets(width: int):
    def make(cols: dict[str, list]) -> dict[str, list]:
        nodes, sets = [], []
        for node, text, f1, f2 in zip(cols["node"], cols["text"], cols["f1"], cols["f2"], strict=True):
            own = shingles.shingle_set(text, width)
            if np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64).tolist() == [f1, f2]:
                nodes.append(node)
                sets.append(own.tobytes())
        return {"node": nodes, "set": sets}

    return make


def _signatures(blobs: pd.Series | np.ndarray | list) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)


def linked(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two sorted sets have 100 * intersection >= LINK * union."""
    if len(one) > len(two):
        one, two = two, one
    at = np.minimum(np.searchsorted(two, one), len(two) - 1)
    both = int((two[at] == one).sum())
    return 100 * both >= LINK * (len(one) + len(two) - both)


@F.pandas_udf(DoubleType())
def _estimate(one: pd.Series, two: pd.Series) -> pd.Series:
    return pd.Series(shingles.estimate(_signatures(one), _signatures(two)) if len(one) else [])


@F.pandas_udf(BooleanType())
def _linked(one: pd.Series, two: pd.Series) -> pd.Series:
    return pd.Series([linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(one, two, strict=True)], dtype=bool)


# -- blocks of members -------------------------------------------------------------------------------------------


def spread(members: DataFrame, key: str, scratch: Scratch, weight: Column | None = None) -> DataFrame:
    """(key, top, major, rest) of each key whose members (key, node, comp) are in several components: weight and name of
    the largest one, and weight of all others. A member weighs 1, or more if it is large."""
    counts = members.groupBy(key, "comp").agg(F.sum(F.lit(1.0) if weight is None else F.greatest(F.lit(1.0), weight)).alias("n"))
    sizes = counts.groupBy(key).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("comps"), F.max(F.struct("n", "comp")).alias("largest"))
    return scratch.table(sizes.filter("comps > 1").select(key, F.col("largest.n").alias("top"), F.col("largest.comp").alias("major"), (F.col("total") - F.col("largest.n")).alias("rest")))


def blocked(members: DataFrame, sizes: DataFrame, key: str, size: int) -> DataFrame:
    """members (key, node, comp, ...) dealt to pairs of blocks (key, i, j), so that each two members of one key and
    different components meet in one pair of blocks. A key's largest component never meets itself.
    """
    minors, majors = (F.greatest(F.lit(1), F.ceil(F.col(c) / size).cast("int")) for c in ("rest", "top"))
    dealt = members.join(sizes.select(key, "major", minors.alias("minors"), majors.alias("majors")), key).withColumn("own", F.col("comp") == F.col("major"))
    place: Column = F.xxhash64("node", F.lit(77))
    dealt = dealt.withColumn("block", F.when(F.col("own"), F.col("minors") + F.pmod(place, F.col("majors"))).otherwise(F.pmod(place, F.col("minors"))).cast("int"))
    others = F.when(F.col("own"), F.sequence(F.lit(0), F.col("minors") - 1)).otherwise(F.sequence(F.lit(0), F.col("minors") + F.col("majors") - 1))
    dealt = dealt.withColumn("other", F.explode(others))
    return dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("own", "major", "minors", "majors", "other")


def deepened(members: DataFrame, about: DataFrame) -> DataFrame:
    """(band, node, comp) of smaller buckets for members of large ones: each again by bands of the minima that the first
    bands leave out. A pair at similarity 0.8 that met in the large bucket meets again but for a chance below 5e-8."""
    width = shingles.ROWS * shingles.KEPT_BITS // 8
    left_out = shingles.BANDS * width + 1
    keys = F.transform(F.sequence(F.lit(0), F.lit(shingles.BANDS - 1)), lambda k: F.xxhash64("band", k, F.substr("sig", F.lit(left_out) + k * width, F.lit(width))))
    return members.join(about.select("node", "sig"), "node").select("node", "comp", F.explode(keys).alias("band"))


def per_group(dealt: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], list[tuple[int, int]]]) -> DataFrame:
    """Edges (a, b) of work(group) for each group of rows with equal keys. Groups are runs of sorted rows, many a batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def finish(frame: pd.DataFrame) -> pd.DataFrame:
            change = np.zeros(len(frame), bool)
            for k in keys:
                values = frame[k].to_numpy()
                change[1:] |= values[1:] != values[:-1]
            cuts = [0, *np.flatnonzero(change), len(frame)]
            edges = [e for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1 for e in work(frame.iloc[a:b])]
            return pd.DataFrame(edges, columns=["a", "b"], dtype=np.int64)

        for frame in frames:
            if not len(frame):
                continue
            same = np.ones(len(frame), bool)
            for k in keys:
                same &= (frame[k] == frame[k].iloc[-1]).to_numpy()
            first = len(frame) if not same.any() else int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0
            if first:
                yield finish(pd.concat([*held, frame.iloc[:first]], ignore_index=True))
                held = []
            elif held and any(held[-1][k].iloc[-1] != frame[k].iloc[0] for k in keys):
                yield finish(pd.concat(held, ignore_index=True))
                held = []
            held.append(frame.iloc[first:])
        if held:
            yield finish(pd.concat(held, ignore_index=True))
        held.clear()
        release()

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "a long, b long")


class _Forest:
    """Union-find over the members of one group."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _promising(group: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(x, ys, estimates): member x and the later members that it may be linked with."""
    comp, n, block = (group[c].to_numpy() for c in ("comp", "n", "block"))
    sig = _signatures(group["sig"].to_numpy())
    within = bool(group["i"].iloc[0] == group["j"].iloc[0])
    for x in range(len(group) - 1):
        ok = (comp[x + 1 :] != comp[x]) & (100 * np.minimum(n[x + 1 :], n[x]) >= LINK * np.maximum(n[x + 1 :], n[x]))
        if not within:
            ok &= block[x + 1 :] != block[x]
        ys = np.flatnonzero(ok) + x + 1
        if len(ys):
            about = shingles.estimate(sig[ys], sig[x])
            good = about >= FLOOR
            if good.any():
                yield x, ys[good], about[good]


def _promising_forest(group: pd.DataFrame) -> list[tuple[int, int]]:
    node, forest = group["node"].to_numpy(), _Forest(len(group))
    return [(int(node[x]), int(node[y])) for x, ys, _ in _promising(group) for y in ys.tolist() if forest.join(x, y)]


def _confirmed_forest(group: pd.DataFrame) -> list[tuple[int, int]]:
    node, comp, forest = group["node"].to_numpy(), group["comp"].to_numpy(), _Forest(len(group))
    first: dict[int, int] = {}
    for x, c in enumerate(comp.tolist()):
        forest.join(x, first.setdefault(c, x))
    sets = [np.frombuffer(b, np.uint64) for b in group["set"]]
    pairs = [(-e, x, y) for x, ys, about in _promising(group) for y, e in zip(ys.tolist(), about.tolist(), strict=True)]
    out = []
    for _, x, y in sorted(pairs):  # likeliest first: they join what then needs no look
        if forest.root(x) != forest.root(y) and linked(sets[x], sets[y]):
            forest.join(x, y)
            out.append((int(node[x]), int(node[y])))
    return out


# -- the operator ------------------------------------------------------------------------------------------------


def _labelled(df: DataFrame, labels: DataFrame) -> DataFrame:
    """df with the component of its node: the node itself where no link is known."""
    return df.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, broadcast_rows: int = 250_000, row: Column | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept. width: words of a shingle.

    broadcast_rows: up to so many candidates (five numbers each) are broadcast to the second scan; more are joined.
    row: what tells rows of one id apart. With it there is a further column row, and kept is true for one row of each
    component only, also where ids are null or repeated; without it, for all rows with the component's id.
    """
    text = F.col(text_col).cast("string")
    columns, names = [F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")], []
    if row is not None:
        columns, names = [*columns, row.alias("row")], ["row"]
    base = docs.select(*columns)
    rows = map_batches(base, _describe(width), f"doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sig binary, text_hash long{', row long' if names else ''}")
    scratch = Scratch(docs.sparkSession, "near")
    rows = materialize(rows.withColumn("token", F.monotonically_increasing_id()), "signatures")
    # Equal sets are one node: the first of their rows.
    first = [F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "token")).alias("first_row")] if names else []
    classes = rows.filter("n_shingles > 0").groupBy("f1", "f2").agg(F.min("token").alias("node"), F.min("doc_id").alias("first_id"), *first)
    classes = scratch.table(classes)
    nodes = scratch.table(rows.join(classes.select("node"), F.col("token") == F.col("node"), "left_semi").select(F.col("token").alias("node"), "doc_id", "f1", "f2", F.col("n_shingles").alias("n"), "bands", "sig", "text_hash"))
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = scratch.table(banded.groupBy("band").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size"))
    members = scratch.table(banded.join(shared, "band"))
    about = nodes.select("node", "n", "sig")

    # Star round.
    rays = members.filter("node <> center").select("node", "center").distinct()
    center = about.select(F.col("node").alias("center"), F.col("sig").alias("center_sig"))
    rays = rays.join(about, "node").join(center, "center").withColumn("e", _estimate("sig", "center_sig")).filter(F.col("e") >= FLOOR)
    rays = scratch.table(rays.groupBy("node").agg(F.max(F.struct("e", "center")).alias("best")).select("node", F.col("best.center").alias("center")))
    candidates = members.select("node").distinct().join(nodes.select("node", F.col("doc_id").alias("want"), F.col("text_hash").alias("want_hash"), "f1", "f2"), "node")
    candidates = scratch.table(candidates)
    n_candidates = candidates.count()
    # By id and text: null and repeated ids may be any share of the rows.
    same = F.col("doc_id").eqNullSafe(F.col("want")) & (F.col("text_hash") == F.col("want_hash"))
    texts = base.join(F.broadcast(candidates) if n_candidates <= broadcast_rows else candidates, same).select("node", "text", "f1", "f2")
    sets = scratch.table(map_batches(texts, _with_sets(width), "node long, set binary"))
    if sets.count() > n_candidates:  # rows of one id and text
        sets = scratch.table(sets.groupBy("node").agg(F.first("set").alias("set")))
    center_set = sets.select(F.col("node").alias("center"), F.col("set").alias("center_set"))
    star = rays.join(sets, "node").join(center_set, "center").filter(_linked("set", "center_set")).select(F.col("node").alias("a"), F.col("center").alias("b"))
    star = scratch.table(star)
    labels = connected(star)

    # Rest round.
    rest = _labelled(members.select("band", "node"), labels)
    rest = scratch.table(rest)
    sizes = spread(rest, "band", scratch)
    dealt = blocked(rest, sizes.filter(F.col("rest") <= LARGE), "band", BUCKET_BLOCK)
    large = sizes.filter(F.col("rest") > LARGE).select("band")
    if not large.isEmpty():
        deep = scratch.table(deepened(rest.join(large, "band"), about))
        dealt = dealt.unionByName(blocked(deep, spread(deep, "band", scratch), "band", BUCKET_BLOCK))
    dealt = dealt.join(about, "node")
    groups = connected(scratch.table(per_group(dealt, ["band", "i", "j"], _promising_forest))).withColumnRenamed("comp", "group")
    groups = _labelled(groups, labels)
    groups = groups.join(nodes.select("node", F.col("n").alias("own_n")), "node")
    sizes = spread(groups, "group", scratch, F.col("own_n") * 8.0 * SET_BLOCK / SET_BYTES)
    dealt = blocked(groups, sizes, "group", SET_BLOCK).drop("own_n").join(about, "node").join(sets, "node")
    more = scratch.table(per_group(dealt, ["group", "i", "j"], _confirmed_forest))
    labels = connected(star.unionByName(more))

    placed = _labelled(classes, labels)
    smallest = placed.groupBy("comp").agg(F.min("first_id").alias("component_id"), *([F.min("first_row").alias("best")] if names else []))
    found = materialize(placed.join(smallest, "comp").select("f1", "f2", "component_id", *(["best"] if names else [])), "found")
    scratch.remove()
    alone = F.col("n_shingles") == 0
    out = rows.select("doc_id", "n_shingles", "f1", "f2", "token", *names).join(found, ["f1", "f2"], "left")
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    kept = alone | (F.col("token") == F.col("best.token")) if names else F.col("doc_id").eqNullSafe(component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), *names)


def keep_rows(docs: DataFrame, width: int = 5, broadcast_rows: int = 250_000) -> DataFrame:
    """The rows of docs (with all columns) that stay: of each component one row, with its smallest id (null last)."""
    told = near_duplicates(docs, width=width, broadcast_rows=broadcast_rows, row=row_key(docs)).select("doc_id", "row", F.col("kept").cast("long").alias("copies"))
    return repeat_rows(docs, materialize(told, "told"), broadcast_rows)
