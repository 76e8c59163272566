"""Approximate nearest neighbours by NN-descent, and greedy search in the graph.

Nearness is the largest inner product. Rows with equal vectors are one node, with the smallest of their ids. The graph
starts from blocks of nodes alike under random hyperplanes and is improved in rounds of joins: each node's neighbours
and reverse neighbours meet, since a neighbour's neighbour is likely a neighbour. Nodes live in groups of bounded
size; a group asks each other group for the vectors that its lists name, once however many of its lists name them.
Rounds end when few entries change. Queries are rows; each starts at its own node and expands the best nodes it knows
until the best `beam` are all expanded.

While the graph is built, vectors travel as halves with a scale of their own; scores are those of the original ones.
Hubs, the nodes that very many lists name (under inner products the longest vectors are in nearly all), go to every
search task together with their lists: at most HUBS of them, so that no group of nodes gets every query's requests.

Lists of `degree` neighbours and as many reverse ones are the method's own bound; the index holds every row. Vectors
that are null, zero, of another length than most, or that hold null or non-finite components take no part. Repeated
rows and equal vectors are each a candidate; ties go to smaller vec_id (null last). With fewer rows than asked for,
all are found. An empty table gives an empty result; columns that are not named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annolith.llm.common import materialize

#: Nodes of a group; neighbours of a node in the graph; best nodes a query keeps; nodes it expands at once.
GROUP, DEGREE, BEAM, EXPAND = 4096, 48, 160, 80
#: Nodes of a starting block, and how many blockings.
BLOCK, BLOCKINGS = 1000, 4
#: Most hubs, and how many lists name one at least, in lists' lengths; entries that are turned around together.
HUBS, NAMED, TURNED = 1024, 8, 2_000_000
#: In a round a group offers a node the best of its lists, this part of a list at most.
OFFERED = 3
#: Rounds end when fewer entries than this share change, or after so many rounds.
CHANGED, ROUNDS = 0.03, 12

#: A node's list; entries for many nodes of a group in one row (nodes, ids and sims run in parallel).
LIST = "g long, node long, ids binary, sims binary"
MANY = "g long, nodes binary, ids binary, sims binary"


def _ints(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.int64)


def _flat(frame: pd.DataFrame, kind: type = np.float32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, neighbour, similarity) of lists, of one node (node) or many (nodes)."""
    if not len(frame):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
    if "nodes" in frame:
        many = frame["nodes"].notna().to_numpy()
        if many.any():
            rest = _flat(frame[~many].drop(columns="nodes"), kind)
            packed = frame[many]
            return tuple(np.concatenate([a, np.frombuffer(b"".join(packed[c]), t)]) for a, c, t in zip(rest, ("nodes", "ids", "sims"), (np.int64, np.int64, kind), strict=True))
    counts = np.array([len(b) // 8 for b in frame["ids"]], np.int64)
    return np.repeat(frame["node"].to_numpy(np.int64), counts), _ints(b"".join(frame["ids"])), np.frombuffer(b"".join(frame["sims"]), kind)


def best(node: np.ndarray, other: np.ndarray, sim: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each node's `most` most similar distinct others, sorted by node, then similarity, then other."""
    order = np.lexsort((other, -sim, node))
    node, other, sim = node[order], other[order], sim[order]
    pair = np.lexsort((other, node))  # stable: the first of equal pairs is the most similar
    first = np.ones(len(pair), bool)
    first[1:] = (node[pair][1:] != node[pair][:-1]) | (other[pair][1:] != other[pair][:-1])
    keep = np.zeros(len(node), bool)
    keep[pair[first]] = True
    node, other, sim = node[keep], other[keep], sim[keep]
    starts = np.searchsorted(node, node)
    top = np.arange(len(node)) - starts < most
    return node[top], other[top], sim[top]


def _packed(node: np.ndarray, other: np.ndarray, sim: np.ndarray, groups: int) -> pd.DataFrame:
    """Sorted triples as one row per node."""
    which, starts = np.unique(node, return_index=True)
    ends = [*starts[1:], len(node)][: len(starts)]
    return pd.DataFrame({"g": which % groups, "node": which, "ids": [other[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], "sims": [sim[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]})


def _by_group(node: np.ndarray, other: np.ndarray, sim: np.ndarray, groups: int) -> pd.DataFrame:
    """Triples as one row per group of nodes."""
    owner = node % groups
    order = np.argsort(owner, kind="stable")
    g, starts = np.unique(owner[order], return_index=True)
    parts = [[p.tobytes() for p in np.split(c[order], starts[1:])] if len(g) else [] for c in (node, other, sim)]
    return pd.DataFrame({"g": g, "nodes": parts[0], "ids": parts[1], "sims": parts[2]})


def _matrix(blobs: pd.Series | list, kind: type = np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1) if len(blobs) else np.zeros((0, 1), kind)


def _halves(x: np.ndarray) -> list[bytes]:
    """Each row as its largest absolute value (single precision) and its share of that (half precision)."""
    scale = np.abs(x).max(axis=1, keepdims=True)
    share = (x / scale).astype(np.float16)
    return [a.tobytes() + b.tobytes() for a, b in zip(scale.astype(np.float32), share, strict=True)]


def _singles(blob: bytes, rows: int) -> np.ndarray:
    """Rows of _halves, one behind the other, in single precision."""
    raw = np.frombuffer(blob, np.uint8).reshape(rows, -1) if rows else np.zeros((0, 6), np.uint8)
    return np.ascontiguousarray(raw[:, 4:]).view(np.float16).astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view(np.float32)


# -- nodes -------------------------------------------------------------------------------------------------------


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(token, vec_id, v) of the rows that take part; v: doubles as bytes."""
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    common = base.groupBy(F.size("x").alias("n")).agg(F.count(F.lit(1)).alias("c")).filter("n > 0").orderBy(F.desc("c"), "n").limit(1).collect()
    dim = int(common[0]["n"]) if common else 0

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, blobs = [], []
            for vec_id, x in zip(frame["vec_id"], frame["x"], strict=True):
                if x is None or len(x) != dim:
                    continue
                v = np.array([np.nan if c is None else c for c in x] if x.dtype == object else x, np.float64)
                if np.isfinite(v).all() and v.any():
                    ids.append(vec_id)
                    blobs.append((v + 0.0).tobytes())  # -0.0 becomes 0.0: equal vectors have equal bytes
            yield pd.DataFrame({"vec_id": pd.array(ids, "Int64"), "v": blobs})

    return base.mapInPandas(run, "vec_id long, v binary").withColumn("token", F.monotonically_increasing_id())


# -- the graph ---------------------------------------------------------------------------------------------------


def _start(nodes: DataFrame, count: int, groups: int, degree: int, seed: int) -> DataFrame:
    """Lists from blocks of about BLOCK nodes on the same side of random hyperplanes; larger blocks are split by hash."""
    bits = max(0, math.ceil(math.log2(max(1, count) / BLOCK)))

    def codes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = _matrix(frame["v"], np.float64)
                for t in range(BLOCKINGS):
                    planes = np.random.default_rng(seed + t).normal(size=(x.shape[1], bits))
                    yield pd.DataFrame({"t": t, "code": (x @ planes > 0) @ (1 << np.arange(bits)), "node": frame["node"], "x": _halves(x)})

    coded = nodes.mapInPandas(codes, "t int, code long, node long, x binary")
    sizes = materialize(coded.groupBy("t", "code").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")), "blocks")
    coded = coded.join(sizes, ["t", "code"]).withColumn("part", F.pmod(F.xxhash64("node", "t"), "parts"))

    def within(frame: pd.DataFrame) -> pd.DataFrame:
        node, x = frame["node"].to_numpy(np.int64), _singles(b"".join(frame["x"]), len(frame))
        found = []
        for at in range(0, len(node), 512):
            sim = x[at : at + 512] @ x.T
            rows = np.arange(len(sim))
            sim[rows, rows + at] = -np.inf
            k = min(degree // 2, len(node) - 1)
            if k:
                near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                found.append((np.repeat(node[at : at + 512], k), node[near].ravel(), np.take_along_axis(sim, near, 1).ravel()))
        if not found:
            return _by_group(node[:0], node[:0], np.zeros(0, np.float32), groups)
        return _by_group(*(np.concatenate(f) for f in zip(*found, strict=True)), groups)

    return coded.groupBy("t", "code", "part").applyInPandas(within, MANY)


def _merge(lists: DataFrame, nodes: DataFrame, groups: int, degree: int) -> DataFrame:
    """One row per node: its best entries of all lists, its vector, and how many entries are not in an `old` list."""

    def run(frame: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        node, other, sim = best(*_flat(frame), degree)
        was, had, _ = _flat(frame[frame["old"]]) if len(frame) else (node[:0], node[:0], None)
        known = set(zip(was.tolist(), had.tolist(), strict=True))
        fresh: dict[int, int] = {}
        for a, b in zip(node.tolist(), other.tolist(), strict=True):
            if (a, b) not in known:
                fresh[a] = fresh.get(a, 0) + 1
        out = own.merge(_packed(node, other, sim, groups)[["node", "ids", "sims"]], "left", "node")
        for c in ("ids", "sims"):
            out[c] = [b if isinstance(b, bytes) else b"" for b in out[c]]
        out["fresh"] = [fresh.get(a, 0) for a in out["node"].tolist()]
        return out[["g", "node", "ids", "sims", "x", "fresh"]]

    return lists.groupBy("g").cogroup(nodes.select("g", "node", "x").groupBy("g")).applyInPandas(run, f"{LIST}, x binary, fresh long")


def _reversed(frames: Iterator[pd.DataFrame], groups: int, degree: int) -> Iterator[pd.DataFrame]:
    """Lists turned around, the best of TURNED entries only: a node that is everyone's neighbour sends little."""
    held: list[tuple] = []
    for frame in frames:
        node, other, sim = _flat(frame)
        held.append((other, node, sim))
        if sum(len(h[0]) for h in held) > TURNED:
            yield _by_group(*best(*(np.concatenate(c) for c in zip(*held, strict=True)), degree), groups)
            held = []
    if held:
        yield _by_group(*best(*(np.concatenate(c) for c in zip(*held, strict=True)), degree), groups)


def _meetings(frame: pd.DataFrame, groups: int, degree: int) -> pd.DataFrame:
    """One row per group: its nodes' neighbours and best reverse neighbours, as places in its list of distinct members."""
    turned = frame["turned"].to_numpy(bool)
    node, other, _ = _flat(frame[~turned])
    back, source, _ = best(*_flat(frame[turned]), degree)
    pairs = np.unique(np.stack([np.concatenate([node, back]), np.concatenate([other, source])], axis=1), axis=0)
    members, place = np.unique(pairs[:, 1], return_inverse=True)
    _, starts = np.unique(pairs[:, 0], return_index=True)
    return pd.DataFrame({"g": [int(frame["g"].iloc[0])], "members": [members.tobytes()], "places": [place.astype(np.int32).tobytes()], "starts": [starts.astype(np.int32).tobytes()]})


def _asked(frames: Iterator[pd.DataFrame], groups: int) -> Iterator[pd.DataFrame]:
    """What each group asks of each other group: (h, g, ids)."""
    for frame in frames:
        for g, blob in zip(frame["g"], frame["members"], strict=True):
            members = _ints(blob)
            owner = members % groups
            order = np.argsort(owner, kind="stable")
            h, starts = np.unique(owner[order], return_index=True)
            yield pd.DataFrame({"h": h, "g": g, "ids": [p.tobytes() for p in np.split(members[order], starts[1:])][: len(h)]})


def _answers(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
    """The vectors asked for, and the similarity that a new neighbour of each must beat."""
    node = own["node"].to_numpy(np.int64)
    order = np.argsort(node)
    x = np.frombuffer(b"".join(own["x"]), np.uint8).reshape(len(own), -1)
    least = np.array([np.frombuffer(s, np.float32)[-1] if len(s) == full else -np.inf for s, full in zip(own["sims"], own["full"], strict=True)], np.float32)
    rows = [order[np.searchsorted(node[order], _ints(b))] for b in asked["ids"]]
    return pd.DataFrame({"g": asked["g"], "ids": asked["ids"], "xs": [x[r].tobytes() for r in rows], "least": [least[r].tobytes() for r in rows]})


def _local_join(meet: pd.DataFrame, answers: pd.DataFrame, groups: int, degree: int) -> pd.DataFrame:
    """Candidates for every member of the group's lists, from the other members of the same lists."""
    ids = _ints(b"".join(answers["ids"]))
    order = np.argsort(ids)
    x = _singles(b"".join(answers["xs"]), len(ids))[order]
    least = np.frombuffer(b"".join(answers["least"]), np.float32)[order]
    members = ids[order]  # sorted as in the row's list
    places, starts = np.frombuffer(meet["places"].iloc[0], np.int32), np.frombuffer(meet["starts"].iloc[0], np.int32)
    kept = (members[:0], members[:0], least[:0])
    held: list[tuple] = []
    size, most = 0, max(1, degree // OFFERED)
    for a, b in zip(starts, [*starts[1:], len(places)], strict=True):
        m = places[a:b]
        sim = x[m] @ x[m].T
        np.fill_diagonal(sim, -np.inf)
        floor = least[m]
        if len(m) > most:
            floor = np.maximum(floor, np.nextafter(np.partition(sim, len(m) - most, axis=1)[:, len(m) - most], np.float32(-np.inf)))
        i, j = np.nonzero(sim > floor[:, None])
        held.append((m[i], m[j], sim[i, j]))
        size += len(i)
        if size > 1_000_000:
            kept = best(*(np.concatenate(c) for c in zip((kept), *held, strict=True)), most)
            held, size = [], 0
    node, other, sim = best(*(np.concatenate(c) for c in zip(kept, *held, strict=True)), most)
    return _by_group(members[node], members[other], sim, groups)


def build_graph(nodes: DataFrame, count: int, degree: int = DEGREE, seed: int = 23) -> tuple[DataFrame, int]:
    """(lists, groups): a neighbour list for every node of nodes (node, v), g = node modulo groups."""
    groups = max(1, math.ceil(count / GROUP))
    nodes = materialize(nodes.withColumn("g", F.pmod("node", F.lit(groups))).mapInPandas(_narrow, "g long, node long, v binary, x binary"), "nodes")
    lists = _start(nodes.select("node", "v"), count, groups, degree, seed).withColumn("old", F.lit(False))
    no_node, no_nodes = F.lit(None).cast("long").alias("node"), F.lit(None).cast("binary").alias("nodes")
    lists = lists.select("g", no_node, "nodes", "ids", "sims", "old")
    graph = materialize(_merge(lists, nodes, groups, degree), "graph")
    full = degree * 4
    for _ in range(ROUNDS):
        turned = graph.select(*LIST.replace(" long", "").replace(" binary", "").split(", ")).mapInPandas(partial(_reversed, groups=groups, degree=degree), MANY)
        both = graph.select("g", "node", no_nodes, "ids", "sims", F.lit(False).alias("turned")).unionByName(turned.select("g", no_node, "nodes", "ids", "sims", F.lit(True).alias("turned")))
        meet = materialize(both.groupBy("g").applyInPandas(partial(_meetings, groups=groups, degree=degree), "g long, members binary, places binary, starts binary"), "meetings")
        asked = meet.select("g", "members").mapInPandas(partial(_asked, groups=groups), "h long, g long, ids binary")
        own = graph.select(F.col("g").alias("h"), "node", "x", "sims", F.lit(full).alias("full"))
        answers = asked.groupBy("h").cogroup(own.groupBy("h")).applyInPandas(_answers_or_none, "g long, ids binary, xs binary, least binary")
        news = meet.groupBy("g").cogroup(answers.groupBy("g")).applyInPandas(_joiner(groups, degree), MANY)
        lists = graph.select("g", "node", no_nodes, "ids", "sims", F.lit(True).alias("old")).unionByName(news.select("g", no_node, "nodes", "ids", "sims", F.lit(False).alias("old")))
        graph = materialize(_merge(lists, nodes, groups, degree), "graph")
        changed = graph.agg(F.sum("fresh")).first()[0] or 0
        if changed < CHANGED * count * degree:
            break
    return graph.join(nodes.select("node", "v"), "node").select("g", "node", "ids", "sims", "v"), groups


def _narrow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        frame["x"] = _halves(_matrix(frame["v"], np.float64))
        yield frame[["g", "node", "v", "x"]]


def _answers_or_none(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
    return _answers(asked, own) if len(asked) else pd.DataFrame({"g": [], "ids": [], "xs": [], "least": []})


def _joiner(groups: int, degree: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(meet: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(answers):
            none = np.zeros(0, np.int64)
            return _by_group(none, none, np.zeros(0, np.float32), groups)
        return _local_join(meet, answers, groups, degree)

    return run


# -- search ------------------------------------------------------------------------------------------------------

POOL = "node long, q binary, ids binary, sims binary, done binary, open long"


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (x * q).sum(axis=1)  # row by row: equal vectors score equally


class Hubs:
    """Nodes that many lists name, sorted: their ids, vectors (rows) and lists."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, lists: list[bytes]):
        self.ids, self.x, self.lists = ids, x, lists

    def holds(self, ids: np.ndarray) -> np.ndarray:
        return self.ids[np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)] == ids if len(self.ids) else np.zeros(len(ids), bool)


def find_hubs(graph: DataFrame, degree: int) -> Hubs:
    """At most HUBS nodes, those that the most lists name: a bounded number of rows comes to the driver."""

    def named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, counts = np.unique(_ints(b"".join(frame["ids"])), return_counts=True)
            yield pd.DataFrame({"node": ids, "n": counts})

    counts = graph.select("ids").mapInPandas(named, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") >= NAMED * degree).orderBy(F.desc("n"), "node").limit(HUBS)
    rows = sorted(graph.join(F.broadcast(top), "node").select("node", "v", "ids").collect())
    return Hubs(np.array([r["node"] for r in rows], np.int64), _matrix([bytes(r["v"]) for r in rows], np.float64), [bytes(r["ids"]) for r in rows])


def _todo(frame: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """(query, its best nodes that it has not expanded)."""
    for node, ids, done in zip(frame["node"], frame["ids"], frame["done"], strict=True):
        yield node, _ints(ids)[np.frombuffer(done, bool) == 0][:EXPAND]


def _frontier(hubs: Broadcast, groups: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What each query asks of each group: (h, node, ids). Hubs are not asked for."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple] = []
            for node, todo in _todo(frame):
                todo = todo[~hubs.value.holds(todo)]
                out += [(h, node, todo[todo % groups == h].tobytes()) for h in np.unique(todo % groups).tolist()]
            yield pd.DataFrame(out, columns=["h", "node", "ids"])

    return run


def _hub_lists(hubs: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(node, ids): the neighbours of the hubs that a query expands, without asking their groups."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = dict(zip(hubs.value.ids.tolist(), hubs.value.lists, strict=True))
        for frame in frames:
            out = []
            for node, todo in _todo(frame):
                lists = [known[i] for i in todo.tolist() if i in known]
                if lists:
                    out.append((node, np.unique(_ints(b"".join(lists))).tobytes()))
            yield pd.DataFrame(out, columns=["node", "ids"])

    return run


def _expand(asked: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
    """(node, ids): the neighbours of a group's nodes, for each query that expands some."""
    lists = dict(zip(graph["node"].tolist(), graph["ids"], strict=True)) if len(asked) else {}
    near = [np.unique(_ints(b"".join(lists[v] for v in _ints(ids).tolist()))).tobytes() for ids in asked["ids"]]
    return pd.DataFrame({"node": asked["node"], "ids": near})


def _wanted(hubs: Broadcast, groups: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """(h, node, q, ids): neighbours that a query does not hold yet, one row for each group that has some. Every query
    has seen the hubs at its start."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for query, rows in frame.groupby("node", sort=False):
            mine = rows["q"].notna().to_numpy()
            near = np.setdiff1d(_ints(b"".join(rows["ids"][~mine])), _ints(b"".join(rows["ids"][mine])))
            near = near[~hubs.value.holds(near)]
            q = rows["q"][mine].iloc[0]
            owner = near % groups
            order = np.argsort(owner, kind="stable")
            h, starts = np.unique(owner[order], return_index=True)
            out += [(k, query, q, p.tobytes()) for k, p in zip(h.tolist(), np.split(near[order], starts[1:]), strict=True)] if len(near) else []
        return pd.DataFrame(out, columns=["h", "node", "q", "ids"])

    return run


def _score(asked: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
    out: list[tuple] = []
    if len(asked):
        node = graph["node"].to_numpy(np.int64)
        order = np.argsort(node)
        x, node = _matrix(graph["v"], np.float64)[order], node[order]
        together: dict[int, tuple[bytes, list[bytes]]] = {}
        for query, q, ids in zip(asked["node"].tolist(), asked["q"], asked["ids"], strict=True):
            together.setdefault(query, (q, []))[1].append(ids)
        for query, (q, blobs) in together.items():
            near = np.unique(_ints(b"".join(blobs)))
            sim = _scores(x[np.searchsorted(node, near)], np.frombuffer(q, np.float64))
            if len(near) > BEAM:
                top = np.argpartition(-sim, BEAM - 1)[:BEAM]
                near, sim = near[top], sim[top]
            out.append((query, near.tobytes(), sim.tobytes()))
    return pd.DataFrame(out, columns=["node", "ids", "sims"])


def _pool(frame: pd.DataFrame) -> pd.DataFrame:
    """Each query's BEAM best nodes so far, best first, with what it has expanded."""
    out: list[tuple] = []
    for query, rows in frame.groupby("node", sort=False):
        q = next(b for b in rows["q"] if b is not None)
        ids, sims = _ints(b"".join(rows["ids"])), np.frombuffer(b"".join(rows["sims"]), np.float64)
        done = np.concatenate([np.frombuffer(d, bool) if d is not None else np.zeros(len(i) // 8, bool) for d, i in zip(rows["done"], rows["ids"], strict=True)])
        order = np.lexsort((~done, ids, -sims))  # of equal pairs the expanded one comes first
        ids, sims, done = ids[order], sims[order], done[order]
        _, first = np.unique(ids, return_index=True)
        keep = np.sort(first)[:BEAM]
        out.append((query, q, ids[keep].tobytes(), sims[keep].tobytes(), done[keep].tobytes(), int((~done[keep]).sum())))
    return pd.DataFrame(out, columns=["node", "q", "ids", "sims", "done", "open"])


def _mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        marked = []
        for done in frame["done"]:
            d = np.frombuffer(done, bool).copy()
            d[np.flatnonzero(~d)[:EXPAND]] = True
            marked.append(d.tobytes())
        frame["done"] = marked
        yield frame


def search(graph: DataFrame, groups: int, queries: DataFrame, count: int, degree: int = DEGREE) -> DataFrame:
    """(node, found, score): the best nodes found for each query node; queries has node and v."""
    hubs = queries.sparkSession.sparkContext.broadcast(find_hubs(graph, degree))
    part = F.pmod(F.xxhash64("node"), F.lit(max(1, math.ceil(count / 512)))).alias("p")
    none = F.lit(None).cast("binary")

    def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple] = []
            for node, q in zip(frame["node"].tolist(), frame["v"], strict=True):
                v = np.frombuffer(q, np.float64)
                other = hubs.value.ids != node
                ids = np.append(node, hubs.value.ids[other])
                sims = np.append(_scores(v[None], v), _scores(hubs.value.x[other], v) if other.any() else [])
                order = np.lexsort((ids, -sims))[:BEAM]
                out.append((node, q, ids[order].tobytes(), sims[order].tobytes(), b"\0" * len(order), len(order)))
            yield pd.DataFrame(out, columns=["node", "q", "ids", "sims", "done", "open"])

    pool = materialize(queries.select("node", "v").mapInPandas(own, POOL), "pool")
    vectors = graph.select(F.col("g").alias("h"), "node", "v")
    lists = graph.select(F.col("g").alias("h"), "node", "ids")
    while pool.agg(F.max("open")).first()[0]:
        going = pool.filter("open > 0").select("node", "q", "ids", "done")
        asked = going.select("node", "ids", "done").mapInPandas(_frontier(hubs, groups), "h long, node long, ids binary")
        near = asked.groupBy("h").cogroup(lists.groupBy("h")).applyInPandas(_expand, "node long, ids binary")
        near = near.unionByName(going.select("node", "ids", "done").mapInPandas(_hub_lists(hubs), "node long, ids binary"))
        met = near.select("node", none.alias("q"), "ids").unionByName(going.select("node", "q", "ids"))
        wanted = met.groupBy(part).applyInPandas(_wanted(hubs, groups), "h long, node long, q binary, ids binary")
        scored = wanted.groupBy("h").cogroup(vectors.groupBy("h")).applyInPandas(_score, "node long, ids binary, sims binary")
        marked = pool.mapInPandas(_mark, POOL).select("node", "q", "ids", "sims", "done")
        every = marked.unionByName(scored.select("node", none.alias("q"), "ids", "sims", none.alias("done")))
        pool = materialize(every.groupBy(part).applyInPandas(_pool, POOL), "pool")

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            node, found, score = _flat(frame[["node", "ids", "sims"]], np.float64)
            yield pd.DataFrame({"node": node, "found": found, "score": score})

    return pool.select("node", "ids", "sims").mapInPandas(listed, "node long, found long, score double")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows of each row whose id is divisible by `every`: query_id, rank, vec_id, score."""
    rows = materialize(_rows(vectors, id_col, vector_col), "rows")
    nodes = rows.groupBy("v").agg(F.min("token").alias("node"))
    members = materialize(rows.join(nodes, "v").select("node", "token", "vec_id"), "members")
    nodes = materialize(rows.join(members.select("node").distinct(), F.col("token") == F.col("node"), "left_semi").select(F.col("token").alias("node"), "v"), "distinct")
    # Of equal vectors only the smallest ids can be among the k nearest: found in slices, then together.
    order = [F.col("vec_id").asc_nulls_last(), F.col("token")]
    slices = Window.partitionBy("node", F.pmod(F.xxhash64("token"), F.lit(64))).orderBy(*order)
    small = members.withColumn("r", F.row_number().over(slices)).filter(F.col("r") <= k + 1)
    small = small.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(*order))).filter(F.col("r") <= k + 1).drop("r")
    asking = materialize(members.filter(F.col("vec_id") % every == 0), "asking")
    count, n_asking = nodes.count(), asking.count()
    graph, groups = build_graph(nodes, count)
    graph = materialize(graph, "index")
    queries = nodes.join(asking.select("node").distinct(), "node", "left_semi")
    found = search(graph, groups, queries, n_asking)
    best_rows = found.join(small.withColumnsRenamed({"node": "found"}), "found")
    by = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("token")]
    # One more than k for each query node: one of them may be the query itself.
    best_rows = best_rows.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(*by))).filter(F.col("r") <= k + 1)
    best_rows = materialize(best_rows.select("node", "token", "vec_id", "score"), "best")
    asks = asking.select("node", F.col("vec_id").alias("query_id"), F.col("token").alias("asker"))
    out = asks.join(best_rows, "node").filter("asker <> token")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("asker").orderBy(*by))).filter(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
