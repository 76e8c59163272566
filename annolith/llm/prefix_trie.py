"""The trie of conversations' prefixes: which beginnings conversations share, and what storing them once would save.

Conversations are rebuilt first: conversation c begins with the first h turns of the first conversation of its hundred
(c - c % 100), h by a hash of its id, and goes on with its own turns after its first h. Turns are the same if role and text
are (128 bits of hashes stand for them). Conversations that are the same throughout are one path with a weight, told by an
order-free fingerprint of their numbered turns; so a group of copies of any size is one row from there on.

Construction is level-synchronous: at each depth the live paths are grouped by (parent node, next turn), and the smallest
conv_id names the node. A path alone in its node stays alone: the rest of it is a chain and is made in one step. Levels
are so as many as the deepest place where paths part. Then leaves and savings are rolled up by joins, level by level.

Turns come in the order (turn, role, first 256 characters of text, hashes of the turn), turn null first, so ties have an
order and repeated rows are turns of their own. Null role or text counts as empty. Rows without conv_id belong to no conversation and take no part; negative ids are cut towards
zero by c % 100. An empty table gives an empty result. Columns that are not named are ignored. Turns of one conversation may
be any share of all rows: their places come from ranges of one order over all rows, never from a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolith.llm.common import Scratch, in_order, materialize, release

#: A node's columns beside conv_id.
NODE = {"depth": "long", "parent_conv_id": "long", "n_convs": "long", "n_children": "long", "n_leaves": "long", "saved_tokens": "long", "ends_sha256": "string"}
#: Ids in a slice of a node's members, at most: what is joined into one text at once.
SLICE = 4096


def shared_turns(conv_id: Column, most: int) -> Column:
    """How many turns a conversation takes from the first of its hundred."""
    return F.pmod(F.crc32(conv_id.cast("string")), F.lit(most)).cast("int")


def rebuilt(turns: DataFrame, scratch: Scratch, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): every rebuilt turn as conv_id, depth, k1, k2, chars; every conv_id, turnless ones too."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.select("conv_id", "turn", "role", "text", F.xxhash64(F.lit(1), "role", "text").alias("k1"), F.xxhash64(F.lit(2), "role", "text").alias("k2"))
    short = rows.select("conv_id", "turn", "k1", "k2", F.length("text").cast("long").alias("chars"), "role", F.substring("text", 1, 256).alias("head"))
    placed = in_order(short, [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("head").asc(), F.col("k1").asc(), F.col("k2").asc()], scratch)
    firsts = placed.groupBy("conv_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("own"))
    convs = scratch.table(firsts.withColumns({"h": shared_turns(F.col("conv_id"), most), "base": F.col("conv_id") - F.col("conv_id") % 100}))
    own = placed.join(convs.select("conv_id", "first", "h", "base"), "conv_id").withColumn("at", F.col("place") - F.col("first"))
    own = scratch.table(own.select("conv_id", "at", "h", "base", "k1", "k2", "chars"))
    # A base has at most 100 takers, who take at most `most` - 1 turns.
    heads = own.filter((F.col("conv_id") == F.col("base")) & (F.col("at") < most - 1)).select("base", "at", "k1", "k2", "chars")
    taken = convs.filter("h > 0").select("conv_id", "base", "h").join(heads, "base").filter(F.col("at") < F.col("h"))
    taken = taken.select("conv_id", (F.col("at") + 1).alias("depth"), "k1", "k2", "chars")
    lent = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("lent"))
    start = convs.join(lent, "base", "left").select("conv_id", F.least(F.col("h"), F.coalesce("lent", F.lit(0).cast("long"))).alias("begin"))
    kept = own.filter(F.col("at") >= F.col("h")).join(start, "conv_id").select("conv_id", (F.col("begin") + F.col("at") - F.col("h") + 1).alias("depth"), "k1", "k2", "chars")
    return scratch.table(taken.unionByName(kept)), convs.select("conv_id")


def _paths(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(paths, members): distinct conversations as conv_id (the smallest), weight, length; and each conv_id's path."""
    prints = turns.groupBy("conv_id").agg(F.bit_xor(F.xxhash64(F.lit(1), "depth", "k1", "k2")).alias("p1"), F.bit_xor(F.xxhash64(F.lit(2), "depth", "k1", "k2")).alias("p2"), F.count(F.lit(1)).alias("length"))
    zero = F.lit(0).cast("long")
    told = scratch.table(convs.join(prints, "conv_id", "left").select("conv_id", *(F.coalesce(c, zero).alias(c) for c in ("p1", "p2", "length"))))
    same = ["length", "p1", "p2"]
    paths = scratch.table(told.groupBy(*same).agg(F.min("conv_id").alias("path"), F.count(F.lit(1)).alias("weight")))
    return paths.select(F.col("path").alias("conv_id"), "weight", "length"), told.join(paths, same).select("conv_id", "path")


def _ids_hash(members: DataFrame) -> DataFrame:
    """(path, sha): SHA-256 of the ids of each path's members in order. Ids go into texts by slices of their values, which
    bounds a slice; a path of several slices is hashed by going through them in order, holding one at a time."""
    slices = members.groupBy("path", F.floor(F.col("conv_id") / SLICE).alias("slice")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    texts = slices.select("path", "slice", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done: list[tuple[int, str]] = []
            for path, ids in zip(batch.column("path").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if path == now:
                    state.update(b"," + ids.encode())
                    continue
                if state:
                    done.append((now, state.hexdigest()))
                now, state = path, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.int64()), pa.array([x for _, x in done], pa.string())], names=["path", "sha"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()])], names=["path", "sha"])
        release()

    return texts.repartition("path").sortWithinPartitions("path", "slice").mapInArrow(run, "path long, sha string")


def _levels(turns: DataFrame, paths: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """(levels, ends): nodes by depth, from the root: conv_id, parent, n_convs, chars, alone (whether one path goes
    through); and the paths that end in nodes of several: path, node."""
    zero = F.lit(0).cast("long")
    root = paths.agg(F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count(F.lit(1)).alias("n"))
    levels = [scratch.table(root.filter("n > 0").select("conv_id", F.lit(None).cast("long").alias("parent"), "n_convs", zero.alias("chars"), (F.col("n") == 1).alias("alone")))]
    first = levels[0].first()
    if first is None or first["alone"]:
        return levels, []
    live = paths.select(F.col("conv_id").alias("path"), "weight", "length", F.lit(first["conv_id"]).alias("node"))
    ends = [live.filter("length = 0").select("path", "node")]
    while True:
        depth = len(levels)
        next_ = turns.filter(F.col("depth") == depth).select(F.col("conv_id").alias("path"), "k1", "k2", "chars")
        step = live.join(next_, "path")
        nodes = step.groupBy("node", "k1", "k2").agg(F.min("path").alias("conv_id"), F.sum("weight").alias("n_convs"), F.first("chars").alias("chars"), F.count(F.lit(1)).alias("n"))
        nodes = scratch.table(nodes.withColumn("alone", F.col("n") == 1))
        levels.append(nodes.select("conv_id", F.col("node").alias("parent"), "n_convs", "chars", "alone"))
        shared = nodes.filter(~F.col("alone")).select("node", "k1", "k2", "conv_id")
        if shared.isEmpty():
            return levels, ends
        live = scratch.table(step.join(shared, ["node", "k1", "k2"]).select("path", "weight", "length", F.col("conv_id").alias("node")))
        ends.append(live.filter(F.col("length") == depth).select("path", "node"))


def prefix_trie(conversations: DataFrame, most: int = 6) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    with Scratch(spark, "trie") as scratch:
        turns, convs = rebuilt(conversations, scratch, most)
        paths, members = _paths(turns, convs, scratch)
        mine = turns.join(paths.select("conv_id"), "conv_id", "left_semi")
        # In order of depth, so that a level reads the few files and row groups that hold it.
        mine = scratch.table(mine.repartitionByRange("depth", "conv_id").sortWithinPartitions("depth", "conv_id"))
        levels, ended = _levels(mine, paths, scratch)
        one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
        if not levels[0].count():
            return materialize(levels[0].select("conv_id", *(F.lit(None).cast(t).alias(c) for c, t in NODE.items())), "trie")
        tops = [level.filter("alone").select("conv_id", F.lit(depth).cast("long").alias("top"), "parent", "n_convs") for depth, level in enumerate(levels)]
        tops = scratch.table(reduce(DataFrame.unionByName, tops).join(paths.select("conv_id", "length"), "conv_id"))
        # What is left of a path from each depth on, for paths of several conversations; of others nothing is saved.
        heavy = mine.join(tops.filter("n_convs > 1").select("conv_id", "top"), "conv_id").filter("depth >= top").select("conv_id", "depth", "chars")
        run = in_order(heavy, [F.col("conv_id").asc(), F.col("depth").asc()], scratch, ("chars",))
        ends = run.groupBy("conv_id").agg(F.max("through_chars").alias("end"))
        rest = scratch.table(run.join(ends, "conv_id").select("conv_id", "depth", (F.col("end") - F.col("through_chars") + F.col("chars")).alias("rest")))
        below = mine.select("conv_id", "depth").join(tops, "conv_id").filter("depth > top").withColumn("parent", F.col("conv_id"))
        chains = tops.withColumn("depth", F.col("top")).unionByName(below)
        # The root has no turn, so what is saved from it on is what is saved from depth 1 on.
        chains = chains.withColumn("from", F.greatest("depth", one)).join(rest.withColumnRenamed("depth", "from"), ["conv_id", "from"], "left")
        saved = (F.col("n_convs") - 1) * F.coalesce("rest", zero)
        chains = scratch.table(chains.select("conv_id", "depth", "top", "parent", "n_convs", (F.col("depth") < F.col("length")).cast("long").alias("n_children"), one.alias("n_leaves"), saved.alias("saved")))

        done = chains.select("conv_id", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved")
        under = None
        for depth in reversed(range(len(levels))):
            shared = levels[depth].filter(~F.col("alone"))
            if under is not None:
                shared = shared.join(under.groupBy(F.col("parent").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("under")), "conv_id", "left")
            else:
                shared = shared.withColumns({"n_children": zero, "n_leaves": zero, "under": zero})
            own = (F.col("n_convs") - 1) * F.col("chars") + F.coalesce("under", zero)
            found = shared.select("conv_id", F.lit(depth).cast("long").alias("depth"), "parent", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.greatest(F.coalesce("n_leaves", zero), one).alias("n_leaves"), own.alias("saved"))
            found = scratch.table(found)
            done = done.unionByName(found)
            under = found.unionByName(chains.filter((F.col("top") == depth) & (F.col("depth") == depth)).select(*found.columns))
        # Conversations end at the last node of their path: a node of its own, or one that other paths go through.
        hashes = _ids_hash(members).join(paths.select(F.col("conv_id").alias("path"), F.col("length").alias("depth")), "path")
        if ended:
            hashes = hashes.join(reduce(DataFrame.unionByName, ended), "path", "left")
        else:
            hashes = hashes.withColumn("node", F.lit(None).cast("long"))
        ends = hashes.select(F.coalesce("node", "path").alias("conv_id"), "depth", "sha")
        nothing = F.lit(hashlib.sha256(b"").hexdigest())
        out = done.join(ends, ["conv_id", "depth"], "left")
        return materialize(out.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("sha", nothing).alias("ends_sha256")), "trie")
