"""Best-fit packing of token sequences by a grouping genetic algorithm.

A packing is decided on counts of pieces by length (at most `capacity` of them, whatever the corpus), so an individual
is a list of bin patterns with multiplicities. Crossover injects whole well-filled bins of one parent into the other,
removes bins that would use a document twice, and best-fits the displaced documents. Islands evolve in parallel Spark
tasks; their best individuals migrate around the ring between epochs. Evolution ends at the lower bound.

Pieces then get their place: a rank among the pieces of their length (salted, so that no length is one task), and
from it a bin of the winning packing.

Null text is empty; an empty text is its end mark alone. Repeated rows are packed each. An empty table gives an empty
result. Special-token strings in a text become what the tokenizer makes of them. Other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import random
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolith.llm.common import map_batches, materialize, salted_rank, salts_for

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
END_ID = 0

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first
Packing = list[tuple[Pattern, int]]


# -- tokens ------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _slow(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@lru_cache(maxsize=2)
def _fast(name: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name.removesuffix(".json") + ".tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Bytes of UTF-8 below U+0280, where both libraries cut words alike.
_LATIN = bytes(range(0xCA))


def encode(text: str, name: str = TOKENIZER) -> np.ndarray:
    """Ids of the named tokenizer. Latin text goes through the same vocabulary in the faster library; all other text, and special tokens, through the tokenizer itself."""
    if text.encode("utf-8", "surrogatepass").translate(None, _LATIN) or "<|" in text:
        return np.array(_slow(name).encode(text, add_special_tokens=False).ids, np.uint32)
    return _fast(name).encode_to_numpy(text, disallowed_special=()).astype(np.uint32)


def cut(n_ids: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n_ids: full pieces, the first of them shorter if need be."""
    first = n_ids % capacity or min(n_ids, capacity)
    starts = [0, *range(first, n_ids, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n_ids], strict=True)]


def _pieces(name: str, capacity: int):
    def make(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc_id, text in zip(cols["doc_id"], cols["text"], strict=True):
            ids = np.append(encode(text or "", name), np.uint32(END_ID)).astype("<u4")
            for k, (start, length) in enumerate(cut(len(ids), capacity)):
                row = (doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes()))
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
        return out

    return make


# -- the genetic algorithm ---------------------------------------------------------------------------------------


def _largest(available: int, room: int) -> int:
    """The largest length whose bit is set, at most room; 0 if none. available: bit n for each length n in stock."""
    return (available & ((1 << (room + 1)) - 1)).bit_length() - 1 if room > 0 else 0


def scatter(stock: dict[int, int], capacity: int, rng: random.Random) -> Packing:
    """Bins for all of stock, filled with pieces drawn at random: what evolution starts from."""
    left = {n: c for n, c in stock.items() if c}
    lengths, packing = sorted(left), []
    while lengths:
        parts: dict[int, int] = {}
        room = capacity
        while (fits := bisect_right(lengths, room)) and rng.random() < 0.9:
            n = lengths[rng.randrange(fits)]
            if parts.get(n, 0) == left[n]:
                break
            parts[n] = parts.get(n, 0) + 1
            room -= n
        if not parts:
            parts = {rng.choice(lengths): 1}
        times = min(left[n] // c for n, c in parts.items())
        for n, c in parts.items():
            left[n] -= c * times
            if not left[n]:
                lengths.remove(n)
        packing.append((tuple(sorted(parts.items(), reverse=True)), times))
    return tidy(packing)


def best_fit(stock: dict[int, int], capacity: int, rng: random.Random | None = None) -> Packing:
    """Bins for all of stock: each opens with the longest piece and takes what fits best. With rng some choices differ."""
    stock = {n: c for n, c in stock.items() if c}
    bits = sum(1 << n for n in stock) | 1
    packing: Packing = []
    while bits > 1:
        parts: dict[int, int] = {}
        room, seen = capacity, bits
        while (n := _largest(seen, room)) > 0:
            if rng and parts and rng.random() < 0.15:  # leave this length to another bin
                seen &= ~(1 << n)
                continue
            take = min(stock[n], room // n)
            if rng and take > 1 and parts and rng.random() < 0.3:
                take = rng.randint(1, take)
            parts[n] = parts.get(n, 0) + take
            room -= take * n
            seen &= (1 << n) - 1
        times = min(stock[n] // c for n, c in parts.items())
        for n, c in parts.items():
            stock[n] -= c * times
            if not stock[n]:
                bits &= ~(1 << n)
        packing.append((tuple(sorted(parts.items(), reverse=True)), times))
    return packing


def used(pattern: Pattern) -> int:
    return sum(n * c for n, c in pattern)


def bins(packing: Packing) -> int:
    return sum(times for _, times in packing)


def fitness(packing: Packing, capacity: int) -> tuple[int, float]:
    """Smaller is better: bins, then less concentrated filling."""
    return bins(packing), -sum(times * (used(p) / capacity) ** 2 for p, times in packing)


def tidy(packing: Packing) -> Packing:
    total: dict[Pattern, int] = {}
    for pattern, times in packing:
        if times:
            total[pattern] = total.get(pattern, 0) + times
    return list(total.items())


def place(packing: Packing, displaced: dict[int, int], capacity: int, rng: random.Random | None) -> Packing:
    """Best-fit displaced pieces: longest first, each into the open bin it fills best; the rest into new bins."""
    displaced = {n: c for n, c in displaced.items() if c}
    by_room: dict[int, list[tuple[Pattern, int]]] = {}
    for pattern, times in packing:
        by_room.setdefault(capacity - used(pattern), []).append((pattern, times))
    for n in sorted(displaced, reverse=True):
        while displaced[n]:
            room = min((r for r in by_room if r >= n), default=None)
            if room is None:
                break
            pattern, times = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
            move = min(times, displaced[n])
            displaced[n] -= move
            grown = dict(pattern)
            grown[n] = grown.get(n, 0) + 1
            by_room.setdefault(room - n, []).append((tuple(sorted(grown.items(), reverse=True)), move))
            if times > move:
                by_room.setdefault(room, []).append((pattern, times - move))
    return tidy([x for group in by_room.values() for x in group] + best_fit(displaced, capacity, rng))


def well_filled(packing: Packing) -> int:
    """Median filling of the bins: from there on bins are handed on whole."""
    half = bins(packing) / 2
    for pattern, times in sorted(packing, key=lambda x: -used(x[0])):
        half -= times
        if half <= 0:
            return used(pattern)
    return 0


def crossover(base: Packing, donor: Packing, stock: dict[int, int], capacity: int, rng: random.Random) -> Packing:
    """A child: some well-filled bins of donor, then those of base that use no document twice; all others displaced."""
    least = well_filled(donor)
    good = [(p, t) for p, t in donor if used(p) >= least]
    left, child = dict(stock), []
    injected = rng.sample(good, max(1, len(good) // 2))
    for pattern, times in [*injected, *(x for x in base if used(x[0]) >= least)]:
        keep = min([times, *(left[n] // c for n, c in pattern)])  # a bin that holds a used document goes
        if keep:
            child.append((pattern, keep))
            for n, c in pattern:
                left[n] -= c * keep
    return place(child, left, capacity, rng)


def mutate(packing: Packing, capacity: int, rng: random.Random) -> Packing:
    """Open the emptiest bins and a share of the others anew."""
    ranked = sorted(packing, key=lambda x: used(x[0]))
    out = set(range(max(1, len(ranked) // 10))) | set(rng.sample(range(len(ranked)), int(len(ranked) * rng.choice((0.05, 0.2, 0.5)))))
    free: dict[int, int] = {}
    for i in out:
        for n, c in ranked[i][0]:
            free[n] = free.get(n, 0) + c * ranked[i][1]
    return place([x for i, x in enumerate(ranked) if i not in out], free, capacity, rng)


def evolve(stock: dict[int, int], capacity: int, seed: int, population: int, patience: int, settlers: list[Packing], fitted: bool = False) -> list[Packing]:
    """One island's epoch, until `patience` generations in a row bring nothing: its best two packings, the best first.
    fitted: one founder packs by best fit, with some choices at random; all others are scattered."""
    rng = random.Random(seed)
    bound = lower_bound(stock, capacity)
    people = list(settlers) or [best_fit(stock, capacity, rng)] * fitted
    while len(people) < population:
        people.append(scatter(stock, capacity, rng))
    key = lambda p: fitness(p, capacity)
    people.sort(key=key)
    idle = 0
    while idle < patience:
        least = key(people[0])
        one, two = (min(rng.sample(people, min(2, len(people))), key=key) for _ in range(2))
        child = crossover(one, two, stock, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, capacity, rng)
        people = sorted([*people, child], key=key)[:population]
        if bins(people[0]) <= bound:
            break
        idle = 0 if key(people[0]) < least else idle + 1
    return people[:2]


def lower_bound(stock: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins: by total size, or by pieces of which two never share a bin."""
    total = sum(n * c for n, c in stock.items())
    return max(-(-total // capacity), sum(c for n, c in stock.items() if 2 * n > capacity))


def pack_counts(spark: SparkSession, stock: dict[int, int], capacity: int = CAPACITY, islands: int = 6, epochs: int = 3, population: int = 6, patience: int = 12, seed: int = 5) -> Packing:
    """The best packing that the islands find, or plain best fit where none is as good. stock has at most `capacity` lengths; that bounds all that is sent."""
    if not stock:
        return []
    best: Packing | None = None
    settlers: list[list[Packing]] = [[] for _ in range(islands)]
    for epoch in range(epochs):

        def run(frames: Iterator[pd.DataFrame], epoch: int = epoch, settlers: list = settlers) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for k in frame["id"]:
                    elite = evolve(stock, capacity, seed * 1000 + epoch * 100 + int(k), population, patience, settlers[k], k % 2 == 1)
                    yield pd.DataFrame({"island": [k], "elite": [json.dumps(elite)]})

        rows = spark.range(0, islands, 1, islands).mapInPandas(run, "island long, elite string").collect()
        found = {r["island"]: [[(tuple(map(tuple, p)), t) for p, t in packing] for packing in json.loads(r["elite"])] for r in rows}
        best = min([*([best] if best else []), *(p for elite in found.values() for p in elite)], key=lambda p: fitness(p, capacity))
        if bins(best) <= lower_bound(stock, capacity):
            break
        settlers = [[found[k][0], *found[(k - 1) % islands][:1]] for k in range(islands)]
    return tidy(min(best, best_fit(stock, capacity), key=bins))


# -- documents into sequences ------------------------------------------------------------------------------------


def layout(packing: Packing) -> tuple[np.ndarray, ...]:
    """For each length in each pattern: key (length and first rank), pieces a bin, first sequence, first offset."""
    rows, next_rank, sequence = [], {}, 0
    for pattern, times in packing:
        at = 0
        for n, c in pattern:
            rank = next_rank.get(n, 0)
            rows.append(((n << 48) + rank, rank, c, sequence, at))
            next_rank[n] = rank + c * times
            at += n * c
        sequence += times
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else tuple(np.zeros(0, np.int64) for _ in range(5))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialize(map_batches(base, _pieces(tokenizer, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `capacity` rows
    packing = pack_counts(spark, {int(r["length"]): int(r["n"]) for r in counts}, capacity)
    table = spark.sparkContext.broadcast(layout(packing))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, first, each, sequence, offset = table.value
        for frame in frames:
            length, rank = frame["length"].to_numpy(np.int64), frame["rank"].to_numpy(np.int64)
            row = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            place_ = rank - first[row]
            frame["sequence_id"] = sequence[row] + place_ // each[row]
            frame["offset"] = offset[row] + place_ % each[row] * length
            yield frame.drop(columns="rank")

    ranked = salted_rank(pieces, ["length"], [F.col(c).asc_nulls_last() for c in ("doc_id", "piece", "ids_crc32")], F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts_for(pieces.count()))))
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(assign, f"{columns}, sequence_id long, offset long")
