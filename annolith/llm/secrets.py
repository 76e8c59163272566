"""Secret scan: three fixed patterns, and Shannon entropy over sliding windows for what they miss.

For the method, candidate strings are maximal runs of a character class, at least a window long. A window moves over
a run; its entropy follows from counts that change by one character in and one out. High windows that overlap form
one span. A span is reported unless the allow-list suppresses it or a pattern has found it already.

Offsets are code points, end exclusive. Null text counts as empty and has no spans; so has a text of white space.
Repeated rows give equal results. Long texts are scanned whole, in time linear in their length. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolith.llm.common import map_batches

#: The patterns and least lengths of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

WINDOW = 20
#: name, characters, least entropy (bits a character) of a window of 20; none of the classes holds a blank.
CLASSES = (
    ("entropy_hex", "0-9a-fA-F", 3.0),
    ("entropy_alnum", "A-Za-z0-9", 3.7),
    ("entropy_base64", "A-Za-z0-9+/_-", 3.9),
)
KINDS = ("assign", "access", "hex", *(c[0] for c in CLASSES))
#: Allow-list, cut out of a run before its windows: public identifiers, and placeholder words with what is attached to them.
PUBLIC = re.compile(
    r"(?<![0-9a-z])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-z])"  # UUID
    r"|(?<![0-9a-z])sha(1|256|384|512)-[0-9a-z+/]+",  # integrity attribute
    re.IGNORECASE,
)
WORDS = re.compile(r"example|sample|placeholder|dummy|changeme|your[_-]", re.IGNORECASE)
#: The key's own name, right before its value; it is looked for in so many characters.
NAME = re.compile(r"""([A-Za-z0-9_-]+)["']?[ \t]*[:=]=?[ \t]*["']?$""")
NAME_REACH = 160
#: Allow-list within a span: sequences and repeats.
REGULAR = re.compile(r"0123456789|abcdefghij|qwertyuiop|(.)\1{5}", re.IGNORECASE)
_WIDE = np.zeros(256, bool)
_WIDE[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True
_XLOGX = [0.0, *(n * math.log2(n) for n in range(1, WINDOW + 1))]


def high_windows(run: str, least: float, window: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Spans of run covered by windows of at least that entropy; overlapping windows make one span."""
    counts: dict[str, int] = {}
    total, full = 0.0, math.log2(window)
    start = end = -1
    for i, char in enumerate(run):
        if i >= window:
            old = run[i - window]
            n = counts[old]
            counts[old] = n - 1
            total += _XLOGX[n - 1] - _XLOGX[n]
        n = counts.get(char, 0)
        counts[char] = n + 1
        total += _XLOGX[n + 1] - _XLOGX[n]
        if i >= window - 1 and full - total / window >= least - 1e-9:
            first = i - window + 1
            if first > end >= 0:
                yield start, end
            if first > end:
                start = first
            end = i + 1
    if end >= 0:
        yield start, end


def wide_runs(data: bytes, least: int) -> list[tuple[int, int]]:
    """Byte ranges of maximal runs of the widest class of at least that length."""
    stops = np.flatnonzero(~_WIDE[np.frombuffer(data, np.uint8)])
    edges = np.concatenate(([-1], stops, [len(data)]))
    long = np.flatnonzero(np.diff(edges) > least)
    return [(int(edges[k]) + 1, int(edges[k + 1])) for k in long]


def not_allowed(run: str) -> list[tuple[int, int]]:
    """Ranges of a run that the allow-list leaves. A placeholder word takes what is attached to it, up to the next slash."""
    cut = [m.span() for m in PUBLIC.finditer(run)]
    if WORDS.search(run):
        cut += [m.span() for m in re.finditer("[^/]+", run) if WORDS.search(m[0])]
    out, at = [], 0
    for start, end in sorted(cut):
        if start - at >= WINDOW:
            out.append((at, start))
        at = max(at, end)
    return [*out, (at, len(run))] if len(run) - at >= WINDOW else out


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, further spans) of a text, each (start, kind's place in KINDS, end), sorted."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    base: list[tuple[int, int, int]] = []
    lower = data.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if b"AKIA" in data:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    more: list[tuple[int, int, int]] = []
    runs = wide_runs(data, WINDOW)
    # Code points before each byte, where bytes and code points differ: all but continuation bytes begin one.
    before = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1 if runs and not text.isascii() else None
    for first, last in runs:
        run = data[first:last].decode("ascii")
        at = first if before is None else int(before[first])
        base += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(run) if m.end() - m.start() >= MIN_HEX]
        name = NAME.search(text[max(0, at - NAME_REACH) : at])
        if name and WORDS.search(name[1]):
            continue
        for piece, end in not_allowed(run):
            for k, least, pattern in _CLASS_RUNS:
                for m in pattern.finditer(run, piece, end):
                    more += [(at + m.start() + a, k, at + m.start() + b) for a, b in high_windows(m[0], least)]
    base.sort()
    return base, sorted(_unsuppressed(text, base, more))


_CLASS_RUNS = [(3 + i, least, re.compile(f"[{chars}]{{{WINDOW},}}")) for i, (_, chars, least) in enumerate(CLASSES)]


def _unsuppressed(text: str, base: list, more: list) -> list[tuple[int, int, int]]:
    """Spans that no regular part suppresses and that neither the base spans together nor another one contain whole."""
    starts, ends = [], []  # of the union of the base spans
    for start, _, end in base:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    kept, last = [], -1
    for start, kind, end in sorted(more, key=lambda s: (s[0], -s[2], s[1])):  # of equal spans the narrow class explains it best
        at = bisect_right(starts, start) - 1
        if end <= last or (at >= 0 and end <= ends[at]) or REGULAR.search(text, start, end):
            continue
        last = end
        kept.append((start, kind, end))
    return kept


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _rows(cols: dict[str, list]) -> dict[str, list]:
    found = [scan(t) for t in cols["text"]]
    count = lambda kind: [sum(k == kind for _, k, _ in base) for base, _ in found]
    return {
        "doc_id": cols["doc_id"],
        "n_assign": count(0),
        "n_access": count(1),
        "n_hex": count(2),
        "base_sha256": [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found],
        "spans": [_joined(sorted(base + more)) for base, more in found],
        "masked": [mask(t or "", base + more) if base or more else t for t, (base, more) in zip(cols["text"], found, strict=True)] if "mask" in cols else [None] * len(found),
    }


def mask(text: str, spans: list[tuple[int, int, int]], sign: str = "[SECRET]") -> str:
    """The text with each span, or union of overlapping spans, replaced."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], sign]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", masked: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans; with masked also the masked text."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if masked:
        base = base.withColumn("mask", F.lit(True))
    out = map_batches(base, _rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, masked string")
    return out if masked else out.drop("masked")
