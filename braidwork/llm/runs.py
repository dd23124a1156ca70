"""Periodic runs of words by the algorithm of Kolpakov and Kucherov.

A text's words are numbered by equality. The Lempel-Ziv factors come from the suffix automaton with each state's first end:
a factor is a new word, or the longest stretch that also starts earlier. Main's algorithm finds at every factor's start the
runs that cross or touch it, from longest common extensions to both sides of it; runs strictly inside a factor are copies
of runs inside its earlier occurrence. All of that is linear in the text.

A run that counts here holds its root four times and six words at least, so each three consecutive words of it occur three
times in it. Stretches in which that holds are found first, by counting; what lies between them is in no run.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices

#: A run holds its root so many times, and so many words, at least. The stretches() are right for 4 and 6 or more.
TIMES, LEAST = 4, 6


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """The Lempel-Ziv factors of w as (start, length, start of the earlier occurrence or -1); occurrences may overlap."""
    # the suffix automaton: transitions, suffix link, longest length and first end of each state
    step: list[dict[int, int]] = [{}]
    link, size, end = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(w):
        new = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        end.append(i)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(step[q].copy())
                link.append(link[q])
                size.append(size[p] + 1)
                end.append(end[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    out, i, n = [], 0, len(w)
    while i < n:
        at, j, source = 0, i, -1
        while j < n and end[to := step[at][w[j]]] < j:
            at, source = to, end[to]
            j += 1
        if j == i:
            out.append((i, 1, -1))
            i += 1
        else:
            out.append((i, j - i, source - (j - i) + 1))
            i = j
    return out


def _common(w: list[int]) -> list[int]:
    """For each place of w, how far w from there on agrees with w (0 at the first)."""
    n = len(w)
    z = [0] * n
    a = b = 0
    for i in range(1, n):
        k = min(z[i - a], b - i) if i < b else 0
        while i + k < n and w[k] == w[i + k]:
            k += 1
        z[i] = k
        if i + k > b:
            a, b = i, i + k
    return z


def _crossing(w: list[int], s: int, before: int, stop: int) -> Iterator[tuple[int, int, int]]:
    """Runs (start, end, period) that cross or touch place s of w and end in w[s:stop] or at s, from Main's extensions.

    They are sought in w[s - before:stop]; what could be extended beyond that is no run of this place and left out."""
    low = max(0, s - before)
    t, u = w[low:s], w[s:stop]
    longest = (len(t) + len(u)) // TIMES
    if len(t) + len(u) < LEAST:
        return
    back = t[::-1]
    right = _common(u)
    over = _common([*back, -1, *u[::-1], *back]) if u else []  # t's end against what precedes any place of u
    left = _common(back)
    ahead = _common([*u, -1, *t, *u]) if u else []
    found = []
    for p in range(1, min(longest, len(u)) + 1):  # a root right of s
        a, b = min(over[len(t) + 1 + len(u) - p], len(t)), right[p] if p < len(u) else 0
        if a + b + p >= max(LEAST, TIMES * p):
            found.append((s - a, s + p + b, p))
    for p in range(1, min(longest, len(t)) + 1):  # a root left of s
        a, b = left[p] if p < len(t) else 0, ahead[len(u) + 1 + len(t) - p] if u else 0
        b = min(b, len(u))
        if a + b + p >= max(LEAST, TIMES * p):
            found.append((s - p - a, s + b, p))
    for a, b, p in found:
        if not (a > 0 and w[a - 1] == w[a - 1 + p]) and not (b < len(w) and w[b] == w[b - p]):
            yield a, b, p


def runs(w: list[int]) -> list[tuple[int, int, int]]:
    """All runs of w as (start, length, period), in order. Numbers of w are not negative."""
    known: list[tuple[int, int]] = []  # (start, end) of all runs so far, in order
    period: dict[tuple[int, int], int] = {}

    def add(a: int, b: int, p: int) -> None:
        if (a, b) not in period:
            insort(known, (a, b))
            period[a, b] = p
        elif p < period[a, b]:
            period[a, b] = p

    before = 0
    for s, size, source in factors(w):
        for r in _crossing(w, s, 2 * before + size, s + size):
            add(*r)
        if source >= 0 and size > LEAST:
            at, shift = bisect_right(known, (source + 1, -1)), s - source
            while at < len(known) and known[at][0] < source + size:  # copies join the list before they are met
                a, b = known[at]
                if b < source + size:
                    add(a + shift, b + shift, period[a, b])
                at += 1
        before = size
    for r in _crossing(w, len(w), 2 * before, len(w)):
        add(*r)
    return [(a, b - a, period[a, b]) for a, b in known]


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (start, end) of ids, apart from each other, that hold all runs: every three consecutive ids of one occur
    three times in it, and it has LEAST ids at least."""
    out, todo = [], [(0, len(ids))]
    while todo:
        a, b = todo.pop()
        if b - a < LEAST:
            continue
        own = np.unique(ids[a:b], return_inverse=True)[1].astype(np.int64)
        kinds = int(own.max()) + 1
        if kinds < 1 << 21:
            three = (own[:-2] * kinds + own[1:-1]) * kinds + own[2:]
        else:
            three = np.unique(own[:-2] * kinds + own[1:-1], return_inverse=True)[1].astype(np.int64) * kinds + own[2:]
        _, which, n = np.unique(three, return_inverse=True, return_counts=True)
        good = n[which] >= TIMES - 1
        if good.all():
            out.append((a, b))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
        todo += [(a + x, a + y + 2) for x, y in zip(edge[::2].tolist(), edge[1::2].tolist())]
    return sorted(out)


def text_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """All runs of a list of words as (start, length, period), in order of start, then period."""
    if len(words) < LEAST:
        return []
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, count()), dtype=np.int64, count=len(words))
    return [(a + s, n, p) for a, b in stretches(ids) for s, n, p in runs(ids[a:b].tolist())]


def with_tail(words: list[bytes], doc_id: object) -> list[bytes]:
    """The words, of which every tenth document's (by its id's crc32) repeat a stretch from some place on."""
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first root."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for s, n, p in found:
        edge[s + p] += 1
        edge[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tails: bool = False, with_text: bool = False) -> DataFrame:
    """Per row of docs: id, n_runs, start, length, period and exponent_milli of its longest run (ties: the first; null if
    there is none), runs_sha256, collapsed_sha256 (and, with_text, runs and the collapsed text).

    tails makes every tenth document periodic first (see with_tail). A null, empty or short text has no runs, and a null id
    counts as the empty text there. Every row is judged alone, so repeated rows give equal rows; an empty table gives none.
    Memory is some hundred bytes for each word of the longest repetitive stretch of one text.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            rows = []
            for i, t in zip(part.column("name").to_pylist(), part.column("t").to_pylist()):
                words = (t or "").encode().split()
                words = with_tail(words, i) if tails else words
                found = text_runs(words)
                best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                text = b" ".join(collapsed(words, found))
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
                row = (len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest())
                rows.append((*row, [dict(zip(("start", "length", "period"), r)) for r in found], text.decode()) if with_text else row)
            columns = [pa.array(c, kind_) for c, kind_ in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names=["id", *names])

    long = pa.int64()
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    kinds = [long, long, long, long, long, pa.string(), pa.string()]
    schema = f"id {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    if with_text:
        names, kinds = [*names, "runs", "collapsed"], [*kinds, pa.list_(pa.struct([("start", long), ("length", long), ("period", long)])), pa.string()]
        schema += ", runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    rows = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
