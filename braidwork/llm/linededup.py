"""Line-level deduplication by aligning pairs of documents.

A document's blocks are its shortest runs of consecutive lines, from any line on and up to any line, that reach MIN_WORDS
words. A document is paired with the earliest holder of each of its blocks that occurs in an earlier document, so a block
shared by any number of documents gives one pair per document, never all pairs, and none is too frequent to count. Every
line of a longer run that two documents share is in a block that both hold, so no shared run is missed. Each pair is
aligned with a patience diff on line hashes: lines unique to both sides and common to them anchor the alignment, which
then grows over equal neighbours. Aligned runs of lines with at least MIN_WORDS words are deleted from the later document,
and so are its blocks that the partner holds elsewhere: repeated on either side, or in another order.
Documents are judged on the input, not on what is left: a line is deleted only where an earlier document holds it, so each
line stays in the first document that has it. A block may be left in pieces, if its first holder has these from others.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import checkpoint, slices

#: Words an aligned run of lines needs in all to be deleted.
MIN_WORDS = 10


def line_hashes(text: str | None) -> tuple[list[int], list[int]]:
    """A signed 64-bit hash of every stripped line (0 for a blank one) and its number of words."""
    hashes, words = [], []
    for line in (text or "").encode().split(b"\n"):
        n = len(line.split())
        words.append(n)
        h = xxhash.xxh64_intdigest(line.strip(), 1) if n else 0
        hashes.append(h - (1 << 64) if h >= 1 << 63 else h)
    return hashes, words


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: sorted index pairs of aligned equal lines."""
    out, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        i, k, j, m = open_.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i == k or j == m:
            continue
        times_a, times_b = Counter(a[i:k]), Counter(b[j:m])
        place = {h: q for q, h in enumerate(b[j:m], j) if h and times_b[h] == 1 and times_a.get(h) == 1}
        pairs = [(p, place[h]) for p, h in enumerate(a[i:k], i) if h in place]
        tails, ends, back = [], [], []  # longest increasing run of partners
        for n, (_, q) in enumerate(pairs):
            at = bisect_left(tails, q)
            back.append(ends[at - 1] if at else -1)
            tails[at : at + 1], ends[at : at + 1] = [q], [n]
        chain, n = [], ends[-1] if ends else -1
        while n >= 0:
            chain.append(pairs[n])
            n = back[n]
        for p, q in chain:  # from the last to the first
            open_.append((p, k, q, m))
            k, m = p, q
        if chain:
            open_.append((i, k, j, m))
    return sorted(out)


def blocks(words: list[int], min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """(first, last + 1) of the shortest runs that reach min_words from each line on and up to each line, blank ends cut."""
    min_words = max(min_words, 1)
    out, total, i = set(), 0, 0
    for k, n in enumerate(words):
        total += n
        while total >= min_words and total - words[i] >= min_words:
            total, i = total - words[i], i + 1
        while i < k and not words[i]:
            i += 1
        if n and total >= min_words:
            out.add((i, k + 1))
    total, k = 0, len(words)
    for i in range(len(words) - 1, -1, -1):
        total += words[i]
        while total >= min_words and total - words[k - 1] >= min_words:
            k -= 1
            total -= words[k]
        while k - 1 > i and not words[k - 1]:
            k -= 1
        if words[i] and total >= min_words:
            out.add((i, k))
    return sorted(out)


def keys(hashes: list[int], words: list[int], min_words: int = MIN_WORDS) -> list[int]:
    """A signed 64-bit hash of each distinct block; that of its line where it is one line."""
    out = set()
    for i, k in blocks(words, min_words):
        h = hashes[i] if k == i + 1 else xxhash.xxh64_intdigest(np.array(hashes[i:k], dtype="<i8").tobytes(), 2)
        out.add(h - (1 << 64) if h >= 1 << 63 else h)
    return list(out)


def removable(a: list[int], words: list[int], b: list[int], min_words: int = MIN_WORDS) -> list[int]:
    """Indices of a's lines in runs, consecutive on both sides, of at least min_words words: the aligned ones, and the
    blocks of a that b holds anywhere, since alignment passes over lines that repeat and blocks in another order."""
    out, run = [], []
    for i, j in [*aligned(a, b), (-2, -2)]:
        if run and (i, j) != (run[-1][0] + 1, run[-1][1] + 1):
            if sum(words[p] for p, _ in run) >= min_words:
                out += [p for p, _ in run]
            run = []
        run.append((i, j))
    gone, there = set(out), set(b)
    if all(n in gone or not w or h not in there for n, (h, w) in enumerate(zip(a, words))):
        return out
    size = {h: w for h, w in zip(a, words) if w}
    held, start = set(), 0
    for stop in [*(j for j, h in enumerate(b) if h and h not in size), len(b)]:  # b's stretches of lines that a has
        part = b[start:stop]
        held.update(tuple(part[i:k]) for i, k in blocks([size.get(h, 0) for h in part], min_words))
        start = stop + 1
    for i, k in blocks(words, min_words):
        if tuple(a[i:k]) in held:
            gone.update(range(i, k))
    return sorted(gone)


def _lines(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            got = [line_hashes(t) for t in part.column("t").to_pylist()]
            shared = pa.array([keys(*g, min_words) for g in got], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("i"), part.column("h"), pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.int32())), shared], names=["id", "h", "lines", "words", "keys"])

    return run


def _align(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, w, b = (batch.column(c).to_pylist() for c in ("lines", "words", "other"))
            gone = [removable(*x, min_words) for x in zip(a, w, b)]
            part = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(gone, pa.list_(pa.int32()))], names=["id", "h", "gone"])
            yield part.filter(pa.array([bool(g) for g in gone]))

    return run


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(__id, __h, __gone): the line numbers to delete from each document that loses any."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    lines = checkpoint(rows.mapInArrow(_lines(min_words), f"id {kind}, h bigint, lines array<bigint>, words array<int>, keys array<bigint>").dropDuplicates(["id", "h"]))
    me = F.struct(F.col("id"), F.col("h"))  # documents are ordered by id (null first), then text hash
    holders = lines.select(me.alias("d"), F.explode("keys").alias("key"))
    # written down, so that the join below has plain shuffles on both sides and a very common block can be split over tasks
    first = checkpoint(holders.groupBy("key").agg(F.min("d").alias("p"), F.count("*").alias("n")).where("n > 1").select("key", "p"))
    pairs = holders.join(first, "key").where("d <> p").select("d", "p").distinct()
    left = lines.select(me.alias("d"), "lines", "words")
    right = lines.select(me.alias("p"), F.col("lines").alias("other"))
    both = pairs.join(right, "p").join(left, "d").select("d.id", "d.h", "lines", "words", "other")
    gone = both.mapInArrow(_align(min_words), f"id {kind}, h bigint, gone array<int>")
    return gone.groupBy(F.col("id").alias("__id"), F.col("h").alias("__h")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("__gone"))


def kept_lines(text: str, gone: list[int]) -> str:
    drop = set(gone)
    return "\n".join(line for n, line in enumerate(text.split("\n")) if n not in drop)


def _with_gone(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    gone = deletions(docs, id_col, text_col, min_words)
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__h")), "left").drop("__id", "__h")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the deleted lines cut from the text; a document left without any word is dropped, unless it had none.

    All columns stay. A null text stays null. Rows equal in id and text are one document and stay as they are to each
    other. A block's first holder is the document with the least id (null first), then text hash. Empty tables give none.
    """
    cut = F.filter(F.split(text_col, "\n", -1), lambda line, n: ~F.array_contains("__gone", n))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(cut, "\n"))
    out = _with_gone(docs, id_col, text_col, min_words).withColumn(text_col, text)
    return out.where(F.col("__gone").isNull() | F.col(text_col).rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Per row of docs: id, n_lines, n_removed, kept_sha256 (of what is left, in UTF-8; a null text counts as empty)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            texts = [t or "" for t in part.column("t").to_pylist()]
            gone = [g or [] for g in part.column("g").to_pylist()]
            sha = [hashlib.sha256((kept_lines(t, g) if g else t).encode()).hexdigest() for t, g in zip(texts, gone)]
            n = np.array([t.count("\n") + 1 for t in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(n), pa.array(np.array([len(g) for g in gone], dtype=np.int64)), pa.array(sha)], names=["i", "n_lines", "n_removed", "kept_sha256"])

    rows = _with_gone(docs.select(id_col, text_col), id_col, text_col, min_words).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col("__gone").alias("g"))
    return rows.mapInArrow(run, f"i {kind}, n_lines bigint, n_removed bigint, kept_sha256 string").withColumnRenamed("i", id_col)
