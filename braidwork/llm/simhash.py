"""SimHash near-duplicates through pivot distance tables.

Every fingerprint gets its Hamming distances to a table of reference fingerprints. By the triangle inequality the
distances of two fingerprints within radius r differ by r at most in every coordinate. Thirty-three of the references
are built so that pairs of coordinates give the number of set bits in each of 32 two-bit segments; two fingerprints
within three bits agree on the segments of at least three of six groups, which makes the coordinates of each choice of
three groups an equi-join key. Pairs that share a key and whose largest coordinate difference, over random references
too, is within the radius are verified bit by bit. Nothing is missed, at any input size.

keep_one is the operator for similarities instead of bits (see nearcopies), where fingerprints alone don't decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components, spanning
from ._text import _powers, checkpoint, mixed, partitions, slices
from .nearcopies import buckets, keep_one

__all__ = ["close", "distances", "fingerprint", "fingerprints", "keep_one", "links", "near_duplicates", "pivot_keys"]

RADIUS = 3
SEGMENTS, GROUPS = 32, 6
#: Zero, the 32 two-bit masks (structured references), then 31 scattered ones.
REFERENCES = np.concatenate([[np.uint64(0)], np.uint64(3) << (2 * np.arange(SEGMENTS, dtype=np.uint64)), mixed(_powers(np.uint64(0x9E3779B97F4A7C15), 30))])
_CHOICES = list(combinations(range(GROUPS), GROUPS - RADIUS))
#: A bucket with more fingerprints is dealt out again, by the bits of each of four 16-bit blocks.
BUCKET_ROWS = 4096
#: Fingerprints compared at once.
_BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of lower-cased 3-word shingles, repeats included; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < 3:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        hashes = list(map(xxhash.xxh64_intdigest, map(b" ".join, zip(words, words[1:], words[2:])), repeat(42)))
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _BLOCK):
        part = np.array(hashes[i : i + _BLOCK], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, __fp bigint): one row per row of docs. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            fp = np.array([fingerprint(t) for t in part.column("t").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(fp.view(np.int64))], names=["i", "__fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"i {kind}, __fp bigint").withColumnRenamed("i", id_col)


def distances(fp: np.ndarray) -> np.ndarray:
    """The pivot table's rows: Hamming distance of every fingerprint to every reference."""
    return np.bitwise_count(fp[:, None] ^ REFERENCES[None, :]).astype(np.int16)


def pivot_keys(fp: np.ndarray) -> np.ndarray:
    """One join key per fingerprint and choice of three segment groups, from the pivot distances."""
    table = distances(fp)
    segment = ((table[:, :1] + 2 - table[:, 1 : SEGMENTS + 1]) // 2).astype(np.uint64)  # bits set in each segment
    shifted = segment << (2 * np.arange(SEGMENTS, dtype=np.uint64))
    packed = np.stack([shifted[:, g].sum(axis=1, dtype=np.uint64) for g in np.array_split(np.arange(SEGMENTS), GROUPS)], axis=1)
    return np.stack([mixed(packed[:, c].sum(axis=1, dtype=np.uint64), seed=k + 1) for k, c in enumerate(_CHOICES)], axis=1)


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs survive the largest coordinate difference and the exact check."""
    keep = np.ones(len(a), dtype=bool)
    for pivots in np.array_split(REFERENCES, 4):  # coordinates in turn, on what is left
        i = np.flatnonzero(keep)
        x, y = (np.bitwise_count(p[i, None] ^ pivots).astype(np.int16) for p in (a, b))
        keep[i] = np.abs(x - y).max(axis=1) <= RADIUS
    i = np.flatnonzero(keep)
    keep[i] = np.bitwise_count(a[i] ^ b[i]) <= RADIUS
    return keep


def _links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the close pairs within equal keys; rows are sorted by key. Works a block of pairs at a time."""
    u, v = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    stops = np.searchsorted(key, key, side="right")
    step, open_ = 1, np.flatnonzero(np.arange(len(key)) + 1 < stops)
    while len(open_):
        for i in np.array_split(open_, -(-len(open_) // _BLOCK)):
            ok = close(fp[i], fp[i + step])
            u.append(fp[i][ok])
            v.append(fp[i + step][ok])
        if sum(map(len, u)) > _BLOCK:  # keep a forest, not all pairs
            a, b = spanning(np.concatenate(u), np.concatenate(v))
            u, v = [a], [b]
        step += 1
        open_ = open_[open_ + step < stops[open_]]
    return spanning(np.concatenate(u), np.concatenate(v))


def _bucket_stage(last: bool):
    """Rows (key, fp) sorted by key, to rows (kind, a, b): 0 a link, 1 a row of a large bucket under a finer key."""

    def finer(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        for block in range(4 if len(key) else 0):
            bits = (fp >> np.uint64(16 * block)) & np.uint64(0xFFFF)
            yield _rows(1, mixed(mixed(key) ^ (bits << np.uint64(2)) ^ np.uint64(block)), fp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hot, rows in buckets(batches, None if last else BUCKET_ROWS):
            key = rows.column(0).to_numpy(zero_copy_only=False)
            fp = rows.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            big = np.full(len(key), hot)
            if not hot and not last:
                big = np.searchsorted(key, key, side="right") - np.searchsorted(key, key, side="left") > BUCKET_ROWS
            u, v = _links(key[~big], fp[~big])
            yield _rows(0, u, v)
            yield from finer(key[big].view(np.uint64), fp[big])

    return run


def _rows(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["kind", "a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """(u, v): links between distinct fingerprints of column __fp, with the components of all pairs within RADIUS bits."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            k = pivot_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel().view(np.int64)), pa.array(np.repeat(fp, k.shape[1]).view(np.int64))], names=["key", "fp"])

    n = partitions(fps.sparkSession)
    rows = fps.select("__fp").mapInArrow(keys, "key bigint, fp bigint")
    deal = lambda df, last: df.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_bucket_stage(last), "kind int, a bigint, b bigint")
    first = checkpoint(deal(rows, False))
    finer = deal(first.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp")).distinct(), True)
    return first.where("kind = 0").unionByName(finer).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' ids with fingerprint (16 hex digits) and component_id (the least id reachable through links).

    A null or empty text has no words and fingerprint zero, linked like any other. A null id takes part; it is
    component_id only where its component has no other id. Repeated rows give repeated rows. An empty table gives none.
    """
    fps = checkpoint(fingerprints(docs.select(id_col, text_col), id_col, text_col))
    nodes = checkpoint(fps.groupBy("__fp").agg(F.min(id_col).alias("__least")))
    roots = components(links(nodes))
    rooted = nodes.join(roots.withColumnRenamed("node", "__fp"), "__fp", "left").withColumn("__root", F.coalesce("root", "__fp"))
    least = rooted.groupBy("__root").agg(F.min("__least").alias("component_id"))
    named = rooted.select("__fp", "__root").join(least, "__root").select("__fp", "component_id")
    return fps.join(named, "__fp").select(id_col, F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")
