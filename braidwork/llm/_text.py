"""Helpers shared by the operators: bounded Arrow slices, word spans, rolling hashes, checkpoints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint
from ..session import shared_folder as shared_dir

__all__ = ["SPACE", "Rolling", "checkpoint", "crc_mod", "distinct", "mixed", "partitions", "ragged", "range_hashes", "shared_dir", "slices", "utf8", "word_spans"]

#: Bytes that end a word: space and \t \n \v \f \r, as in ``[^\x20\x09-\x0D]+``. bytes.split() uses the same six.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Text bytes a Python worker handles at once; a single longer text is handled alone.
CHUNK_BYTES = 4 << 20


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and len + 1 offsets; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the column has about limit bytes in each; no row is cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(column))
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
            yield batch.slice(row, stop - row)
            row = stop


def word_spans(data: np.ndarray, at: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and len + 1 offsets of each text's words."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = ~apart[data]
    begins, ends = inside.copy(), np.zeros(len(data) + 1, dtype=bool)
    begins[1:] &= ~inside[:-1]
    ends[1:] = inside[:-1] & ~inside[1:]
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts] |= inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return start, end, np.searchsorted(start, at)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h + np.uint64(seed)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """64-bit polynomial hashes of any ranges of a sequence of small integers, from one cumulative sum."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n)[:n], out=self.sums[1:], dtype=np.uint64)
        self.back = _powers(_INVERSE, n)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64)


def range_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray, part: int = 1 << 20) -> np.ndarray:
    """64-bit polynomial hashes of the ranges data[start:start+size], none of them empty, a bounded number of bytes at once.

    Some long texts share a hash by their form alone; who needs equality compares bytes (see distinct)."""
    power = _powers(_BASE, 4095)
    out, ends = size.astype(np.uint64), np.cumsum(size)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(part, int(ends[-1]) if len(ends) else 0, part)) + 1, [len(start)]]))
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        if b == a + 1:  # perhaps a very long one
            for i in range(0, int(size[a]), part):
                own = data[start[a] + i : start[a] + min(i + part, size[a])].astype(np.uint64) + np.uint64(1)
                out[a : a + 1] += (own * power[np.arange(i, i + len(own)) & 4095]).sum(dtype=np.uint64)
            continue
        values = data[ragged(start[a:b], size[a:b])].astype(np.uint64) + np.uint64(1)
        values *= power[ragged(np.zeros(b - a, np.int64), size[a:b]) & 4095]
        out[a:b] += np.add.reduceat(values, np.cumsum(size[a:b]) - size[a:b])
    return out


def distinct(data: np.ndarray, start: np.ndarray, size: np.ndarray, part: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the distinct ranges data[start:start+size] and, for every range, the number of its equal among them.

    In order of their hash; ranges that share one without being equal stand last, in order of their bytes. So the order
    depends on the ranges alone, not on where they stand."""
    key = range_hashes(data, start, size, part)
    _, pick, flat = np.unique(key, return_index=True, return_inverse=True)
    lead = pick[flat]
    wrong = size[lead] != size
    ends = np.cumsum(size)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(part, int(ends[-1]) if len(ends) else 0, part)) + 1, [len(start)]]))
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        same = a + np.flatnonzero(~wrong[a:b] & (lead[a:b] != np.arange(a, b)))
        if len(same):
            differ = data[ragged(start[same], size[same])] != data[ragged(start[lead[same]], size[same])]
            wrong[same] = np.logical_or.reduceat(differ, np.cumsum(size[same]) - size[same])
    if not wrong.any():
        return pick, flat
    mixed_up = np.zeros(len(pick), dtype=bool)
    mixed_up[flat[wrong]] = True
    rows = np.flatnonzero(mixed_up[flat])
    texts = [data[start[i] : start[i] + size[i]].tobytes() for i in rows.tolist()]
    order = {t: n for n, t in enumerate(sorted(set(texts)))}
    first = dict(zip(reversed(texts), reversed(rows.tolist())))
    number = np.cumsum(~mixed_up) - 1
    flat = number[flat]
    flat[rows] = int((~mixed_up).sum()) + np.array([order[t] for t in texts])
    return np.concatenate([pick[~mixed_up], np.array([first[t] for t in order])]), flat


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] values), start[1], ..."""
    total = int(count.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    begin = np.cumsum(count) - count
    return np.arange(total, dtype=np.int64) + np.repeat(start - begin, count)


def crc_mod(column: str, modulus: int):
    """crc32 of an id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
