"""Toxicity scores from a factorization machine over hashed terms.

A text's terms are its words and their beginnings, case folded, hashed to a fixed table, each counted once per text.
Terms whose presence differs between labels in the training sample become the model's features; the machine learns a
weight and a small factor for each, so that pairs (an insult with the mention of a group, say) count for more or less
than their parts. Training uses a bounded sample of labelled rows; scoring covers every text as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import Rolling, crc_mod, mixed, slices, utf8, word_spans

TABLE_BITS = 20
#: Lengths in bytes of the word beginnings that are terms too.
STEMS = (4, 5, 6, 7, 8)
#: Bound on the labelled rows the machine is fitted on, and on its features and factors.
TRAIN_ROWS, FEATURES, FACTORS = 6000, 1024, 4
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1

_APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with ASCII and Latin-1 capitals in lower case."""
    out = _FOLD[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    out[capital] += 0x20
    return out


def hashed_terms(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, term) of all words, then of all word beginnings of each length; a term is an index into the hashed table."""
    start, end, word_at = word_spans(data, at, _APART)
    hashes, row = Rolling(folded(data)), np.repeat(np.arange(len(at) - 1), np.diff(word_at))
    shift = np.uint64(64 - TABLE_BITS)
    yield row, (mixed(hashes(start, end)) >> shift).astype(np.int64)
    for n in STEMS:
        long = end - start >= n
        start, end, row = start[long], end[long], row[long]
        yield row, (mixed(hashes(start, start + n), seed=n) >> shift).astype(np.int64)


def terms(data: np.ndarray, at: np.ndarray, index: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, term) pairs of the texts data[at[i]:at[i+1]]; with an index only terms that it has features for."""
    found = []
    for row, term in hashed_terms(data, at):
        if index is not None:
            known = index[term] >= 0
            row, term = row[known], term[known]
        found.append((row << TABLE_BITS) | term)
    pairs = np.unique(np.concatenate(found))
    return pairs >> TABLE_BITS, pairs & ((1 << TABLE_BITS) - 1)


def _term_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "t"):
        row, term = terms(*utf8(part.column("t")))
        at = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([part.column("o"), part.column("y"), pa.ListArray.from_arrays(pa.array(at), pa.array(term.astype(np.int32)))], names=["o", "y", "terms"])


class Machine(NamedTuple):
    """Features by term (-1: none), bias, weights and factors."""

    index: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray


def machine_of(chosen: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray) -> Machine:
    index = np.full(1 << TABLE_BITS, -1, dtype=np.int16)
    index[chosen] = np.arange(len(chosen))
    return Machine(index, bias, w, v)


def score(machine: tuple, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
    """Sigmoid of bias + sum of w + half of (|sum of v|^2 - sum of |v|^2) over each row's features."""
    index, bias, w, v = machine
    f = index[term]
    row, f = row[f >= 0], f[f >= 0]
    z = bias + np.bincount(row, w[f], rows)
    for k in range(v.shape[1]):
        x = v[f, k]
        z += 0.5 * (np.bincount(row, x, rows) ** 2 - np.bincount(row, x * x, rows))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(labels: np.ndarray, row: np.ndarray, term: np.ndarray, steps: int = 150, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Choose features by a two-proportion z test, then fit by Adam on the mean logistic loss."""
    n, pos = len(labels), int(labels.sum())
    neg = n - pos
    if not pos or not neg:  # one label only: its smoothed share
        return machine_of(np.empty(0, np.int64), float(np.log((pos + 0.5) / (neg + 0.5))), np.zeros(0), np.zeros((0, FACTORS)))
    size = 1 << TABLE_BITS
    with_pos, with_all = np.bincount(term[labels[row] == 1], minlength=size), np.bincount(term, minlength=size)
    share = with_all / n
    z = (with_pos / pos - (with_all - with_pos) / neg) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / pos + 1 / neg))
    z[with_all < 4] = 0
    chosen = np.argsort(-np.abs(z), kind="stable")[:FEATURES]
    chosen = np.sort(chosen[np.abs(z[chosen]) >= 4])
    index = np.full(size, -1)
    index[chosen] = np.arange(len(chosen))
    f = index[term]
    row, f, m = row[f >= 0], f[f >= 0], len(chosen)
    r = np.random.default_rng(seed)
    params = [np.array([np.log(pos / neg)]), np.zeros(m), r.normal(0, 0.05, (m, FACTORS))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        b, w, v = params
        s = np.stack([np.bincount(row, v[f, k], n) for k in range(FACTORS)], axis=1)
        z = b[0] + np.bincount(row, w[f] - 0.5 * (v**2).sum(1)[f], n) + 0.5 * (s**2).sum(1)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / n
        gr = g[row]
        gw = np.bincount(f, gr, m)
        gv = np.stack([np.bincount(f, gr * s[row, k], m) for k in range(FACTORS)], axis=1)
        for i, d in enumerate([np.array([g.sum()]), gw + decay * w, gv - v * gw[:, None] + decay * v]):
            first[i] = 0.9 * first[i] + 0.1 * d
            second[i] = 0.999 * second[i] + 0.001 * d * d
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return machine_of(chosen, float(params[0][0]), params[1], params[2])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Machine:
    """Fit on at most `rows` labelled documents of the training folds, those whose ids hash lowest.

    Rows without id or label are left out; an id with both labels counts as toxic, one with several texts has the least.
    """
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, FOLDS) != HELD_OUT))
    y = y.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    y = y.orderBy(F.xxhash64("__id"), "__id").limit(rows)  # at most `rows` pairs: the broadcast is bounded
    sample = docs.join(F.broadcast(y), F.col(id_col) == F.col("__id")).groupBy(F.xxhash64("__id").alias("o"), "y").agg(F.min(text_col).alias("t"))
    got = sample.mapInArrow(_term_lists, "o bigint, y int, terms array<int>").toArrow().sort_by([("o", "ascending"), ("y", "ascending")])
    lists = got.column("terms").combine_chunks()
    y = got.column("y").to_numpy().astype(np.int64)
    count = np.diff(lists.offsets.to_numpy()) if len(y) else np.empty(0, np.int64)
    return fit(y, np.repeat(np.arange(len(y)), count), lists.flatten().to_numpy().astype(np.int64) if len(y) else np.empty(0, np.int64))


def scores(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, held_out, score, predicted. A null or empty text gets the score of no terms.

    Repeated rows give repeated rows; a null id's fold is that of the empty text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tuple(machine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            s = score(sent.value, *terms(*utf8(part.column("t")), sent.value[0]), part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("i"), part.column("h"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["i", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("i"), (crc_mod(id_col, FOLDS) == HELD_OUT).alias("h"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"i {kind}, held_out boolean, score double, predicted int").withColumnRenamed("i", id_col)


def keep_clean(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """The rows of docs scored below THRESHOLD, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(machine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            s = score(sent.value, *terms(*utf8(part.column(text_col)), sent.value[0]), part.num_rows)
            yield part.filter(pa.array(s < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
