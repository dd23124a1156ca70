"""Ranked lexical search: postings traversed in windows of documents in order of their id, scores added up in small arrays.

One pass over the documents writes, for each, its postings of the queries' terms, and per task how many documents hold each
term. The postings are dealt in ranges of the id, so that a task meets documents in order of their id, WINDOW at a time.
Within a window postings are kept by term; a query adds its terms' contributions to an array of one number per document,
small enough for the cache, and notes in a bitset which documents it touched. These are harvested into the query's heap of the
k best, and the array is cleared there. The tasks' heaps are merged by query. Scores are whole numbers and add up in any order.

Queries are taken in packs of bounded size, each with its own pass; one pack is sent to the tasks at a time.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import checkpoint, partitions, ragged, range_hashes, slices, utf8, word_spans

#: Documents of a window, postings of a window at most (whole documents), bytes of a pack's terms, bitsets kept at once.
WINDOW, POSTINGS, PACK, BITSETS = 1 << 14, 4 << 20, 32 << 20, 4096
BEST = 10
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_IS_APART = np.zeros(256, dtype=bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _IS_APART[_a : _b + 1] = True
_DOCUMENTS, _TERMS = -1, -2


def terms(text: Column) -> Column:
    """Letters, digits and characters beyond ASCII, in runs, A-Z in lower case; none for null."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.array_remove(F.split(lower, APART), ""), F.array().cast("array<string>"))


class Terms:
    """Numbers of the terms of a sorted list, looked up by hash and compared as bytes."""

    def __init__(self, words: list[bytes]):
        size = np.array([len(x) for x in words], dtype=np.int64)
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        key = range_hashes(data, start, size)
        self.number = np.argsort(key, kind="stable")
        self.data, self.start, self.size, self.key = data, start[self.number], size[self.number], key[self.number]

    def __call__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each range of data, -1 for a range that is no term."""
        out = np.full(len(start), -1, dtype=np.int64)
        key = range_hashes(data, start, size)
        at = np.searchsorted(self.key, key)
        left = np.flatnonzero((at < len(self.key)))
        while len(left):
            left = left[self.key[at[left]] == key[left]]
            fits = left[self.size[at[left]] == size[left]]
            for own in np.array_split(fits, max(1, len(fits) >> 16)):
                if len(own):
                    differ = data[ragged(start[own], size[own])] != self.data[ragged(self.start[at[own]], size[own])]
                    same = own[~np.logical_or.reduceat(differ, np.cumsum(size[own]) - size[own])]
                    out[same] = self.number[at[same]]
            left = left[out[left] < 0]  # another term of the same hash, perhaps
            at[left] += 1
            left = left[at[left] < len(self.key)]
        return out


def _postings(words: list[bytes]):
    """Documents (id, t) to rows (id, n, salt, posts) of those with postings, then (term, df) of the task: posts are pairs of
    a term's number and its occurrences, salt a number that no other row has, n the document's terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df = Terms(words), np.zeros(len(words), dtype=np.int64)
        documents = all_terms = rows = 0
        kind = None
        salt = TaskContext.get().partitionId() << 40
        for part in slices(batches, "t"):
            kind = part.column("id").type
            data, at = utf8(part.column("t"))
            data = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)
            start, end, word_at = word_spans(data, at, _IS_APART)
            n = np.diff(word_at)
            documents, all_terms = documents + int((n > 0).sum()), all_terms + int(n.sum())
            number = known(data, start, end - start)
            doc = np.repeat(np.arange(len(n)), n)[number >= 0]
            pair, tf = np.unique(doc * max(len(words), 1) + number[number >= 0], return_counts=True)
            doc, number = np.divmod(pair, max(len(words), 1))
            df += np.bincount(number, minlength=len(words))
            posts = np.stack([number, tf], axis=1).astype("<u4")
            own, first = np.unique(doc, return_index=True)
            offsets = 8 * np.append(first, len(pair)).astype(np.int64)
            blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(posts.tobytes())])
            none = pa.nulls(len(own), pa.int64())
            yield _rows(part.column("id").take(pa.array(own)), pa.array(n[own]), pa.array(salt + rows + np.arange(len(own))), blobs.cast(pa.binary()), none, none)
            rows += len(own)
        if kind is None:
            return
        held = np.flatnonzero(df)
        number, many = np.concatenate([held, [_DOCUMENTS, _TERMS]]), np.concatenate([df[held], [documents, all_terms]])
        none = pa.nulls(len(number), pa.int64())
        yield _rows(pa.nulls(len(number), kind), none, none, pa.nulls(len(number), pa.binary()), pa.array(number), pa.array(many))

    return run


def _rows(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=["id", "n", "salt", "posts", "term", "df"])


class _Window:
    """The postings of some documents by term: slots of term k are slot[at[k]:at[k + 1]], with their contributions."""

    def __init__(self, n: np.ndarray, posts: np.ndarray, many: np.ndarray, weight: np.ndarray, documents: int, all_terms: int):
        self.docs = len(n)
        slot = np.repeat(np.arange(self.docs), many)
        term, tf = posts[:, 0].astype(np.int64), posts[:, 1].astype(np.int64)
        m = 10 + (90 * n * documents) // all_terms
        value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[slot]))
        order = np.argsort(term, kind="stable")
        order = order[value[order] > 0]
        self.slot, self.value = slot[order], value[order]
        self.at = np.searchsorted(term[order], np.arange(len(weight) + 1))
        self.total = np.zeros(self.docs, dtype=np.int64)
        self.bits: dict[int, np.ndarray] = {}

    def _touched(self, term: int) -> np.ndarray:
        """The bitset of the documents that hold a term."""
        if term not in self.bits:
            if len(self.bits) >= BITSETS:
                self.bits.clear()
            held = np.zeros(self.docs, dtype=bool)
            held[self.slot[self.at[term] : self.at[term + 1]]] = True
            self.bits[term] = np.packbits(held)
        return self.bits[term]

    def best(self, query: np.ndarray, above: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots and scores of the k best documents over a score, in order of score, then slot."""
        occupied = np.zeros((self.docs + 7) // 8, dtype=np.uint8)
        for term in query[self.at[query + 1] > self.at[query]].tolist():
            own = slice(self.at[term], self.at[term + 1])
            self.total[self.slot[own]] += self.value[own]  # no slot twice in a term
            occupied |= self._touched(term)
        slots = np.flatnonzero(np.unpackbits(occupied, count=self.docs))
        score = self.total[slots]
        self.total[slots] = 0
        keep = score > above
        if keep.sum() > k:
            keep &= score >= np.partition(score, -k)[-k]
        slots, score = slots[keep], score[keep]
        first = np.lexsort((slots, -score))[:k]
        return slots[first], score[first]


def _ranked(queries: list[np.ndarray], weight: np.ndarray, documents: int, all_terms: int, k: int):
    """Rows (id, n, posts) in order of id to (query, id, score), at most k of a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple[int, int, object]]] = [[] for _ in queries]
        seen, held, rows, posts = 0, [], 0, 0
        kind = None

        def window() -> None:
            nonlocal seen, rows, posts
            if not held:
                return
            ids = pa.chunked_array([b.column("id") for b in held])
            blobs = [utf8(b.column("posts")) for b in held]
            many = np.concatenate([np.diff(at) for _, at in blobs]) // 8
            flat = np.concatenate([data for data, _ in blobs]).view("<u4").reshape(-1, 2)
            w = _Window(np.concatenate([b.column("n").to_numpy() for b in held]), flat, many, weight, documents, all_terms)
            for heap, query in zip(heaps, queries):
                slots, score = w.best(query, heap[0][0] if len(heap) == k else 0, k)
                for s, x in zip(slots.tolist(), score.tolist()):
                    entry = (x, -(seen + s), ids[s].as_py())  # of equal scores the first id wins
                    heapq.heappush(heap, entry) if len(heap) < k else heapq.heappushpop(heap, entry)
            seen, rows, posts = seen + w.docs, 0, 0
            held.clear()

        for batch in batches:
            kind = batch.schema.field("id").type
            for part in slices(iter([batch]), "posts", 8 * POSTINGS):
                while part.num_rows:
                    take = min(part.num_rows, WINDOW - rows)
                    own, part = part.slice(0, take), part.slice(take)
                    size = len(utf8(own.column("posts"))[0]) // 8
                    if posts + size > POSTINGS:
                        window()
                    held.append(own)
                    rows, posts = rows + take, posts + size
                    if rows >= WINDOW:
                        window()
        window()
        out = [(q, i, x) for q, heap in enumerate(heaps) for x, _, i in heap]
        if not out:
            return
        q, i, x = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, kind), pa.array(x, pa.int64())], names=["query", "id", "score"])

    return run


def search(
    docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id", query_col: str = "text", best: int = BEST, pack_bytes: int = PACK
) -> DataFrame:
    """(query id, rank, id, score): the best documents of each query with a score above 0, best first, ties by id.

    A term's weight w is floor(1000 ln((2N + 2) / (2 df + 1))); a document adds w * (10^9 tf div (1000 tf + 8 m)) with
    m = 10 + 90 n N div L, for each term of the query once. Null or empty texts hold no terms and are in no count or rank. Rows of
    one query id are one query, be it null. Every row of docs is a document, so repeated rows take ranks of their own; a
    null id stands behind the others on ties. An empty table on either side gives no rows.
    """
    from pyspark.sql import Window as W

    spark = docs.sparkSession
    kind, query_kind = docs.schema[id_col].dataType, queries.schema[query_id_col].dataType
    long = T.LongType()
    postings = T.StructType().add("id", kind).add("n", long).add("salt", long).add("posts", T.BinaryType()).add("term", long).add("df", long)
    scored = T.StructType().add("query", long).add("id", kind).add("score", long)
    pairs = checkpoint(queries.select(F.col(query_id_col).alias("q"), F.explode(terms(F.col(query_col))).alias("term")).distinct())
    packs = math.ceil((pairs.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0) / pack_bytes)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    found = spark.createDataFrame([], T.StructType().add("q", query_kind).add("id", kind).add("score", long))
    for pack in range(packs):
        # about pack_bytes of terms come to the driver, whatever the number of queries
        own = sorted(pairs.where(F.pmod(F.xxhash64("q"), F.lit(packs)) == pack).collect(), key=lambda r: (r.q is not None, r.q, r.term))
        words = sorted({r.term.encode() for r in own})
        number = {x: i for i, x in enumerate(words)}
        asked: dict[object, list[int]] = {}
        for r in own:
            asked.setdefault(r.q, []).append(number[r.term.encode()])
        if not asked:
            continue
        index = checkpoint(texts.mapInArrow(_postings(words), postings))
        counts = dict(index.where("term IS NOT NULL").groupBy("term").agg(F.sum("df")).collect())  # a row per term of the pack
        documents, all_terms = counts.get(_DOCUMENTS, 0), counts.get(_TERMS, 0)
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * counts.get(i, 0) + 1))) for i in range(len(words))], dtype=np.int64)
        place = [F.col("id").isNull(), "id", "salt"]
        dealt = index.where("term IS NULL").repartitionByRange(partitions(spark), *place).sortWithinPartitions(*place).select("id", "n", "posts")
        ranked = dealt.mapInArrow(_ranked([np.array(x) for x in asked.values()], weight, documents, all_terms, best), scored)
        names = spark.createDataFrame(list(enumerate(asked)), T.StructType().add("query", long).add("q", query_kind))
        found = found.unionByName(ranked.join(F.broadcast(names), "query").select("q", "id", "score"))
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= best).select(F.col("q").alias(query_id_col), "rank", F.col("id").alias(id_col), "score")
