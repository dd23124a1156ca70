"""Exact removal of repeated word windows by super-k-mer partitioning.

Every window of WINDOW words has a minimiser, the least hash of its runs of MINI words. Consecutive windows of a
document that share it form a super-k-mer, whose words travel once, packed in one string, to the minimiser's bucket;
equal windows have equal minimisers and so meet there, where they are sorted, counted and compared as text. A chunk of
documents sends each distinct super-k-mer once (its earliest place) and packs and compresses all of a bucket's strings
together; a task sends one that recurs in its chunks three times at most, as far as a bounded memory holds them, so a
passage that every document has travels a few times a task, not once a chunk. Minimisers that hold a large share of all super-k-mers are found first, and their windows dealt out one by
one by the hash of the whole window, so that a passage in very many documents loads no single bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import Rolling, checkpoint, mixed, partitions, ragged, slices, utf8, word_spans

WINDOW, MINI = 20, 3
#: Text handled at once, buckets per shuffle partition.
CHUNK, BUCKETS = 5 << 20, 12
#: A minimiser with over one in HEAVY super-k-mers is dealt by window; at most HEAVY such exist.
HEAVY = 2000
#: Of super-k-mers that recur in a task's chunks: hashes that are remembered, bytes of text that are.
SLOTS, ROOM = 1 << 21, 64 << 20
_NULL_ID = -(1 << 63)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    span, out = 1, h
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of the equally long ranges at a and at b hold the same bytes."""
    ok = np.ones(len(a), dtype=bool)
    for i in range(0, len(a), 4096):
        x, y, n = a[i : i + 4096], b[i : i + 4096], length[i : i + 4096]
        differ = data[ragged(x, n)] != data[ragged(y, n)]
        count = np.concatenate([[0], np.cumsum(differ)])
        ends = np.cumsum(n)
        ok[i : i + 4096] = count[ends] == count[ends - n]
    return ok


def super_kmers(data: np.ndarray, at: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, ...]:
    """The texts' super-k-mers: words (each with one space after it), and per super-k-mer its text's number, first window,
    windows, first byte, bytes, and routing hash; and the number of words of every text."""
    start, end, word_at = word_spans(data, at)
    n_words = np.diff(word_at)
    size = end - start + 1
    to = np.concatenate([[0], np.cumsum(size)])
    packed = np.full(int(to[-1]), 0x20, dtype=np.uint8)
    packed[ragged(to[:-1], size - 1)] = data[ragged(start, size - 1)]
    if len(start) < WINDOW:
        none = np.empty(0, np.int64)
        return packed, none, none, none, none, none, none.astype(np.uint64), n_words
    hashes = Rolling(packed)
    n = len(start)
    mini = mixed(hashes(to[: n - MINI + 1], to[MINI:]))
    least = _least(mini, WINDOW - MINI + 1)
    doc = np.repeat(np.arange(len(at) - 1), n_words)
    whole = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])  # windows within one text
    key, alone = least[whole], np.zeros(len(whole), dtype=bool)
    if len(heavy):
        alone = np.isin(key, heavy)
        w = whole[alone]
        key[alone] = mixed(hashes(to[w], to[w + WINDOW]), seed=1)
    new = np.ones(len(whole), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (whole[1:] != whole[:-1] + 1) | alone[1:] | (doc[whole[1:]] != doc[whole[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(whole)))
    word = whole[first]
    return packed, doc[word], word - word_at[:-1][doc[word]], count, to[word], to[word + count + WINDOW - 1] - to[word], key[first], n_words


def _distinct(packed: np.ndarray, order: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers to send, for each super-k-mer the one that stands for it (the earliest with its text), and its hash."""
    h = mixed(Rolling(packed)(begin, begin + size))
    by = np.lexsort((order, h))
    group = np.concatenate([[True], h[by][1:] != h[by][:-1]]) if len(by) else np.empty(0, bool)
    rep = np.empty(len(h), dtype=np.int64)
    rep[by] = by[group][np.cumsum(group) - 1] if len(by) else by
    other = np.flatnonzero(rep != np.arange(len(h)))
    same = size[other] == size[rep[other]]
    check = other[same]
    same[same] = _same_bytes(packed, begin[check], begin[rep[check]], size[check])
    rep[other[~same]] = other[~same]
    return np.flatnonzero(rep == np.arange(len(h))), rep, h


class _Common:
    """Super-k-mers that recur in a task's chunks, each with the earliest place met: kept hash -> [text, place, windows, key, sent].

    The second chunk that has one still sends it. From then on the later of two places is known to repeat the earlier, and
    the earliest, if it hasn't been sent, is when the task ends. One that finds no room is sent by each chunk.
    """

    def __init__(self) -> None:
        self.met, self.held = np.zeros(SLOTS, dtype=np.uint64), np.zeros(SLOTS, dtype=bool)
        self.kept: dict[int, list] = {}
        self.room = ROOM

    def fold(self, hashes: np.ndarray, of) -> tuple[np.ndarray, list[tuple]]:
        """Which of a chunk's super-k-mers to send, and the (id, text hash, first window, windows) now known to repeat earlier
        ones; of(q) tells the q-th one's text, place, windows and key."""
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        send, later = np.ones(len(hashes), dtype=bool), []
        for q in np.flatnonzero(self.met[slot] == hashes).tolist():
            text, place, windows, key = of(q)
            own = self.kept.get(int(hashes[q]))
            if own is None:
                cost = len(text) + 400
                if cost <= self.room:
                    self.room -= cost
                    self.kept[int(hashes[q])] = [text, place, windows, key, True]
                    self.held[slot[q]] = True
            elif own[0] == text:
                send[q] = False
                if place > own[1]:
                    later.append((*place, windows))
                elif place < own[1]:
                    if not own[4]:
                        later.append((*own[1], windows))
                    own[1], own[4] = place, False
        free = ~self.held[slot]
        self.met[slot[free]] = hashes[free]
        return send, later

    def unsent(self) -> list[list]:
        return [x for x in self.kept.values() if not x[4]]


def _pack(arrays: list[np.ndarray], raw: np.ndarray | bytes) -> bytes:
    return len(arrays[0]).to_bytes(8, "little") + b"".join(np.ascontiguousarray(a, dtype="<i8").tobytes() for a in arrays) + bytes(raw)


def _unpack(blob: bytes) -> tuple[np.ndarray, bytes]:
    n = int.from_bytes(blob[:8], "little")
    return np.frombuffer(blob, dtype="<i8", count=5 * n, offset=8).reshape(5, n), blob[8 + 40 * n :]


def _chunks(batches: Iterator[pa.RecordBatch], heavy: np.ndarray):
    """Per chunk: what super_kmers() gives, ids, text hashes, the super-k-mers to send, the stand-ins and the hashes of all."""
    for part in slices(batches, "t", CHUNK):
        ids, h = part.column("i").to_numpy(zero_copy_only=False), part.column("h").to_numpy(zero_copy_only=False)
        packed, doc, first, count, begin, size, key, _ = super_kmers(*utf8(part.column("t")), heavy)
        rank = np.empty(len(ids), dtype=np.int64)
        by = np.lexsort((h, ids))
        new = np.concatenate([[False], (ids[by][1:] != ids[by][:-1]) | (h[by][1:] != h[by][:-1])])
        rank[by] = np.cumsum(new)  # repeated rows are one document
        yield packed, doc, first, count, begin, size, key, ids, h, rank, *_distinct(packed, (rank[doc] << 32) | first, begin, size)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Minimisers frequent in a chunk, with their counts; key 0 carries the number of all super-k-mers."""
    for *_, key, _, _, _, send, _, _ in _chunks(batches, np.empty(0, np.uint64)):
        value, n = np.unique(key[send], return_counts=True)
        often = n > len(send) / (2 * HEAVY)
        often &= n > 4
        out = np.append(value[often], np.uint64(0)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(np.append(n[often], len(send)).astype(np.int64))], names=["key", "n"])


def _deal(heavy: np.ndarray, buckets: int):
    """Documents to rows (bucket, kind, blob): kind 0 super-k-mers, kind 1 places already known to repeat earlier ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=6)

        def rows(kind: int, route: np.ndarray, columns: list[np.ndarray], raw=None) -> Iterator[tuple[int, int, bytes]]:
            """A blob for each bucket; raw(own) is the bytes of the super-k-mers numbered own."""
            bucket = (route % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            for own in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(by) else []:
                yield int(bucket[own[0]]), kind, press.compress(_pack([c[own] for c in columns], raw(own) if raw else b""))

        def batch(found: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
            if found:
                b, k, blob = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(blob, pa.binary())], names=["bucket", "kind", "blob"])

        def known(places: list[tuple]) -> Iterator[tuple[int, int, bytes]]:
            if places:
                i, th, s, n = np.array(places, dtype=np.int64).T
                yield from rows(1, mixed(th.view(np.uint64), seed=2), [i, th, s, n, np.zeros_like(n)])

        common = _Common()
        for packed, doc, first, count, begin, size, key, ids, h, rank, send, rep, hashes in _chunks(batches, heavy):

            def of(q: int) -> tuple[bytes, tuple[int, int, int], int, int]:
                j = send[q]
                return packed[begin[j] : begin[j] + size[j]].tobytes(), (int(ids[doc[j]]), int(h[doc[j]]), int(first[j])), int(count[j]), int(key[j])

            again = np.flatnonzero(rep != np.arange(len(rep)))
            again = again[(rank[doc[again]] != rank[doc[rep[again]]]) | (first[again] != first[rep[again]])]
            go, later = common.fold(hashes[send], of)
            send = send[go]
            table = lambda own: [ids[doc[own]], h[doc[own]], first[own], count[own], size[own]]
            yield from batch([
                *rows(0, mixed(key[send]), table(send), lambda own: packed[ragged(begin[send[own]], size[send[own]])]),
                *rows(1, mixed(h[doc[again]].view(np.uint64), seed=2), table(again)),
                *known(later),
            ])
        left = common.unsent()
        if left:
            text = [x[0] for x in left]
            i, th, s = np.array([x[1] for x in left], dtype=np.int64).T
            columns = [i, th, s, np.array([x[2] for x in left], dtype=np.int64), np.array([len(t) for t in text], dtype=np.int64)]
            route = mixed(np.array([x[3] for x in left], dtype=np.uint64))
            yield from batch(list(rows(0, route, columns, lambda own: np.frombuffer(b"".join(text[q] for q in own), dtype=np.uint8))))

    return run


def _places(ids: np.ndarray, h: np.ndarray, first: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (ids, h, first, count)], names=["i", "h", "s", "n"])


def repeats(table: np.ndarray, text: bytes) -> tuple[np.ndarray, ...]:
    """Of a bucket's super-k-mers, (ids, text hashes, first windows, counts) of the windows that also start earlier."""
    ids, h, first, count, size = table
    data = np.frombuffer(text, dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum(size)])
    space = np.flatnonzero(data == 0x20)
    word = np.concatenate([[0], space + 1])  # every word has one space after it
    word_at = np.searchsorted(word, at[:-1])
    run = np.repeat(np.arange(len(ids)), count)
    w = ragged(word_at, count)
    step = w - word_at[run]
    begin, length = word[w], word[w + WINDOW] - word[w]
    key = mixed(Rolling(data)(begin, begin + length))
    order = np.argsort(key)
    twin = np.zeros(len(key), dtype=bool)
    same = key[order][1:] == key[order][:-1]
    twin[order[1:][same]] = twin[order[:-1][same]] = True
    c = np.flatnonzero(twin)
    if not len(c):
        return ids[:0], ids[:0], ids[:0], ids[:0]
    place = (ids[run[c]], h[run[c]], first[run[c]] + step[c])
    by = np.lexsort((place[2], place[1], place[0], key[c]))
    c, place = c[by], [p[by] for p in place]
    head = np.concatenate([[True], key[c][1:] != key[c][:-1]])
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    equal = length[c] == length[c[lead]]
    e = np.flatnonzero(equal)
    equal[e] = _same_bytes(data, begin[c[e]], begin[c[lead[e]]], length[c[e]])
    if not equal.all():  # different windows under one hash: the earliest place of each by its text
        for g in np.unique(lead[~equal]):
            seen: dict[bytes, int] = {}
            for q in np.flatnonzero(lead == g).tolist():
                lead[q] = seen.setdefault(text[begin[c[q]] : begin[c[q]] + length[c[q]]], q)
    later = (place[0] != place[0][lead]) | (place[1] != place[1][lead]) | (place[2] != place[2][lead])
    i, hh, s = (p[later] for p in place)
    by = np.lexsort((s, hh, i))
    i, hh, s = i[by], hh[by], s[by]
    new = np.concatenate([[True], (i[1:] != i[:-1]) | (hh[1:] != hh[:-1]) | (s[1:] > s[:-1] + 1)]) if len(i) else np.empty(0, bool)
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(i)) - 1
    return i[start], hh[start], s[start], s[last] - s[start] + 1 if len(i) else s


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, to places (id, text hash, first window, windows) that repeat earlier ones."""
    import zstandard

    unpress = zstandard.ZstdDecompressor()
    held: list[tuple[np.ndarray, bytes]] = []
    now = None

    def bucket() -> Iterator[pa.RecordBatch]:
        if held:
            yield _places(*repeats(np.concatenate([t for t, _ in held], axis=1), b"".join(x for _, x in held)))
            held.clear()

    for batch in batches:
        for b, kind, blob in zip(*(batch.column(c) for c in range(3))):
            table, text = _unpack(unpress.decompress(blob.as_py()))
            if kind.as_py() == 1:
                yield _places(*table[:4])
                continue
            if b.as_py() != now:
                yield from bucket()
                now = b.as_py()
            held.append((table, text))
    yield from bucket()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, i, h, t): i and h name a document. The text's hash h is only needed where an id occurs twice; else it is 0."""
    i = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NULL_ID))
    twice = docs.groupBy(i.alias("i")).count().where("count > 1").limit(1).count()
    h = F.xxhash64(text_col) if twice else F.lit(0).cast("bigint")
    return docs.select(F.col(id_col).alias("id"), i.alias("i"), h.alias("h"), F.col(text_col).alias("t"))


def repeated_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(i, h, s, n): windows s..s+n-1 of the document that _keyed() names i, h start earlier too. Ids are whole numbers."""
    spark = docs.sparkSession
    rows = _keyed(docs, id_col, text_col).select("i", "h", "t")
    counts = checkpoint(rows.mapInArrow(_frequent, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")))
    total = counts.where("key = 0").agg(F.sum("n")).first()[0] or 0
    # each kept key has over total / HEAVY super-k-mers, so at most HEAVY keys come to the driver
    heavy = np.array(sorted(r[0] for r in counts.where(F.col("n") > max(total / HEAVY, 8)).where("key <> 0").select("key").collect()), dtype=np.int64).view(np.uint64)
    n = partitions(spark)
    dealt = rows.mapInArrow(_deal(heavy, BUCKETS * n), "bucket int, kind int, blob binary")
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_compare, "i bigint, h bigint, s bigint, n bigint")


def kept_words(text: str | None, places: list[tuple[int, int]]) -> tuple[int, list[bytes]]:
    """The number of words of a text, and those that no place's windows cover."""
    words = (text or "").encode().split()
    if not places:
        return len(words), words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    s, n = np.array(places, dtype=np.int64).T
    np.add.at(edge, s, 1)
    np.add.at(edge, s + n - 1 + WINDOW, -1)
    return len(words), [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row of docs: id, n_words, n_removed, kept_sha256 (and kept, the kept words joined by single spaces).

    A null or empty text has no words; a text of fewer than WINDOW words loses none. Documents are ordered by id (null
    first), then by text hash; rows equal in both are one document and all get its result. An empty table gives none.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    places = repeated_places(docs, id_col, text_col).groupBy("i", "h").agg(F.collect_list(F.struct("s", "n")).alias("places"))
    rows = _keyed(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            n, kept, gone = [], [], []
            for t, p in zip(part.column("t").to_pylist(), part.column("places").to_pylist()):
                total, words = kept_words(t, [(x["s"], x["n"]) for x in p or []])
                n.append(total)
                gone.append(total - len(words))
                kept.append(b" ".join(words))
            out = [part.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                out, names = [*out, pa.array([k.decode() for k in kept])], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept string" if with_text else "")
    return rows.join(places, ["i", "h"], "left").select("id", "t", "places").mapInArrow(run, schema).withColumnRenamed("id", id_col)
