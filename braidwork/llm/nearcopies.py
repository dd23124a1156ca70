"""Near copies by similarity: wide SimHash fingerprints, keys from pivot distances, exact verification.

Texts with equal words are one class. A class has a fingerprint of BITS bits over its distinct shingles. The distances
of a fingerprint to the reference without bits and to those of one bit tell each of its bits; tables of KEY_BITS such
distances, at places drawn once, are equi-join keys, as many as find a pair of just the asked similarity with the asked
probability; keys grow with the number of texts, and the tables with the keys, so that this holds at any size. Within a
bucket, pairs whose distances to scattered references differ by more than the radius in some coordinate are discarded, the
rest compared bit by bit. Of the close ones all are kept in a group of up to SMALL, in a larger one a minimum spanning
forest, which has the components of all close pairs at every distance; the pairs are verified by the Jaccard similarity of
their texts' shingles. Components of the verified pairs are the groups.

A bucket of over BUCKET_ROWS fingerprints is dealt out again SPLITS times, by SPLIT_BITS bits each; each of its rows is also
held against its first row. A bucket that is still as large is gone through in the order of the fingerprints, each row
against the first and the BUCKET_ROWS before it. All this only brings together quickly what belongs together. The texts of
such buckets, and those of groups of over SMALL, are left open: where the verified pairs don't make one group of them, they
are joined exactly (see across), by their rarest shingles, so that no pair of them with the asked similarity is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._graph import components, spanning
from ._text import _powers, checkpoint, mixed, partitions, ragged, slices

SHINGLE, SIMILARITY = 5, 0.8
#: Words of 64 bits of a fingerprint, bits of a table's key at least, and the chance with which a pair of SIMILARITY is to meet.
WIDTH, KEY_BITS, CHANCE = 4, 16, 0.99
BITS = 64 * WIDTH
BUCKET_ROWS, SPLITS, SPLIT_BITS = 2048, 3, 10
#: Texts of a bucket that chance alone puts there at most; texts of a group in a bucket of which all close pairs are kept.
CROWD, SMALL = 256, 16
#: Texts of a shingle's part.
PART_ROWS = 1024
#: References whose distances are compared before all bits are, and pairs compared or held at once.
REFERENCES = mixed(_powers(np.uint64(0x9E3779B97F4A7C15), 8 * WIDTH - 1)).reshape(8, WIDTH)
_PAIRS = 1 << 18
#: Rows of shingles handed to Spark at once.
_SENT = 1 << 15
_SUMMED = 32


def bit_distance(similarity: float) -> float:
    """Share of bits expected to differ between texts with as many shingles each and this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius(similarity: float) -> int:
    """Bits that pairs of this similarity differ in, with three standard deviations to spare."""
    p = bit_distance(similarity)
    return math.ceil(BITS * p + 3 * math.sqrt(BITS * p * (1 - p)))


def key_bits(texts: int) -> int:
    return max(KEY_BITS, math.ceil(math.log2(max(texts, 1) / CROWD)))


def tables(similarity: float, bits: int = KEY_BITS, chance: float = CHANCE) -> np.ndarray:
    """Places of the bits of every table's key."""
    n = math.ceil(math.log(1 - chance) / math.log(1 - (1 - bit_distance(similarity)) ** bits))
    r = np.random.default_rng(11)
    return np.stack([r.permutation(BITS)[:bits] for _ in range(n)])


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of every width consecutive words."""
    out = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        out = mixed(out, seed=k) + h[k : len(h) - width + 1 + k]
    return mixed(out)


def words(text: str | None) -> list[bytes]:
    """Words between white space, A-Z in lower case."""
    return (text or "").encode().lower().split()


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The text's distinct shingles as sorted 64-bit hashes; of a text with fewer words, its whole sequence."""
    own = words(text)
    return np.unique(_rolled(_hashed(own), min(width, len(own)))) if own else np.empty(0, np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def fingerprints(texts: list[str | None], width: int = SHINGLE) -> np.ndarray:
    """(texts, WIDTH) words of fingerprints over distinct shingles; a bit is set if over half of them have it."""
    split = [words(t) for t in texts]
    n = np.array([len(w) for w in split])
    h = _hashed([x for w in split for x in w])
    at = np.concatenate([[0], np.cumsum(n)])
    parts = [np.empty(0, np.uint64)]
    long = np.flatnonzero(n >= width)
    if len(long):
        rolled = _rolled(h, width)
        place = np.arange(len(rolled))
        doc = np.searchsorted(at, place, side="right") - 1
        whole = place + width <= at[doc + 1]
        parts.append((doc[whole].astype(np.uint64) << np.uint64(40)) | (rolled[whole] >> np.uint64(24)))
    for i in np.flatnonzero((n > 0) & (n < width)).tolist():
        parts.append((np.uint64(i) << np.uint64(40)) | (_rolled(h[at[i] : at[i + 1]], int(n[i])) >> np.uint64(24)))
    own = np.sort(np.concatenate(parts))  # 40 bits are enough to draw the bits of a fingerprint from
    own = own[np.append(True, own[1:] != own[:-1])] if len(own) else own
    doc = (own >> np.uint64(40)).astype(np.int64)
    count = np.bincount(doc, minlength=len(texts))
    rows = -(-count // _SUMMED)  # a text's shingles are summed in rows of _SUMMED, the last one filled up with zeros
    seed, live = np.zeros(int(rows.sum()) * _SUMMED, dtype=np.uint64), np.zeros(int(rows.sum()) * _SUMMED, dtype=bool)
    place = ragged((np.cumsum(rows) - rows) * _SUMMED, count)
    seed[place], live[place] = own & np.uint64((1 << 40) - 1), True
    row_doc = np.repeat(np.arange(len(texts)), rows)
    ones, step = np.zeros((len(texts), BITS), dtype=np.int64), 256
    for i in range(0, len(row_doc), step):
        x, on = seed[i * _SUMMED : (i + step) * _SUMMED], live[i * _SUMMED : (i + step) * _SUMMED]
        bits = np.stack([np.where(on, mixed(x, seed=101 + k), 0) for k in range(WIDTH)], axis=1).astype(">u8")
        some = np.unpackbits(bits.view(np.uint8), axis=1).reshape(-1, _SUMMED, BITS).sum(axis=1, dtype=np.uint8)
        d = row_doc[i : i + step]
        first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        ones[d[first]] += np.add.reduceat(some, first, axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > count[:, None], axis=1).view(">u8").astype(np.uint64)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of up to 64 bits as numbers."""
    out = np.zeros((*bits.shape[:-1], 64), dtype=np.uint8)
    out[..., 64 - bits.shape[-1] :] = bits
    return np.packbits(out, axis=-1).view(">u8")[..., 0].astype(np.uint64)


def keys(fp: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Per fingerprint and table its key.

    With w bits set, the distance to the reference without bits is w, that to a reference of one bit w - 1 or w + 1."""
    set_ = np.unpackbits(np.ascontiguousarray(fp.astype(">u8")).view(np.uint8).reshape(len(fp), -1), axis=1)[:, places]
    table = np.arange(1, len(places) + 1, dtype=np.uint64) << np.uint64(places.shape[1])
    return mixed(_packed(set_) | table)


#: Places of the bits by which large buckets are dealt again.
_AGAIN = np.stack([np.random.default_rng(17 + k).permutation(BITS)[:SPLIT_BITS] for k in range(SPLITS)])


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def forest(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Indices of the edges u-v, with weights w, of a minimum spanning forest of nodes 0 to n - 1."""
    order = np.argsort(w, kind="stable")
    u, v = u[order], v[order]
    component, live, out = np.arange(n), np.arange(len(u)), []
    while True:
        a, b = component[u[live]], component[v[live]]
        apart = a != b
        live, a, b = live[apart], a[apart], b[apart]
        if not len(live):
            return order[np.concatenate([np.empty(0, np.int64), *out])]
        best = np.full(n, len(u))
        np.minimum.at(best, a, live)
        np.minimum.at(best, b, live)
        chosen = np.unique(best[best < len(u)])
        out.append(chosen)
        node, least = spanning(component[u[chosen]], component[v[chosen]])
        to = np.arange(n)
        to[node] = least
        component = to[component]


def close_pairs(key: np.ndarray, fp: np.ndarray, most: int, reach: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (i, j) of the pairs with equal keys within `most` bits, of groups of over SMALL of a minimum spanning forest of them,
    and per row the least row of its group if that is over SMALL, else -1; rows are sorted by key. With reach, a row is held
    against its key's first one and the next `reach` only."""
    near = _distance(fp[:, None, :], REFERENCES[None, :, :])
    stops, starts = np.searchsorted(key, key, side="right"), np.searchsorted(key, key, side="left")
    u, v, w, held = [], [], [], 0
    large = np.full(len(key), -1)

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal u, v, w, held
        for a in range(0, len(i), _PAIRS):
            x, y = i[a : a + _PAIRS], j[a : a + _PAIRS]
            ok = np.abs(near[x] - near[y]).max(axis=1) <= most
            x, y = x[ok], y[ok]
            d = _distance(fp[x], fp[y])
            ok = d <= most
            u, v, w, held = [*u, x[ok]], [*v, y[ok]], [*w, d[ok]], held + int(ok.sum())
            if held > 4 * _PAIRS + SMALL * len(key):
                shrink()

    def shrink() -> None:
        nonlocal u, v, w, held, large
        a, b, c = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (u, v, w))
        keep = np.zeros(len(a), dtype=bool)
        keep[forest(len(key), a, b, c)] = True
        root = np.arange(len(key))
        if keep.any():
            node, least = spanning(a[keep], b[keep])
            root[node] = least
        size = np.bincount(root, minlength=len(key))
        keep |= size[root[a]] <= SMALL
        large = np.where(size[root] > SMALL, root, -1)
        u, v, w, held = [a[keep]], [b[keep]], [c[keep]], int(keep.sum())

    step, open_ = 1, np.flatnonzero(np.arange(len(key)) + 1 < stops)
    if reach:
        compare(starts[starts < np.arange(len(key))], np.flatnonzero(starts < np.arange(len(key))))
    while len(open_) and (not reach or step <= reach):
        compare(open_, open_ + step)
        step += 1
        open_ = open_[open_ + step < stops[open_]]
    shrink()
    return u[0], v[0], large


def buckets(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Rows sorted by their first column, as (False, rows of whole keys) or, of a key with over limit rows, (True, a part
    of its rows, the first part with over limit of them)."""
    held: list[pa.RecordBatch] = []
    hot, n, last = False, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(key[1:] != key[:-1]) + 1
        if n and key[0] != last:
            yield from _closed(held, hot)
            held, n, hot = [], 0, False
        cut = int(change[-1]) if len(change) else 0
        if cut:
            if hot:  # the open key's rest
                yield True, batch.slice(0, int(change[0]))
                held = [batch.slice(int(change[0]), cut - int(change[0]))]
            else:
                held.append(batch.slice(0, cut))
            yield from _closed([h for h in held if h.num_rows], False)
            held, n, hot = [], 0, False
        held.append(batch.slice(cut))
        n, last = n + batch.num_rows - cut, key[-1]
        if limit and n > limit:
            yield from _closed(held, True)
            held, hot = [], True
    yield from _closed(held, hot)


def _closed(held: list[pa.RecordBatch], hot: bool) -> Iterator[tuple[bool, pa.RecordBatch]]:
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield hot, table.to_batches()[0]


def _rows(kind: int, key: np.ndarray | None, nodes: tuple[pa.Array, pa.Array], fp: pa.Array | None) -> pa.RecordBatch:
    n = len(nodes[0])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(key.view(np.int64)) if key is not None else pa.nulls(n, pa.int64()), *nodes, fp if fp is not None else pa.nulls(n, pa.binary())], names=["kind", "key", "a", "b", "fp"]
    )


def _words_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u8").reshape(-1, WIDTH).astype(np.uint64)


def _meet(most: int, split: bool):
    """Rows (key, node, fp) sorted by key to rows of kind 0, a close pair (a, b), 1, a large bucket's row (a) under a finer
    key, once for each way to deal it again, or 2, a row (a) of a bucket or group, named by key, whose pairs were not all kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for hot, rows in buckets(batches, BUCKET_ROWS if split else None):
            key, fp, node = rows.column(0).to_numpy(zero_copy_only=False), _words_of(rows.column(2)), rows.column(1)
            if not hot:
                first = None
                again = np.zeros(len(key), bool)
                if split:
                    size = np.searchsorted(key, key, side="right") - np.searchsorted(key, key, side="left")
                    again = size > BUCKET_ROWS
                own = np.flatnonzero(~again)
                i, j, group = close_pairs(key[own], fp[own], most, None if split else BUCKET_ROWS)
                i, j = own[i], own[j]
                yield _rows(0, None, (node.take(pa.array(i)), node.take(pa.array(j))), None)
                part = np.flatnonzero(group >= 0)
                if split and len(part):  # large buckets are open as a whole
                    at = own[part]
                    yield _rows(2, mixed(key[at].view(np.uint64) ^ mixed(group[part].astype(np.uint64), seed=7)), (node.take(pa.array(at)), pa.nulls(len(at), node.type)), None)
                hot_rows = np.flatnonzero(again)
                lead = np.searchsorted(key, key[hot_rows], side="left")
            else:
                if first is None or first[0] != key[0]:
                    first = (key[0], fp[0], node.slice(0, 1))
                hot_rows, lead = np.arange(len(key)), None
            if len(hot_rows):
                yield _rows(2, mixed(key[hot_rows].view(np.uint64), seed=8), (node.take(pa.array(hot_rows)), pa.nulls(len(hot_rows), node.type)), None)
                finer = mixed(keys(fp[hot_rows], _AGAIN) ^ mixed(key[hot_rows].view(np.uint64))[:, None], seed=5)
                each = pa.array(np.repeat(hot_rows, SPLITS))
                yield _rows(1, finer.ravel(), (node.take(each), pa.nulls(len(each), node.type)), rows.column(2).take(each))
                head = fp[lead] if lead is not None else first[1][None, :]
                near = np.flatnonzero(_distance(fp[hot_rows], head) <= most)
                leads = node.take(pa.array(lead[near])) if lead is not None else first[2].take(pa.array(np.zeros(len(near), np.int64)))
                yield _rows(0, None, (leads, node.take(pa.array(hot_rows[near]))), None)

    return run


def candidates(nodes: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(u, v) distinct pairs of nodes (node, fp) that share a key and are close; of large groups forests of them, not all.
    And (label, node) of the buckets and groups whose pairs are not all among them."""
    kind, most = nodes.schema["node"].dataType.simpleString(), radius(similarity)
    places = tables(similarity, key_bits(nodes.count()))
    n = partitions(nodes.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                key = keys(_words_of(part.column(1)), places)
                row = pa.array(np.repeat(np.arange(part.num_rows), len(places)))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), part.column(0).take(row), part.column(1).take(row)], names=["key", "node", "fp"])

    out = f"kind int, key bigint, a {kind}, b {kind}, fp binary"
    sort = lambda df: df.repartition(n, "key").sortWithinPartitions("key", "fp")
    met = checkpoint(sort(nodes.select("node", "fp").mapInArrow(deal, f"key bigint, node {kind}, fp binary")).mapInArrow(_meet(most, True), out))
    large = met.where("kind = 1").select("key", F.col("a").alias("node"), "fp")
    pairs = met.where("kind = 0").select("a", "b").unionByName(sort(large).mapInArrow(_meet(most, False), out).select("a", "b"))
    pairs = pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    return pairs, met.where("kind = 2").select(F.col("key").alias("label"), F.col("a").alias("node"))


def still_open(labelled: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root) of the nodes of labels (label, node) that span several groups; roots (node, least) has those of over one node."""
    named = labelled.join(roots, "node", "left").select("label", "node", F.coalesce("least", "node").alias("root"))
    several = named.groupBy("label").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    return named.join(several, "label", "left_semi").select("node", "root").distinct()


def across(texts: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """(u, v) distinct pairs of texts (node, root, t) of different roots, among them all of at least this similarity.

    Two such texts share one of the size - ceil(similarity * size) + 1 shingles of each that come first in any one order;
    here the rarest do. A shingle of many texts is dealt to parts, each of which meets all others."""
    kind = texts.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            each = [shingles(t, width) for t in part.column("t").to_pylist()]
            row, g = np.repeat(np.arange(len(each)), [len(x) for x in each]), np.concatenate(each).view(np.int64)
            for i in range(0, len(g), _SENT):
                at = pa.array(row[i : i + _SENT])
                yield pa.RecordBatch.from_arrays([part.column("node").take(at), part.column("root").take(at), pa.array(g[i : i + _SENT])], names=["node", "root", "g"])

    rows = texts.select("node", "root", "t").mapInArrow(run, f"node {kind}, root {kind}, g bigint")
    held = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    own = Window.partitionBy("node")
    ranked = rows.join(held, "g").withColumn("place", F.row_number().over(own.orderBy("n", "g"))).withColumn("size", F.count("*").over(own))
    leading = ranked.where((F.col("place") <= F.col("size") - F.ceil(similarity * F.col("size") - 1e-6) + 1) & (F.col("lo") != F.col("hi")))
    leading = checkpoint(leading.select("g", "node", "root", "place", "size", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts")))
    left = leading.withColumn("part", F.pmod(F.hash("node"), "parts"))
    right = leading.select("g", *(F.col(c).alias(f"other_{c}") for c in ("node", "root", "place", "size")), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    sizes = F.col("size") + F.col("other_size")
    both = left.join(right, ["g", "part"]).where((F.col("node") > F.col("other_node")) & (F.col("root") != F.col("other_root")))
    # what can still be shared from the first shared shingle on
    rest = 1 + F.least(F.col("size") - F.col("place"), F.col("other_size") - F.col("other_place"))
    both = both.where((rest >= similarity / (1 + similarity) * sizes - 1e-6) & (F.least("size", "other_size") >= similarity * F.greatest("size", "other_size") - 1e-6))
    return both.select(F.col("node").alias("u"), F.col("other_node").alias("v")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """The pairs (u, v) whose texts (node, t) have at least this Jaccard similarity of distinct shingles."""
    kind = pairs.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            ok, last, own = [], None, None
            for a, b in zip(part.column("t").to_pylist(), part.column("other").to_pylist()):
                if own is None or a != last:
                    last, own = a, shingles(a, width)
                ok.append(jaccard(own, shingles(b, width)) >= similarity)
            yield part.select(["u", "v"]).filter(pa.array(ok))

    other = texts.select(F.col("node").alias("v"), F.col("t").alias("other"))
    both = pairs.join(other, "v").join(texts.withColumnRenamed("node", "u"), "u").select("u", "v", "t", "other")
    return both.mapInArrow(run, f"u {kind}, v {kind}")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """(id_col, component_id, __h, __least): each distinct id and text (by its hash) of docs with the least id of its group, and
    whether it is the first of it by id, then hash. Null ids are left out.

    Texts without words, null ones too, are equal. An empty table gives none."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            texts = part.column("t").to_pylist()
            same = [xxhash.xxh3_128_digest(b" ".join(words(t))) for t in texts]
            fp = np.ascontiguousarray(fingerprints(texts, width).astype(">u8"))
            yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(same, pa.binary()), pa.array([r.tobytes() for r in fp], pa.binary())], names=["i", "same", "fp"])

    # a text is named by its id and its hash, as an id may repeat with other texts
    name = f"struct<i:{kind},h:bigint>"
    rows = docs.where(F.col(id_col).isNotNull()).select(F.struct(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h")).alias("i"), F.col(text_col).alias("t"))
    member = checkpoint(rows.mapInArrow(run, f"i {name}, same binary, fp binary"))
    nodes = checkpoint(member.groupBy("same").agg(F.min("i").alias("node"), F.first("fp").alias("fp")))
    pairs, labelled = candidates(nodes, similarity)
    pairs = checkpoint(pairs)
    in_pair = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    texts = rows.withColumnRenamed("i", "node").join(in_pair, "node", "left_semi").groupBy("node").agg(F.min("t").alias("t"))
    links = checkpoint(verified(pairs, texts, similarity, width))
    roots = components(links).withColumnRenamed("root", "least")
    rest = checkpoint(still_open(labelled, roots))
    if not rest.isEmpty():
        texts = checkpoint(rows.withColumnRenamed("i", "node").join(rest, "node").groupBy("node", "root").agg(F.min("t").alias("t")))
        more = checkpoint(verified(across(texts, similarity, width), texts.select("node", "t"), similarity, width))
        if not more.isEmpty():
            roots = components(links.unionByName(more)).withColumnRenamed("root", "least")
    named = nodes.join(roots, "node", "left").select("same", F.coalesce("least", "node").alias("least"))
    return member.join(named, "same").select(F.col("i.i").alias(id_col), F.col("least.i").alias("component_id"), F.col("i.h").alias("__h"), (F.col("i") == F.col("least")).alias("__least")).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """The rows of docs that stand for their group, those with its least id, and of several texts of that id the first by hash.
    All columns stay.

    Rows with a null id stay (nothing tells them apart). Repeated rows stay or go together."""
    kept = groups(docs, id_col, text_col, similarity, width).where("__least").select(F.struct(F.col(id_col).alias("i"), F.col("__h").alias("h")).alias("__kept"))
    named = F.struct(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"))
    return docs.join(kept, named == F.col("__kept"), "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
