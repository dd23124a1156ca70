"""Language-model scores of texts: a word-count base over the whole corpus and an attention model on subwords.

Texts are dealt to blocks. A block asks for the corpus counts of its distinct words, packed by word shard; the shards add
up what all blocks hold and answer in the order asked, so only distinct words travel. A causal attention model gives, in
the context of a window, the class of a word's first subword; the word's probability is that of the class times its
discounted share of the training words whose first subword is of the class. What the discount takes goes to new words of
the class, by the spelling the attention model gives them. A spelling ends where the model expects a word to begin, and
so the words' probabilities add up to one. The model starts from a bounded sample and is then trained further in
every block, on all windows of every training text; the blocks' weights are averaged. Blocks are bounded in bytes,
so that their number grows with the texts. Subword counts of all training texts give the shares within classes. Held-out
texts give counts to nothing. Words are told apart by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention
from ._text import checkpoint, crc_mod, distinct, mixed, partitions, ragged, range_hashes, utf8, word_spans

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's own way to cut text before merging (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FOLDS, HELD_OUT = 5, 1
CLASSES = 512
#: Taken off every word's count.
DISCOUNT = 0.75
#: Text bytes of the sample the starting model is fitted on, and the most subwords that one of its texts gives; its steps.
START_BYTES, START_IDS, START_STEPS = 2 << 20, 1 << 18, 800
#: A block's least number of steps (one too small to fill them goes over its windows again), and how many turns every training text's windows are dealt to, of which a run uses one: with 1, all windows.
BLOCK_STEPS, TURNS = 30, 1
#: Text bytes of a block, on average at most.
BLOCK_BYTES = 16 << 20
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Rows a task adds up to one, and those that the driver adds up.
_FAN_IN = 16
#: Windows laid out at once, and scored at once: what a batch works on should stay in a core's cache.
_LAID_OUT, _BATCH = 512, 160


def _ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased data, start and end of each distinct word (in order of hash), each word's number, words' texts, counts per text."""
    data, at = utf8(texts)
    data = _LOWER[data]
    start, end, word_at = word_spans(data, at)
    first, number = distinct(data, start, end - start)
    n = np.diff(word_at)
    return data, start[first], end[first], number, np.repeat(np.arange(len(at) - 1), n), n


def _subwords(data: np.ndarray, start: np.ndarray, end: np.ndarray, encoding) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each distinct word with a space before it, and offsets."""
    if not len(start):
        return np.empty(0, np.int64), np.zeros(1, np.int64)
    size = end - start + 1
    to = np.cumsum(size) - size
    joined = np.full(int(size.sum()), 0x20, dtype=np.uint8)
    joined[ragged(to + 1, size - 1)] = data[ragged(start, size - 1)]
    ids = np.array(encoding[0].encode_ordinary(joined.tobytes().decode()), dtype=np.int64)
    return ids, np.append(np.flatnonzero(encoding[1][ids]), len(ids))  # an id that starts with a space starts a word


def _encoding(ranks: dict[bytes, int]):
    import tiktoken

    begins = np.zeros(max(ranks.values()) + 2, dtype=bool)
    for token, i in ranks.items():
        begins[i] = token[:1] == b" "
    return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), begins


def _sequences(number: np.ndarray, doc: np.ndarray, texts: int, ids: np.ndarray, id_at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's subword ids with an end id, and offsets."""
    count = np.diff(id_at)[number]
    per = np.bincount(doc, count, texts).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(per + 1)])
    out = np.full(int(at[-1]), end_id, dtype=np.int64)
    keep = np.ones(len(out), dtype=bool)
    keep[at[1:] - 1] = False
    out[keep] = ids[ragged(id_at[:-1][number], count)]
    return out, at


def _press(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpress(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob)


def _shards(data: np.ndarray, start: np.ndarray, end: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words in shard order, and where each shard begins among them."""
    h = mixed(range_hashes(data, start, end - start), seed=9)
    shard = (h % np.uint64(shards)).astype(np.int64)
    by = np.argsort(shard, kind="stable")
    return by, np.searchsorted(shard[by], np.arange(shards + 1))


def _one(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column


def _ask(ranks, classes: np.ndarray, model: np.ndarray, end_id: int, shards: int):
    """A block's texts to rows (block, kind, at, blob): kind 0 words asked of shard `at`, 1 subword counts and weights."""
    encoder: list = []  # kept between a task's blocks

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        table = table.sort_by("o")
        train = _one(table, "train").to_numpy(zero_copy_only=False)
        data, start, end, number, doc, _ = _words(_one(table, "t"))
        used = np.bincount(number[train[doc]], minlength=len(start))
        encoder[:] = encoder or [_encoding(ranks.value)]
        ids, id_at = _subwords(data, start, end, encoder[0])
        first = classes[ids[id_at[:-1]]]
        by, cuts = _shards(data, start, end, shards)
        kind, place, blob = [], [], []
        for s in range(shards):
            own = by[cuts[s] : cuts[s + 1]]
            if len(own):
                size = end[own] - start[own]
                kind.append(0)
                place.append(s)
                blob.append(_press(np.array([len(own)], "<i8"), size.astype("<i4"), used[own].astype("<i8"), first[own].astype("<i2"), data[ragged(start[own], size)]))
        count = np.bincount(ids, np.repeat(used, np.diff(id_at)), end_id + 1)
        count[end_id] = train.sum()
        seq, at = _sequences(number, doc, len(train), ids, id_at, end_id)
        keep = np.flatnonzero(train)
        size = np.diff(at)[keep]
        cls, cat = classes[seq[ragged(at[:-1][keep], size)]], np.concatenate([[0], np.cumsum(size)])
        tok, target, scored = attention.windows(cls, cat, int(classes[end_id]), TURNS)
        steps = max(BLOCK_STEPS, -(-len(tok) // attention.BATCH))
        fitted = attention.flat(attention.fit(attention.unflat(model, CLASSES), tok, target, scored | (target > 0), steps, 2e-3, seed=block)) if len(tok) else model[:0]
        kind, place = [*kind, 1], [*place, len(fitted)]
        blob.append(_press(count.astype("<i8"), fitted.astype("<f4")))
        n = len(kind)
        return pa.table([pa.array([block] * n, pa.int32()), pa.array(kind, pa.int32()), pa.array(place, pa.int32()), pa.array(blob, pa.binary())], names=["block", "kind", "at", "blob"])

    return run


def _sums(ids: int):
    """Rows of kind 1 to one row per partition: sums of the subword counts and of the weights, and of how many weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpacked() -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
            for batch in batches:
                for size, blob in zip(batch.column("at").to_pylist(), batch.column("blob").to_pylist()):
                    raw = _unpress(blob)
                    yield np.frombuffer(raw, "<i8", ids), np.frombuffer(raw, "<f4", size, 8 * ids).astype(np.float64), int(size > 0)

        yield from _summed(unpacked())

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sums to one."""
    yield from _summed((np.frombuffer(c, np.int64), np.frombuffer(w), n) for batch in batches for c, w, n in zip(*(x.to_pylist() for x in batch.columns)))


def _summed(rows: Iterator[tuple[np.ndarray, np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
    count, weights, n = None, np.zeros(0), 0
    for c, w, k in rows:
        count = c.copy() if count is None else count + c
        if k:
            weights, n = (weights + w if n else w), n + k
    if count is not None:
        yield pa.RecordBatch.from_arrays([pa.array([count.tobytes()], pa.binary()), pa.array([weights.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["count", "weights", "n"])


def _add_up(table: pa.Table) -> pa.Table:
    """A shard's questions to rows (block, at, blob, n, v): the corpus counts of the words in the order asked. n, of the
    shard's training tokens, and v, of its distinct training words by class, stand in the first row."""
    blocks, shard = table.column("block").to_pylist(), table.column("at")[0].as_py()
    sizes, used, kinds, texts = [], [], [], []
    for blob in table.column("blob").to_pylist():
        raw = _unpress(blob)
        n = int.from_bytes(raw[:8], "little")
        sizes.append(np.frombuffer(raw, "<i4", n, 8))
        used.append(np.frombuffer(raw, "<i8", n, 8 + 4 * n))
        kinds.append(np.frombuffer(raw, "<i2", n, 8 + 12 * n))
        texts.append(raw[8 + 14 * n :])
    size, use, kind = np.concatenate(sizes).astype(np.int64), np.concatenate(used), np.concatenate(kinds)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    first, number = distinct(data, np.cumsum(size) - size, size)
    total = np.bincount(number, use).astype(np.int64)
    answer, ends = total[number], np.concatenate([[0], np.cumsum([len(s) for s in sizes])])
    out = [_press(answer[a:b].astype("<i8")) for a, b in zip(ends, ends[1:])]
    n, v = [0] * len(out), [None] * len(out)
    n[0], v[0] = int(total.sum()), np.bincount(kind[first], total > 0, CLASSES).astype("<i8").tobytes()
    return pa.table([pa.array(blocks, pa.int32()), pa.array([shard] * len(out), pa.int32()), pa.array(out, pa.binary()), pa.array(n, pa.int64()), pa.array(v, pa.binary())], names=["block", "at", "blob", "n", "v"])


def _class_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (n, v) of shards to sums of n and, as a row per class, of v."""
    total, by_class = 0, np.zeros(CLASSES, dtype=np.int64)
    for batch in batches:
        total += sum(batch.column(0).to_pylist())
        for v in batch.column(1).to_pylist():
            if v is not None:
                by_class += np.frombuffer(v, "<i8")
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, CLASSES), pa.int32()), pa.array(np.append(total, by_class), pa.int64())], names=["class", "n"])


def _score(ranks, classes: np.ndarray, model: np.ndarray, share: np.ndarray, end_id: int, end_count: int, of_class: tuple[np.ndarray, np.ndarray], shards: int):
    """A block's texts and its answers to rows (id, n_tokens, n_known, base, score)."""

    encoder: list = []  # kept between a task's blocks

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], f.type) for f in [table.schema.field("id")]] + [pa.array([], t) for t in (pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=["id", "held_out", "n_tokens", "n_known", "base", "score"])
        data, start, end, number, _, n_words = _words(_one(table, "t"))
        number = number.astype(np.int32)
        by, cuts = _shards(data, start, end, shards)
        count = np.zeros(len(start), dtype=np.int64)
        for s, blob in zip(answers.column("at").to_pylist(), answers.column("blob").to_pylist()):
            count[by[cuts[s] : cuts[s + 1]]] = np.frombuffer(_unpress(blob), "<i8")
        texts = table.num_rows
        encoder[:] = encoder or [_encoding(ranks.value)]
        ids, id_at = _subwords(data, start, end, encoder[0])
        del data, start, end, by
        pieces, known_word, weight = np.diff(id_at), count > 0, np.log10(count + 0.5)
        base, known, score = np.zeros(texts), np.zeros(texts, np.int64), np.zeros(texts)
        p = attention.unflat(model, CLASSES)
        word_at = np.concatenate([[0], np.cumsum(n_words)])
        long = np.concatenate([[0], np.cumsum(pieces[number], dtype=np.int64)])[word_at[1:]] + np.arange(1, texts + 1)
        group = long // (_LAID_OUT * attention.STRIDE)
        cut = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [texts]])
        for a, b in zip(cut, cut[1:]):  # texts by turns, so that what is worked on stays small
            own, words = number[word_at[a] : word_at[b]], n_words[a:b]
            doc = np.repeat(np.arange(b - a), words)
            base[a:b] = np.bincount(doc, weight[own], b - a) + np.log10(end_count + 0.5)
            known[a:b] = np.bincount(doc, known_word[own], b - a).astype(np.int64) + int(end_count > 0)
            seq, at = _sequences(own, doc, b - a, ids, id_at, end_id)
            cls = classes[seq]
            own_class, begins, lo = np.zeros(len(seq)), np.zeros(len(seq)), 0
            tok, target, scored = attention.windows(cls, at, int(classes[end_id]))
            for i in range(0, len(tok), _BATCH):
                each, start_ = attention.log_likelihood(p, tok[i : i + _BATCH], target[i : i + _BATCH], scored[i : i + _BATCH])
                own_class[lo : lo + len(each)] = each
                begins[lo : lo + len(each)] = start_
                lo += len(each)
            # words and ends, in order: a spelling from its first subword to before the next one's
            size = np.ones(len(own) + b - a, dtype=np.int64)
            is_word = np.ones(len(size), dtype=bool)
            is_word[np.cumsum(words + 1) - 1] = False
            size[is_word] = pieces[own]
            first = np.cumsum(size) - size
            lead = own_class[first] - begins[first]  # the first subword's class, given that a word begins
            spelled = np.add.reduceat(own_class + share[seq], first) - own_class[first]  # the rest, given that class
            spelled[is_word] += begins[(first + size)[is_word]]
            c = np.full(len(size), float(end_count))
            c[is_word] = count[own]
            n, v = of_class[0][cls[first]], of_class[1][cls[first]]
            with np.errstate(divide="ignore"):  # an unseen word has its spelling alone, and so has every word of a class without any
                counted = np.log(np.maximum(c - DISCOUNT, 0) / np.maximum(n, 1))
                left = np.log(np.where(n > 0, DISCOUNT * v / np.maximum(n, 1), 1))
            each = (lead + np.logaddexp(counted, left + spelled)) / np.log(10)
            score[a:b] = np.bincount(np.repeat(np.arange(b - a), words + 1), each, b - a)
        held = ~_one(table, "train").to_numpy(zero_copy_only=False)
        return pa.table([_one(table, "id"), pa.array(held), pa.array(n_words + 1), pa.array(known), pa.array(base), pa.array(score)], names=["id", "held_out", "n_tokens", "n_known", "base", "score"])

    return run


def _sampled(ranks, end_id: int):
    """Texts to their subword ids with an end id; of more than START_IDS, evenly spread stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = None
        for batch in batches:
            for i in range(batch.num_rows):
                encoding = encoding or _encoding(ranks.value)
                data, start, end, number, doc, _ = _words(batch.column(0).slice(i, 1))
                seq, _ = _sequences(number, doc, 1, *_subwords(data, start, end, encoding), end_id)
                if len(seq) > START_IDS:
                    wide = 8 * attention.LENGTH
                    starts = np.linspace(0, len(seq) - wide, START_IDS // wide).astype(np.int64)
                    seq = seq[(starts[:, None] + np.arange(wide)).ravel()]
                yield pa.RecordBatch.from_arrays([pa.array([seq.astype("<i4").tobytes()], pa.binary()), batch.column(1).slice(i, 1)], names=["ids", "o"])

    return run


def _start(texts: list[bytes], ranks: dict[bytes, int], end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of every id, and the weights of a first model, from texts as ids. Ids that begin a word and ids that go on
    have classes in different groups; frequent ids have their own, the rest of either kind share one."""
    each = [np.frombuffer(t, "<i4").astype(np.int64) for t in texts]
    seq, at = np.concatenate([np.empty(0, np.int64), *each]), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    count = np.bincount(seq, minlength=end_id + 1)
    count[end_id] = count.max() + 1
    order = np.argsort(-count, kind="stable")
    begins = np.zeros(end_id + 1, dtype=bool)
    begins[[i for token, i in ranks.items() if token[:1] == b" "]] = True
    begins[end_id] = True
    classes = np.zeros(end_id + 1, dtype=np.int64)
    for kind, low, wide in ((True, 0, attention.START), (False, attention.START, attention.GROUPS - attention.START)):
        own = order[begins[order] == kind]
        k = np.minimum(np.arange(len(own)), wide * (CLASSES // attention.GROUPS) - 1)
        classes[own] = k // wide * attention.GROUPS + low + k % wide
    cls = classes[seq]
    p = attention.fresh(np.bincount(cls, minlength=CLASSES).astype(np.float64))
    tok, target, scored = attention.windows(cls, at, int(classes[end_id]))
    return classes, attention.flat(attention.fit(p, tok, target, scored, START_STEPS, 1e-2))


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    A null or empty text is its end alone. A null id's fold is that of the empty text; repeated rows count as often as
    they stand. Without training texts every count is zero. An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    shards = max(n // 2, 1)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), (crc_mod(id_col, FOLDS) != HELD_OUT).alias("train"), F.col(text_col).alias("t"), F.xxhash64(id_col, text_col).alias("o"))
    measured = rows.groupBy("train").agg(F.sum(F.octet_length("t").cast("long")).alias("n")).collect()
    blocks = max(2 * n, -(-sum(r.n or 0 for r in measured) // BLOCK_BYTES))
    rows = rows.withColumn("block", F.pmod("o", F.lit(blocks)).cast("int"))
    ranks_here = _ranks(vocabulary)
    ranks, end_id = spark.sparkContext.broadcast(ranks_here), max(ranks_here.values()) + 1
    # a text is in the sample by its hash, so that START_BYTES are expected of a corpus of any size
    share = min(1.0, START_BYTES / max(1, sum(r.n or 0 for r in measured if r.train)))
    chosen = rows.where(F.col("train") & (F.pmod(F.hash("o"), F.lit(1 << 24)) < int(share * (1 << 24)) + 1)).select("t", "o")
    sample = chosen.mapInArrow(_sampled(ranks, end_id), "ids binary, o bigint").collect()
    classes, model = _start([r.ids for r in sorted(sample, key=lambda r: (r.o, r.ids))], ranks_here, end_id)
    asked = checkpoint(rows.groupBy("block").applyInArrow(_ask(ranks, classes, model, end_id, shards), "block int, kind int, at int, blob binary"))
    answered = checkpoint(asked.where("kind = 0").select("block", "at", "blob").groupBy("at").applyInArrow(_add_up, "block int, at int, blob binary, n bigint, v binary"))
    sums, parts = asked.where("kind = 1").select("at", "blob").mapInArrow(_sums(end_id + 1), "count binary, weights binary, n bigint"), asked.rdd.getNumPartitions()
    while parts > _FAN_IN:
        parts = -(-parts // _FAN_IN)
        sums = sums.repartition(parts).mapInArrow(_merge, "count binary, weights binary, n bigint")
    sums = sums.collect()
    subword = sum((np.frombuffer(r["count"], np.int64) for r in sums), np.zeros(end_id + 1))
    fitted = [(np.frombuffer(r.weights), r.n) for r in sums if r.n]
    if fitted:
        model = (sum(w for w, _ in fitted) / sum(n for _, n in fitted)).astype(np.float32)
    in_class, members = np.bincount(classes, subword), np.bincount(classes)
    share = np.log((subword + 0.5) / (in_class[classes] + 0.5 * members[classes]))
    end_count = int(subword[end_id])
    known = {r["class"]: r.n for r in answered.select("n", "v").mapInArrow(_class_words, "class int, n bigint").groupBy("class").agg(F.sum("n").alias("n")).collect()}
    words = np.array([known.get(c, 0) for c in range(CLASSES)])
    words[classes[end_id]] += int(end_count > 0)
    total = (known.get(-1, 0) + end_count, int(words.sum()))
    # only ids that begin a word have these classes, so that a class's ids number its words
    of_class = (np.where(words > 0, in_class, 0).astype(np.float64), words.astype(np.float64))
    texts = rows.select("id", "train", "t", "block").groupBy("block").cogroup(answered.select("block", "at", "blob").groupBy("block"))
    out = texts.applyInArrow(_score(ranks, classes, model, share, end_id, end_count, of_class, shards), f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double")
    below = float(np.log10(total[0] + 0.5 * (total[1] + 1)))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total[0]).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * below).alias("base_score"), "score")
