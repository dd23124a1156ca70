"""SentencePiece encoding and decoding over a public vocabulary, by suffix-array matching.

A chunk's texts are cut into segments no piece reaches across, and the distinct segments are concatenated. A suffix
array of that text gives, by binary search, the range of occurrences of every piece at once. The occurrences are edges;
sorted by the position where they end, they are relaxed in that order: the edge kept at a position is the longest whose
piece may follow the piece kept at its start. For a byte-pair vocabulary "may follow" means that no merge across the
boundary comes before the merges that made the two pieces, which makes the kept path the one that greedy merging finds
(checked against the library in tests). Characters outside the vocabulary fall back to bytes, or to <unk>.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import distinct, ragged, slices, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Text bytes whose distinct segments are found together, and bytes matched at once.
CHUNK, PART = 4 << 20, 1 << 19
#: Bytes of a long segment's lanes.
LANE = 256
_NONE = np.int64(1 << 40)


def _merged(word: str, rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Greedy merging of one word, best rank and then leftmost first; and the last merge made."""
    parts, last = list(word), None
    while len(parts) > 1:
        best = min((rank.get(a + b, _NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best[0] == _NONE:
            break
        i = best[1]
        last = (parts[i], parts[i + 1])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts, last


def load(path: str = MODEL) -> dict[str, np.ndarray | bool]:
    """The vocabulary as plain arrays. Reads a byte-pair model with a dummy prefix and no other normalisation."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    text = {i: sp.id_to_piece(i).replace("▁", " ") for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))}
    order = sorted(text, key=lambda i: (-sp.get_score(i), i))
    rank_of = {text[i]: r for r, i in enumerate(order)}
    id_of = {text[i]: i for i in order}
    left, right, kept = np.full(n, -1), np.full(n, -1), []
    for i in order:
        parts, last = _merged(text[i], rank_of)
        if len(parts) == 1:
            kept.append(i)
            if last:
                left[i], right[i] = id_of[last[0]], id_of[last[1]]
    rank = np.full(n, -1)
    rank[kept] = [rank_of[text[i]] for i in kept]
    pairs = sorted((id_of[w[:k]] << 32 | id_of[w[k:]], rank_of[w]) for w in (text[i] for i in order) for k in range(1, len(w)) if w[:k] in id_of and w[k:] in id_of)
    byte = np.full(256, sp.unk_id())
    for i in range(n):
        if sp.is_byte(i):
            byte[int(sp.id_to_piece(i)[1:-1], 16)] = i
    raw = [text[i].encode() if i in text else bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else b"" for i in range(n)]
    raw[sp.unk_id()] = " ⁇ ".encode()
    single = {w for w in id_of if len(w) == 1}
    return {
        "match": np.array(kept), "rank": rank, "left": left, "right": right,
        "pair": np.array([p for p, _ in pairs], dtype=np.int64), "pair_rank": np.array([r for _, r in pairs], dtype=np.int64),
        "byte": byte, "fallback": bool((byte != sp.unk_id()).all()), "unk": np.array(sp.unk_id()),
        "raw": np.frombuffer(b"".join(raw), dtype=np.uint8), "raw_at": np.cumsum([0, *map(len, raw)]),
        "apart": all(" " not in w.lstrip(" ") for w in id_of), "line": all("\n" not in w for w in id_of), "whole": all(set(w) <= single for w in id_of),
    }


def segments(data: np.ndarray, at: np.ndarray, v: dict) -> np.ndarray:
    """Start offsets of segments: at texts, before runs of spaces, and around line ends, where no piece reaches across."""
    cut = np.zeros(len(data) + 1, dtype=bool)
    if v["apart"]:
        space = data == 0x20
        cut[1:-1] = space[1:] & ~space[:-1]
    if v["line"]:
        nl = np.flatnonzero(data == 0x0A)
        cut[nl] = cut[nl + 1] = True
    cut[at] = True
    cut[-1] = False
    return np.flatnonzero(cut)


def _words(data: np.ndarray, extra: int = 64) -> np.ndarray:
    """The eight bytes from each position on as a big-endian number, zeros after the end."""
    d = np.concatenate([data, np.zeros(extra + 8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data) + extra, dtype=np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | d[k : k + len(out)]
    return out


def suffix_array(words: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Positions 0..n-1 in the order of the suffixes there, to at least depth bytes, by prefix doubling."""
    order = np.argsort(words[:n]).astype(np.int32)
    rank = np.empty(n, dtype=np.int32)
    reach, key = 8, words[:n][order]
    while True:
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1], dtype=np.int32)])
        rank[order] = new
        if reach >= depth or (n and new[-1] == n - 1):
            return order
        key = rank * np.int64(n + 1)
        if reach < n:
            key[: n - reach] += rank[reach:] + 1
        order = np.argsort(key).astype(np.int32)
        key = key[order]
        reach *= 2


def _ranges(words: np.ndarray, order: np.ndarray, raw: np.ndarray, raw_at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every piece the range of the suffix array whose suffixes begin with it: two binary searches, all pieces at once."""
    start, length = raw_at[ids], raw_at[ids + 1] - raw_at[ids]
    blocks = -(-int(length.max()) // 8)
    padded = np.concatenate([raw, np.zeros(8 * blocks + 8, np.uint8)])
    piece, mask = [], []
    for b in range(blocks):
        inside = np.clip(length - 8 * b, 0, 8)
        m = np.where(inside == 0, np.uint64(0), ~np.uint64(0) << np.where(inside == 0, 0, 8 * (8 - inside)).astype(np.uint64))
        p = np.zeros(len(ids), dtype=np.uint64)
        for k in range(8):
            p = (p << np.uint64(8)) | padded[start + 8 * b + k].astype(np.uint64)
        piece.append(p & m)
        mask.append(m)

    def search(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(len(ids), np.int64), np.full(len(ids), len(order), np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            pos, less, equal = order[mid], np.zeros(len(open_), bool), np.ones(len(open_), bool)
            for b in range(blocks):
                w = words[np.minimum(pos + 8 * b, len(words) - 1)] & mask[b][open_]
                less |= equal & (w < piece[b][open_])
                equal &= w == piece[b][open_]
            go = less | equal if upper else less
            lo[open_[go]], hi[open_[~go]] = mid[go] + 1, mid[~go]
        return lo

    return search(False), search(True)


def may_follow(a: np.ndarray, b: np.ndarray, v: dict) -> np.ndarray:
    """Whether greedy merging leaves the boundary between pieces a and b: the merges that made them are undone from the
    last on, and at no time may a merge across the boundary come first. Characters outside the vocabulary are -1."""
    ok, live = np.ones(len(a), dtype=bool), np.flatnonzero((a >= 0) & (b >= 0))
    a, b, limit = a[live], b[live], np.full(len(live), _NONE)
    while len(live):
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(v["pair"], key), len(v["pair"]) - 1)
        crosses = (v["pair"][at] == key) & (v["pair_rank"][at] < limit)
        ok[live[crosses]] = False
        made_a, made_b = np.where(v["right"][a] >= 0, v["rank"][a], -1), np.where(v["left"][b] >= 0, v["rank"][b], -1)
        go = ~crosses & ((made_a >= 0) | (made_b >= 0))
        live, a, b, made_a, made_b = live[go], a[go], b[go], made_a[go], made_b[go]
        undo_a = made_a > made_b
        limit = np.where(undo_a, made_a, made_b + 1)
        a, b = np.where(undo_a, v["right"][a], a), np.where(undo_a, b, v["left"][b])
    return ok


def _relax(data: np.ndarray, at: np.ndarray, v: dict) -> tuple[np.ndarray, np.ndarray]:
    """For every end position in the stretches data[at[i]:at[i+1]], the piece kept there (-1 a character outside the
    vocabulary, -2 none) and its length in bytes. Every stretch is taken as if nothing stood before it."""
    n = len(at) - 1
    words = _words(data)
    lengths = np.diff(v["raw_at"]).astype(np.int32)
    order = suffix_array(words, len(data), int(lengths[v["match"]].max()))
    lo, hi = _ranges(words, order, v["raw"], v["raw_at"], v["match"])
    del words
    start, piece = order[ragged(lo, hi - lo)], np.repeat(v["match"].astype(np.int32), hi - lo)
    del order
    begins = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32)  # characters; those that are no piece become edges of their own
    char_len = np.diff(np.append(begins, len(data))).astype(np.int32)
    char_at, stretch_at = np.zeros(len(data), dtype=np.int32), np.zeros(len(data), dtype=np.int32)
    char_at[begins] = char_len
    stretch_at[at[1:-1]] = 1
    stretch_at = np.cumsum(stretch_at, dtype=np.int32)
    one = np.zeros(len(data), dtype=bool)
    one[start[lengths[piece] == char_at[start]]] = True
    lone = ~one[begins]
    start = np.concatenate([start, begins[lone]])
    length = np.concatenate([lengths[piece], char_len[lone]])
    piece = np.concatenate([piece, np.full(int(lone.sum()), -1, np.int32)])
    stretch, begin = stretch_at[start], at[:-1].astype(np.int32)
    inside = start + length <= at[stretch + 1]
    start, length, piece, stretch = start[inside], length[inside], piece[inside], stretch[inside]
    level = start + length - begin[stretch]
    # edges in order of where they end, the longest first; stretches are short, so that the three numbers fit
    by = np.argsort((level.astype(np.int64) << 40) | (stretch.astype(np.int64) << 12) | (4095 - np.minimum(length, 4095)))
    start, length, piece, stretch, level = start[by], length[by], piece[by], stretch[by], level[by]
    kept, span = np.full(len(data) + 1, -2, dtype=np.int32), np.zeros(len(data) + 1, dtype=np.int32)
    stops = np.flatnonzero(np.append(level[1:] != level[:-1], True)) + 1 if len(level) else []
    i = 0
    for j in stops:
        s, p, g = start[i:j], piece[i:j], stretch[i:j]
        first = s == begin[g]
        before = np.where(first, -1, kept[s])  # kept holds the piece that ends at s within the same stretch
        ok = first | (before == -1) | (p == -1)
        check = np.flatnonzero(~ok & (before >= 0))
        if len(check):
            key, flat = np.unique((before[check].astype(np.int64) << 32) | p[check], return_inverse=True)
            ok[check] = may_follow(key >> 32, key & 0xFFFFFFFF, v)[flat]
        ok &= first | (before != -2)
        k = np.flatnonzero(ok)
        if len(k):
            k = k[np.append(True, g[k][1:] != g[k][:-1])]
            end = s[k] + length[i:j][k]
            kept[end], span[end] = p[k], length[i:j][k]  # an end may be the next stretch's start, whose edges don't look back
        i = j
    return kept, span


def _mend(text: bytes, begin: int, pos: int, kept: np.ndarray, span: np.ndarray, lanes: np.ndarray, reach: int, v: dict) -> int:
    """Relax text position by position after pos until reach ends in a row within one lane are as they were; where it stops.

    kept and span, of a segment from begin on, are right up to pos and what lanes found after it."""
    named: dict[bytes, int] = v.setdefault("named", {})
    if not named:
        raw = v["raw"].tobytes()
        named.update((raw[v["raw_at"][i] : v["raw_at"][i + 1]], int(i)) for i in v["match"])
    may: dict[tuple[int, int], bool] = v.setdefault("may", {})
    same, cuts = 0, set(lanes.tolist())
    while pos < len(text) and same < reach:
        if pos in cuts:
            same = 0
        pos += 1
        found = (-2, 0)
        if pos == len(text) or text[pos] & 0xC0 != 0x80:
            head = pos - 1
            while text[head] & 0xC0 == 0x80:
                head -= 1
            lone = text[head:pos] not in named
            for size in range(min(reach, pos - begin), 0, -1):
                s = pos - size
                p = -1 if lone and s == head else named.get(text[s:pos])
                if p is None:
                    continue
                before = -1 if s == begin else int(kept[s])
                if before == -2:
                    continue
                if before >= 0 and p >= 0:
                    if (before, p) not in may:
                        may[before, p] = bool(may_follow(np.array([before]), np.array([p]), v)[0])
                    if not may[before, p]:
                        continue
                found = (p, size)
                break
        same = same + 1 if found == (kept[pos], span[pos]) else 0
        kept[pos], span[pos] = found
    return pos


def _kept(data: np.ndarray, at: np.ndarray, v: dict) -> tuple[np.ndarray, np.ndarray]:
    """_relax for segments of any length, a bounded number of bytes at a time.

    A long segment goes in lanes side by side, each with a lead-in before it. What is kept depends on the pieces kept
    at the last few ends only, so a lane is right where its lead-in ends like the lane before; else it is mended.
    """
    reach = int(np.diff(v["raw_at"])[v["match"]].max())
    lead = -(-2 * reach // 64) * 64
    size = np.diff(at)
    count = np.maximum(-(-size // LANE), 1)
    segment = np.repeat(np.arange(len(size)), count)
    number = ragged(np.zeros(len(size), np.int64), count)
    own = at[segment] + LANE * number
    begin = np.where(number > 0, own - lead, own)
    for x in (own, begin):
        for _ in range(3):  # to the beginning of a character
            x -= (number > 0) & ((data[x] & 0xC0) == 0x80)
    end = np.where(np.append(segment[1:] == segment[:-1], False), np.append(own[1:], 0), at[segment + 1])
    kept, span = np.full(len(data) + 1, -2, dtype=np.int32), np.zeros(len(data) + 1, dtype=np.int32)
    taken = np.cumsum(end - begin)
    wrong, i = [], 0
    while i < len(own):
        j = max(i + 1, int(np.searchsorted(taken, (taken[i - 1] if i else 0) + PART, side="right")))
        lo, mid, hi = begin[i:j], own[i:j], end[i:j]
        to = np.concatenate([[0], np.cumsum(hi - lo)])
        k, s = _relax(data[ragged(lo, hi - lo)], to, v)
        here, there = ragged(to[:-1] + (mid - lo) + 1, hi - mid), ragged(mid + 1, hi - mid)
        kept[there], span[there] = k[here], s[here]
        later = np.flatnonzero(number[i:j] > 0)
        tail = np.arange(1 - reach, 1)
        here, there = (to[:-1] + (mid - lo))[later, None] + tail, mid[later, None] + tail
        wrong += (later[((k[here] != kept[there]) | (s[here] != span[there])).any(axis=1)] + i).tolist()
        i = j
    done = 0
    for lane in wrong:
        if own[lane] < done:
            continue
        a, b = int(at[segment[lane]]), int(at[segment[lane] + 1])
        mine = own[(segment == segment[lane]) & (own > own[lane])] - a
        done = a + _mend(data[a:b].tobytes(), 0, int(own[lane]) - a, kept[a : b + 1], span[a : b + 1], mine, reach, v)
    return kept, span


def _encode_distinct(data: np.ndarray, at: np.ndarray, v: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids of segments data[at[i]:at[i+1]] and offsets of each segment's ids."""
    n = len(at) - 1
    kept, span = _kept(data, at, v)
    long = np.diff(at) > 16 * LANE
    open_ = np.flatnonzero(~long)
    pos = at[1:][open_]
    ends = []
    while len(open_):  # walk back from every segment's end at once
        ends.append(pos)
        pos = pos - span[pos]
        go = pos > at[open_]
        open_, pos = open_[go], pos[go]
    for i in np.flatnonzero(long).tolist():
        step, p, own = span[at[i] : at[i + 1] + 1].astype(np.uint8).tobytes(), int(at[i + 1] - at[i]), array("q")
        while p:
            own.append(p)
            p -= step[p]
        ends.append(np.frombuffer(own, dtype=np.int64) + at[i])
    pos = np.sort(np.concatenate(ends))  # positions rise with the segments
    seg, ids, size = np.searchsorted(at, pos, side="left") - 1, kept[pos], span[pos]
    count = np.where(ids >= 0, 1, size if v["fallback"] else 1)
    out = np.repeat(ids, count)
    lost = np.flatnonzero(out < 0)
    if len(lost):
        if v["fallback"]:
            out[lost] = v["byte"][data[ragged((pos - size)[ids < 0], size[ids < 0])]]
        else:
            out[lost] = v["unk"]
    per = np.bincount(seg, count, n).astype(np.int64)
    return out, np.concatenate([[0], np.cumsum(per)])


def encode(data: np.ndarray, at: np.ndarray, v: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts data[at[i]:at[i+1]] (UTF-8) and offsets of each text's ids. An empty text has none."""
    full = np.diff(at) > 0
    rows = np.flatnonzero(full)
    if not len(rows):
        return np.empty(0, np.int32), np.zeros(len(at), np.int64)
    mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.empty(0, np.int64)
    if len(mark):  # a literal U+2581 is a space to the model
        drop = np.zeros(len(data), dtype=bool)
        data = data.copy()
        data[mark] = 0x20
        drop[mark + 1] = drop[mark + 2] = True
        at = at - np.concatenate([[0], np.cumsum(drop)])[at]
        data = data[~drop]
    head = at[:-1][rows]
    data = np.insert(data, head, 0x20)  # the dummy prefix
    tat = np.concatenate([head + np.arange(len(rows)), [len(data)]])
    cut = segments(data, tat, v)
    bounds = np.append(cut, len(data))
    ids, counts, i = [], [], 0
    while i < len(cut):  # segments are independent, so a long text goes in parts
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK, side="right")) - 1)
        start, size = bounds[i:j], np.diff(bounds[i : j + 1])
        pick, flat = distinct(data, start, size)
        some, some_at = _encode_distinct(data[ragged(start[pick], size[pick])], np.concatenate([[0], np.cumsum(size[pick])]), v)
        count = np.diff(some_at)[flat]
        ids.append(some[ragged(some_at[:-1][flat], count)].astype(np.int32))
        counts.append(count)
        i = j
    per = np.zeros(len(full), dtype=np.int64)
    per[rows] = np.add.reduceat(np.concatenate(counts), np.searchsorted(cut, tat[:-1]))
    return np.concatenate(ids), np.concatenate([[0], np.cumsum(per)])


def decode(ids: np.ndarray, at: np.ndarray, v: dict) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts with ids[at[i]:at[i+1]] and their offsets, without the dummy prefix."""
    begin, count = v["raw_at"][:-1][ids], np.diff(v["raw_at"])[ids]
    data = v["raw"][ragged(begin, count)]
    ends = np.concatenate([[0], np.cumsum(count)])[at]
    first = ends[:-1][np.diff(ends) > 0]
    lead = first[data[first] == 0x20]
    gone = np.zeros(len(data) + 1, dtype=np.int64)
    gone[lead + 1] = 1
    keep = np.ones(len(data), dtype=bool)
    keep[lead] = False
    return data[keep], ends - np.cumsum(gone)[ends]


def with_ids(docs: DataFrame, text_col: str = "text", model: str = MODEL, out_col: str = "ids") -> DataFrame:
    """docs with the ids of the text as array<int>, in place of a column of that name; a null text has none."""
    sent = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, CHUNK):
            ids, at = encode(*utf8(part.column(text_col)), sent.value)
            own = part.select(others)
            yield pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=[*own.schema.names, out_col])

    others = [c for c in docs.columns if c != out_col]
    return docs.mapInArrow(run, _ddl(docs.select([F.col(f"`{c}`") for c in others]), f"`{out_col}` array<int>"))


def _ddl(docs: DataFrame, extra: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [extra])


def with_text(rows: DataFrame, ids_col: str = "ids", model: str = MODEL, out_col: str = "decoded") -> DataFrame:
    """rows with the text that their ids stand for, in place of a column of that name; null ids count as none. Bytes that are no UTF-8 become U+FFFD."""
    sent = rows.sparkSession.sparkContext.broadcast(load(model))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken = np.cumsum(batch.column(ids_col).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = np.unique(np.searchsorted(taken, np.arange(CHUNK, taken[-1] + CHUNK if len(taken) else 0, CHUNK)) + 1)
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a < b:
                    yield batch.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            lists = batch.column(ids_col)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            data, at = decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(size)]).astype(np.int64), sent.value)
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]
            own = batch.select(others)
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(texts, pa.string())], names=[*own.schema.names, out_col])

    others = [c for c in rows.columns if c != out_col]
    return rows.mapInArrow(run, _ddl(rows.select([F.col(f"`{c}`") for c in others]), f"`{out_col}` string"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """Per row of docs: id, n_bytes, n_ids, ids_sha256 (little-endian int32), decoded_sha256, exact (decoding gave the text).

    A null or empty text has no ids and decodes to the empty text. Only a literal U+2581, which the model reads as a
    space, keeps a text from coming back exactly. Repeated rows give repeated rows; an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", CHUNK):
            data, at = utf8(part.column("t"))
            ids, id_at = encode(data, at, sent.value)
            back, back_at = decode(ids, id_at, sent.value)
            raw, ids32, text = back.tobytes(), ids.astype("<i4").tobytes(), data.tobytes()
            sha = lambda b, at, k=1: pa.array([hashlib.sha256(b[k * i : k * j]).hexdigest() for i, j in zip(at.tolist(), at[1:].tolist())])
            exact = pa.array([raw[a:b] == text[c:d] for a, b, c, d in zip(back_at.tolist(), back_at[1:].tolist(), at.tolist(), at[1:].tolist())])
            yield pa.RecordBatch.from_arrays(
                [part.column("i"), pa.array(np.diff(at)), pa.array(np.diff(id_at)), sha(ids32, id_at, 4), sha(raw, back_at), exact],
                names=["i", "n_bytes", "n_ids", "ids_sha256", "decoded_sha256", "exact"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"i {kind}, n_bytes bigint, n_ids bigint, ids_sha256 string, decoded_sha256 string, exact boolean").withColumnRenamed("i", id_col)
