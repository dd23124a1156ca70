"""Media columns: FLAC streams encoded and decoded many frames at a time.

Text bytes are stored as 8-bit mono PCM. A block of frames is a matrix with a column per frame, and every step, the next
sample of all frames, is a handful of array operations: Rice codes, fixed and linear predictors, CRC-8 of headers and
CRC-16 of frames. The seek table has a point for every block, so all frames of all streams of a chunk can be decoded
side by side, and any sample be reached without the ones before it; streams with fewer points are decoded in waves.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import ragged, slices, utf8

BLOCK = 512
RATE = 8000
#: Bytes a payload is padded to a multiple of.
UNIT = 64
ORDER, SHIFT = 4, 5
#: Frames worked on at once.
_LANES = 4096
_CHUNK = 2 << 20


def _crc_table(poly: int, bits: int) -> np.ndarray:
    c = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        c = ((c << 1) ^ np.where(c >> (bits - 1) & 1, poly, 0)) & ((1 << bits) - 1)
    return c.astype(np.uint32)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc(data: np.ndarray, start: np.ndarray, length: np.ndarray, wide: bool) -> np.ndarray:
    """CRC of data[start:start+length] for many ranges at once."""
    by = np.argsort(-length, kind="stable")  # the longest first, so that those still open are a prefix
    start, length = start[by], length[by]
    c = np.zeros(len(start), dtype=np.uint32)
    n = len(start)
    for i in range(int(length[0]) if n else 0):
        while n and length[n - 1] <= i:
            n -= 1
        byte = data[start[:n] + i]
        c[:n] = ((c[:n] << 8) & 0xFFFF) ^ _CRC16[(c[:n] >> 8) ^ byte] if wide else _CRC8[c[:n] ^ byte]
    out = np.empty_like(c)
    out[by] = c
    return out


def _lpc(x: np.ndarray) -> np.ndarray:
    """(ORDER, lanes) integer coefficients over 2^SHIFT, from exact autocorrelations by Levinson's recursion."""
    wide = x.astype(np.int64)
    r = np.stack([(wide[k:] * wide[: len(x) - k]).sum(axis=0) for k in range(ORDER + 1)]).astype(np.float64)
    a, err = np.zeros((ORDER, x.shape[1])), np.maximum(r[0], 1.0) * (1 + 1e-9)
    for m in range(ORDER):
        k = (r[m + 1] - sum((a[j] * r[m - j] for j in range(m)), np.zeros(x.shape[1]))) / err
        a[:m], a[m] = a[:m] - k * a[:m][::-1].copy(), k
        err = np.maximum(err * (1 - k * k), 1e-3)
    return np.clip(np.rint(a * (1 << SHIFT)), -128, 127).astype(np.int32)


def _predict(x: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """Residual of the linear predictor; the first ORDER rows are warm-up samples."""
    out = x.copy()
    guess = sum(coef[j] * x[ORDER - 1 - j : len(x) - 1 - j] for j in range(ORDER))
    out[ORDER:] -= guess >> SHIFT
    return out


def _coded_number(n: int) -> bytes:
    """A frame number in FLAC's extension of UTF-8."""
    if n < 128:
        return bytes([n])
    for size in range(2, 8):
        if n < 1 << (5 * size + 1):
            tail = [0x80 | n >> 6 * k & 63 for k in range(size - 2, -1, -1)]
            return bytes([(0xFF00 >> size & 0xFF) | n >> 6 * (size - 1), *tail])
    raise ValueError("frame number out of range")


def _encode_block(data: np.ndarray, start: np.ndarray, n: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of the samples data[start:start+n] (bytes) as one byte array, and each frame's length."""
    lanes, step = len(start), np.arange(BLOCK)[:, None]
    live = step < n
    x = np.where(live, data[np.minimum(start + step, len(data) - 1)].astype(np.int32) - 128, 0)
    d1 = np.vstack([x[:1], x[1:] - x[:-1]])
    d2 = np.vstack([d1[:2], d1[2:] - d1[1:-1]])
    coef = _lpc(x)
    tries = [x, d1, d2, _predict(x, coef)]
    orders = [0, 1, 2, ORDER]
    cost = np.stack([np.where(live & (step >= o), np.abs(t), 0).sum(axis=0) + 16 * o for t, o in zip(tries, orders)])
    cost[3] += 16
    pick = cost.argmin(axis=0)
    order = np.array(orders)[pick]
    res = np.where(pick == 0, tries[0], np.where(pick == 1, tries[1], np.where(pick == 2, tries[2], tries[3])))
    coded = live & (step >= order)
    u = np.where(coded, (res << 1) ^ (res >> 31), 0)
    bits_by_k = np.stack([(u >> k).sum(axis=0) + (k + 1) * (n - order) for k in range(10)])
    k = bits_by_k.argmin(axis=0)
    constant = (np.where(live, x, x[:1]) == x[:1]).all(axis=0)
    extra = np.where(pick == 3, 9 + 8 * ORDER, 0) + 10
    plain = ~constant & (8 * order + extra + bits_by_k.min(axis=0) >= 8 * n)
    order, extra = np.where(constant | plain, 0, order), np.where(constant | plain, 0, extra)
    rice = live & (step >= order) & ~plain & ~constant
    zeros = np.where(rice, u >> k, 0)
    width = np.where(rice, k + 1, np.where(live & (~constant | (step == 0)), 8, 0))
    value = np.where(rice, (1 << k) | (u & ((1 << k) - 1)), x & 0xFF)
    heads = []
    for size, num in zip(n.tolist(), number.tolist()):
        whole = size == BLOCK
        heads.append(bytes([0xFF, 0xF8, (0x90 if whole else 0x70) | 4, 0x02]) + _coded_number(num) + (b"" if whole else struct.pack(">H", size - 1)))
    head_len = np.array([len(h) for h in heads])
    total = zeros + width
    before = np.cumsum(total, axis=0) - total
    body = 8 + total.sum(axis=0) + extra
    size = head_len + 1 + -(-body // 8) + 2
    at = np.cumsum(size) - size
    first = 8 * (at + head_len + 1)  # the subframe's first bit
    bits = np.zeros(8 * int(size.sum()), dtype=np.uint8)

    def put(pos: np.ndarray, val: np.ndarray, wid: int) -> None:
        for b in range(wid):
            bits[pos + wid - 1 - b] = (val >> b) & 1

    kind = np.where(constant, 0, np.where(plain, 1, np.where(pick == 3, 32 + ORDER - 1, 8 + order)))
    put(first, kind << 1, 8)
    coder = ~constant & ~plain
    lpc = np.flatnonzero(coder & (pick == 3))
    q = first[lpc] + 8 + 8 * ORDER
    put(q, np.full(len(lpc), 7), 4)
    put(q + 4, np.full(len(lpc), SHIFT), 5)
    for j in range(ORDER):
        put(q + 9 + 8 * j, coef[j][lpc] & 0xFF, 8)
    c = np.flatnonzero(coder)
    put(first[c] + 8 + 8 * order[c] + extra[c] - 4, k[c], 4)  # method and partition order are zero
    pos = first + 8 + before + np.where(step >= order, extra, 0) + zeros
    for b in range(int(width.max())):
        there = width > b
        bits[(pos + width - 1 - b)[there]] = (value[there] >> b) & 1
    out = np.packbits(bits)
    flat = np.frombuffer(b"".join(heads), dtype=np.uint8)
    out[ragged(at, head_len)] = flat
    out[at + head_len] = _crc(out, at, head_len, False)
    crc = _crc(out, at, size - 2, True)
    out[at + size - 2], out[at + size - 1] = crc >> 8, crc & 0xFF
    return out, size


def encode(data: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A FLAC stream for each non-empty payload data[at[i]:at[i+1]] of 8-bit unsigned samples."""
    length = np.diff(at)
    frames = -(-length // BLOCK)
    number = ragged(np.zeros(len(frames), np.int64), frames)
    start = np.repeat(at[:-1], frames) + BLOCK * number
    n = np.minimum(BLOCK, np.repeat(at[1:], frames) - start)
    parts, sizes = [], []
    for i in range(0, len(start), _LANES):
        out, size = _encode_block(data, start[i : i + _LANES], n[i : i + _LANES], number[i : i + _LANES])
        parts.append(out)
        sizes.append(size)
    body, size = np.concatenate(parts).tobytes(), np.concatenate(sizes)
    offset = np.concatenate([[0], np.cumsum(size)])
    streams, f = [], 0
    raw = (data ^ 0x80).tobytes()  # signed samples
    for i, count in enumerate(frames.tolist()):
        own = size[f : f + count]
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | int(length[i])).to_bytes(8, "big") + hashlib.md5(raw[at[i] : at[i + 1]]).digest()
        points = np.empty((count, 18), dtype=np.uint8)
        points[:, :8] = (BLOCK * np.arange(count)).astype(">u8").view(np.uint8).reshape(-1, 8)
        points[:, 8:16] = (offset[f : f + count] - offset[f]).astype(">u8").view(np.uint8).reshape(-1, 8)
        points[:, 16:] = n[f : f + count].astype(">u2").view(np.uint8).reshape(-1, 2)
        table = points.tobytes()
        streams.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + body[offset[f] : offset[f + count]])
        f += count
    return streams


def metadata(stream: bytes) -> tuple[int, int, bytes, np.ndarray]:
    """(first frame's offset, samples, MD5, seek points as rows of sample, offset, size); ValueError unless 8-bit mono FLAC."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    pos, samples, md5, points, last = 4, None, b"", np.empty((0, 3), np.int64), False
    while not last:
        last, kind, size = bool(stream[pos] & 0x80), stream[pos] & 0x7F, int.from_bytes(stream[pos + 1 : pos + 4], "big")
        block = stream[pos + 4 : pos + 4 + size]
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            if packed >> 41 & 7 or packed >> 36 & 31 != 7:
                raise ValueError("only 8-bit mono is read")
            samples, md5 = packed & ((1 << 36) - 1), block[18:34]
        elif kind == 3:
            p = np.frombuffer(block, dtype=np.dtype([("s", ">u8"), ("o", ">u8"), ("n", ">u2")]))
            p = p[p["s"] != 0xFFFFFFFFFFFFFFFF]
            points = np.stack([p["s"].astype(np.int64), p["o"].astype(np.int64), p["n"].astype(np.int64)], axis=1)
        pos += 4 + size
    if samples is None:
        raise ValueError("no STREAMINFO")
    return pos, samples, md5, points


_LEAD = np.array([16 - int(i).bit_length() for i in range(1 << 16)], dtype=np.int64)


def decode_frames(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples (most, lanes), block size and end offset of the frames of 8-bit mono streams at the offsets start.

    Both checksums of every frame are verified; ValueError if one fails or the frame uses what this decoder lacks.
    """
    padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
    word = np.zeros(len(data) + 8, dtype=np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j : j + len(word)]

    def peek(bit: np.ndarray, wid) -> np.ndarray:
        w = word[np.minimum(bit >> 3, len(word) - 1)] << (bit & 7).astype(np.uint64)
        return np.where(wid == 0, 0, w >> np.where(wid == 0, 0, 64 - np.asarray(wid)).astype(np.uint64)).astype(np.int64)

    byte = lambda o: padded[np.minimum(start + o, len(data))].astype(np.int64)
    if (byte(0) != 0xFF).any() or ((byte(1) | 1) != 0xF9).any() or ((byte(3) >> 4) != 0).any():
        raise ValueError("no frame of a mono stream here")
    lead = byte(4)
    number_len = np.where(lead < 128, 1, 8 - np.ceil(np.log2(256 - lead)).astype(np.int64))
    code, head = byte(2) >> 4, 4 + number_len
    far = padded[start + head].astype(np.int64) * 256 + padded[start + head + 1].astype(np.int64)
    n = np.where(code == 6, (far >> 8) + 1, np.where(code == 7, far + 1, np.where(code >= 8, 256 << np.maximum(code - 8, 0), np.where(code == 1, 192, 576 << np.maximum(code - 2, 0)))))
    head = head + np.where(code == 6, 1, np.where(code == 7, 2, 0)) + np.select([(byte(2) & 15) == 12, (byte(2) & 15) >= 13], [1, 2], 0)
    if (_crc(data, start, head, False) != padded[start + head]).any():
        raise ValueError("a header's checksum does not match")
    bit = 8 * (start + head + 1)
    kind = peek(bit, 8) >> 1
    if (peek(bit, 8) & 0x81).any():
        raise ValueError("wasted bits are not read")
    bit = bit + 8
    constant, plain, fixed, lpc = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | plain | fixed | lpc).all():
        raise ValueError("a reserved subframe type")
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    most, lanes = int(n.max()), len(start)
    x = np.zeros((most, lanes), dtype=np.int64)
    raw = np.where(constant, 1, np.where(plain, n, order))  # samples stored as they are
    for i in range(int(raw.max())):
        on = i < raw
        got = peek(bit, 8)
        x[i] = np.where(on, got - ((got & 0x80) << 1), 0)
        bit = bit + np.where(on, 8, 0)
    x[:, constant] = x[0, constant]
    coded = np.flatnonzero(fixed | lpc)
    if len(coded):
        b, o, size = bit[coded], order[coded], n[coded]
        is_lpc = lpc[coded]
        precision = np.where(is_lpc, peek(b, 4) + 1, 0)
        shift = np.where(is_lpc, peek(b + 4, 5), 0)
        b = b + np.where(is_lpc, 9, 0)
        top = int(o.max())
        coef = np.zeros((max(top, 1), len(coded)), dtype=np.int64)
        for j in range(top):
            on = is_lpc & (j < o)
            got = peek(b, np.where(on, precision, 0))
            coef[j] = got - ((got >> np.maximum(precision - 1, 0) & 1) << precision)
            b = b + np.where(on, precision, 0)
        method, parts = peek(b, 2), peek(b + 2, 4)
        if (method > 1).any():
            raise ValueError("a reserved residual coding")
        b = b + 6
        wide, span = 4 + method, size >> parts  # a partition's samples; its parameter stands before it
        r = np.zeros((most, len(coded)), dtype=np.int64)
        k, escape = np.zeros(len(coded), np.int64), np.zeros(len(coded), bool)
        simple = bool((parts == 0).all() and (size == size[0]).all() and (o == o[0]).all())
        for i in range(int(size.max())):  # constant frames beside them may be longer
            on = (i >= o) & (i < size)
            fresh = on & ((i == o) | (i % span == 0))
            if fresh.any():
                got = peek(b, wide)
                b = np.where(fresh, b + wide, b)
                k = np.where(fresh, got, k)
                esc = fresh & (got == (1 << wide) - 1)
                escape = np.where(fresh, esc, escape)
                if esc.any():
                    k = np.where(esc, peek(b, 5), k)
                    b = np.where(esc, b + 5, b)
            w = word[np.minimum(b >> 3, len(word) - 1)] << (b & 7).astype(np.uint64)
            q = _LEAD[(w >> np.uint64(48)).astype(np.int64)]
            long = np.flatnonzero((q == 16) & on & ~escape)
            while len(long):  # codes of sixteen zeros or more
                more = _LEAD[peek(b[long] + q[long], 16)]
                q[long] += more
                long = long[more == 16]
            low = peek(b + q + 1, k)
            u = (q << k) | low
            val = (u >> 1) ^ -(u & 1)
            used = q + 1 + k
            if escape.any():
                got = peek(b, k)
                val = np.where(escape, got - ((got >> np.maximum(k - 1, 0) & 1) << k), val)
                used = np.where(escape, k, used)
            if simple and i >= o[0]:
                r[i], b = val, b + used
            else:
                r[i], b = np.where(on, val, 0), np.where(on, b + used, b)
        bit = bit.copy()
        bit[coded] = b
        y = x[:, coded]
        for deg in range(5):
            f = np.flatnonzero(~is_lpc & (o == deg))
            if len(f):
                y[:, f] = _undo_fixed(y[:deg, f], r[deg:, f], deg)
        f = np.flatnonzero(is_lpc)
        if len(f):
            c, s, of, z = coef[:, f], shift[f], o[f], y[:, f]
            for i in range(most):
                guess = np.zeros(len(f), np.int64)
                for j in range(min(i, int(of.max()))):
                    guess += c[j] * z[i - 1 - j]
                z[i] = np.where(i >= of, r[i, f] + (guess >> s), z[i])
            y[:, f] = z
        x[:, coded] = y
    end = -(-bit // 8)
    if (_crc(data, start, end - start, True) != padded[end].astype(np.uint32) * 256 + padded[end + 1].astype(np.uint32)).any():
        raise ValueError("a frame's checksum does not match")
    return x, n, end + 2


def _undo_fixed(warm: np.ndarray, res: np.ndarray, order: int) -> np.ndarray:
    """Samples of a fixed predictor: the residual is the order-th difference, so it is summed order times."""
    starts, level = [], warm
    for _ in range(order):
        starts.append(level[-1:])  # the last value of each difference of the warm-up
        level = level[1:] - level[:-1]
    out = res
    for s in reversed(starts):
        out = np.cumsum(np.concatenate([s, out]), axis=0)[1:]
    return np.concatenate([warm, out])


def decode(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The payload bytes of all streams and their offsets. Sample counts and MD5s are verified too; ValueError if wrong."""
    if not streams:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    metas = [metadata(s) for s in streams]
    data = np.frombuffer(b"".join(streams), dtype=np.uint8)
    base = np.cumsum([0, *map(len, streams)])[:-1]
    samples = np.array([m[1] for m in metas], dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(samples)])
    out = np.zeros(int(at[-1]), dtype=np.uint8)
    known = [m[3] if len(m[3]) and m[3][0][0] == 0 else np.zeros((1, 3), np.int64) for m in metas]
    start = np.concatenate([b + m[0] + k[:, 1] for b, m, k in zip(base, metas, known)])
    to = np.concatenate([a + k[:, 0] for a, k in zip(at, known)])
    stop = np.concatenate([a + np.append(k[1:, 0], s) for a, k, s in zip(at, known, samples)])
    open_ = np.flatnonzero(to < stop)
    while len(open_):
        next_ = []
        for i in range(0, len(open_), _LANES):
            lanes = open_[i : i + _LANES]
            lo, hi = int(start[lanes].min()), int(np.minimum(len(data), start[lanes].max() + (1 << 20)))
            x, n, end = decode_frames(data[lo:hi], start[lanes] - lo)
            step = np.arange(len(x))[:, None]
            there = step < n
            if (to[lanes] + n > stop[lanes]).any():
                raise ValueError("more samples than announced")
            out[(to[lanes] + step)[there]] = (x[there] + 128).astype(np.uint8)
            start[lanes], to[lanes] = end + lo, to[lanes] + n
            next_.append(lanes[to[lanes] < stop[lanes]])
        open_ = np.concatenate(next_)
    raw = (out ^ 0x80).tobytes()
    for i, m in enumerate(metas):
        if m[2] != bytes(16) and hashlib.md5(raw[at[i] : at[i + 1]]).digest() != m[2]:
            raise ValueError("the samples' MD5 does not match")
    return out, at


def decode_at(stream: bytes, sample: int, count: int) -> bytes:
    """`count` samples from `sample` on, decoding only the blocks that hold them, by the seek table."""
    first, samples, _, points = metadata(stream)
    if not 0 <= sample <= sample + count <= samples:
        raise ValueError("beyond the stream's samples")
    before = points[points[:, 0] <= sample]
    have, offset = (int(before[-1][0]), first + int(before[-1][1])) if len(before) else (0, first)
    data, got, begin = np.frombuffer(stream, dtype=np.uint8), [], have
    while have < sample + count:
        x, n, end = decode_frames(data, np.array([offset]))
        got.append(x[: n[0], 0])
        have, offset = have + int(n[0]), int(end[0])
    return (np.concatenate(got)[sample - begin : sample - begin + count] + 128).astype(np.uint8).tobytes() if count else b""


def padded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with zero bytes appended up to a positive multiple of UNIT."""
    length = np.diff(at)
    size = np.maximum(-(-length // UNIT), 1) * UNIT
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(to[-1]), dtype=np.uint8)
    out[ragged(to[:-1], length)] = data
    return out, to


def with_media(docs: DataFrame, text_col: str = "text", out_col: str = "media") -> DataFrame:
    """docs with a binary column holding each text's FLAC stream (a null text is stored as an empty one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, _CHUNK):
            streams = encode(*padded(*utf8(part.column(text_col))))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(streams, pa.binary())], names=[*part.schema.names, out_col])

    return docs.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{out_col}` binary"]))


#: Samples of a PCM block, a whole number of frames.
PCM_SAMPLES = 16 * BLOCK
_PCM = "block int, first_sample bigint, samples bigint, pcm binary"


def _decoded(media: DataFrame) -> DataFrame:
    """Columns i, n and m (streams) to rows (i, n, media_bytes, media_sha256, block, first_sample, samples, pcm): a row per
    PCM block; a stream's blocks stand one after another in its partition. `samples` is the whole stream's number."""
    kind = media.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "m", _CHUNK):
            streams = part.column("m").to_pylist()
            data, at = decode(streams)
            count = -(-np.diff(at) // PCM_SAMPLES)
            row, block = np.repeat(np.arange(len(streams)), count), ragged(np.zeros(len(count), np.int64), count)
            first = PCM_SAMPLES * block
            raw, begin = data.tobytes(), at[:-1][row] + first
            end = np.minimum(begin + PCM_SAMPLES, at[1:][row])
            sha = pa.array([hashlib.sha256(s).hexdigest() for s in streams])
            yield pa.RecordBatch.from_arrays(
                [part.column("i").take(pa.array(row)), part.column("n").take(pa.array(row)), pa.array([len(s) for s in streams], pa.int64()).take(pa.array(row)), sha.take(pa.array(row)),
                 pa.array(block.astype(np.int32)), pa.array(first), pa.array(np.diff(at)[row]), pa.array([raw[a:b] for a, b in zip(begin.tolist(), end.tolist())], pa.binary())],
                names=["i", "n", "media_bytes", "media_sha256", "block", "first_sample", "samples", "pcm"],
            )

    return media.mapInArrow(run, f"i {kind}, n bigint, media_bytes bigint, media_sha256 string, {_PCM}")


def pcm_blocks(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id_col, block, first_sample, samples, pcm): the decoded streams as blocks of PCM_SAMPLES samples, 8-bit unsigned.

    first_sample is a block's offset in its stream, samples the stream's whole number. All frames' checksums, the sample
    counts and the MD5s are verified; a broken stream raises. Streams must not be null."""
    rows = media.select(F.col(id_col).alias("i"), F.lit(None).cast("bigint").alias("n"), F.col(media_col).alias("m"))
    return _decoded(rows).select(F.col("i").alias(id_col), "block", "first_sample", "samples", "pcm")


def write_pcm(media: DataFrame, folder: str, id_col: str = "doc_id", media_col: str = "media") -> None:
    """Write the blocks as a Parquet table that samples_at() seeks in, in this session or another."""
    pcm_blocks(media, id_col, media_col).sortWithinPartitions(id_col, "first_sample").write.parquet(folder)


def samples_at(blocks: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The samples [first, first + count) of each row (id_col, first, count) of wanted, as (id_col, first, count, pcm).

    Only blocks that hold some of them are taken, by their offsets. What lies beyond a stream's end is left out."""
    w = wanted.select(F.col(id_col).alias("__i"), "first", "count")
    end = F.col("first_sample") + F.octet_length("pcm")
    met = blocks.select(id_col, "first_sample", "pcm").join(w, (F.col(id_col) == F.col("__i")) & (F.col("first_sample") < F.col("first") + F.col("count")) & (end > F.col("first")))
    skip = F.greatest(F.col("first") - F.col("first_sample"), F.lit(0))
    piece = F.substring("pcm", (skip + 1).cast("int"), (F.least(F.col("first") + F.col("count"), end) - F.col("first_sample") - skip).cast("int"))
    in_order = F.array_sort(F.collect_list(F.struct("first_sample", piece.alias("piece"))))
    # an array of one asked range's blocks only; hex text is what can be joined
    joined = F.unhex(F.array_join(F.transform(in_order, lambda x: F.hex(x["piece"])), ""))
    return met.groupBy(id_col, "first", "count").agg(joined.alias("pcm"))


class _Running:
    """What is known of a stream after some of its blocks."""

    def __init__(self):
        self.n = self.total = self.square = self.crossings = 0
        self.below, self.tail, self.sha = None, b"", hashlib.sha256()

    def add(self, pcm: bytes, total: int, square: int, crossings: int, first_below: bool, last_below: bool) -> None:
        self.n, self.total, self.square = self.n + len(pcm), self.total + total, self.square + square
        self.crossings += crossings + (self.below is not None and self.below != first_below)
        self.below, self.tail = last_below, (self.tail + pcm[-UNIT:])[-UNIT:]
        self.sha.update(pcm)

    def feature(self) -> str:
        return f"mean={self.total // self.n} power={self.square // self.n} crossings={self.crossings} blocks={-(-self.n // BLOCK)}"


def features(media: DataFrame, id_col: str, media_col: str = "media", bytes_col: str = "n_bytes") -> DataFrame:
    """Per row: what its stored stream decodes to, from its PCM blocks in turn: mean, mean square and zero crossings of the
    signed samples and the number of FLAC blocks. Streams must be FLAC with a sample at least; a broken one raises."""
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Running()
        for part in slices(batches, "pcm"):
            data, at = utf8(part.column("pcm"))
            x = data.astype(np.int64) - 128
            total, square, below = np.add.reduceat(x, at[:-1]), np.add.reduceat(x * x, at[:-1]), x < 0
            cross = np.concatenate([[0], np.cumsum(below[1:] != below[:-1]), [0]])
            crossings = cross[at[1:] - 1] - cross[at[:-1]]
            done, out = [], []
            for i, (first, samples) in enumerate(zip(part.column("first_sample").to_pylist(), part.column("samples").to_pylist())):
                if first == 0:
                    own = _Running()
                a, b = int(at[i]), int(at[i + 1])
                own.add(data[a:b].tobytes(), int(total[i]), int(square[i]), int(crossings[i]), bool(below[a]), bool(below[b - 1]))
                if own.n == samples:
                    done.append(i)
                    out.append((samples, own.sha.hexdigest(), zlib.crc32(own.tail), own.feature()))
            if done:
                kept = part.take(pa.array(done))
                n, sha, tail, feature = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [kept.column("i"), kept.column("n"), pa.array(n, pa.int64()), pa.array(sha), pa.array(tail, pa.int64()), kept.column("media_bytes"), kept.column("media_sha256"), pa.array(feature)],
                    names=["i", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    rows = media.select(F.col(id_col).alias("i"), F.col(bytes_col).cast("bigint").alias("n"), F.col(media_col).alias("m"))
    return _decoded(rows).mapInArrow(run, f"i {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string").withColumnRenamed("i", id_col)


def stored_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text of docs as FLAC and compute features of what is read back.

    A null or empty text is a payload of UNIT zero bytes. Equal texts give equal streams wherever they stand. Repeated
    rows give repeated rows, null ids stay, an empty table gives none.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("__n"), F.col(text_col).alias("__t"))
    return features(with_media(rows, "__t", "__m").drop("__t"), "__id", "__m", "__n").withColumnRenamed("__id", id_col)
