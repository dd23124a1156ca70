"""CSV records that span lines, read in splits.

Whether a line begins inside a quoted value depends on all before it, but only through one bit. So each block of a file first says
where it ends up from either beginning, and whether it closes what was open; the driver goes through these, a row per block; then each block knows how it begins and
cuts its lines into records. What a block leaves open is put together with what follows, by the block that opened it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ends_inside(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether a quoted value is open after a line. A quote opens one at the start of a value only, and two of them inside one are a
    quote; after the closing one all up to the separator is plain."""
    at, n = 0, len(line)
    while True:
        if not inside:
            if line[at : at + 1] != b'"':
                at = line.find(sep, at)
                if at < 0:
                    return False
                at += len(sep)
                continue
            at += 1
        while True:
            at = line.find(b'"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] != b'"':
                break
            at += 2
        inside = False
        at = line.find(sep, at + 1)
        if at < 0 or at > n:
            return False
        at += len(sep)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array, pa.RecordBatch]]:
    """The batch's lines by block, in order."""
    f, b = batch.column("f"), batch.column("b")
    if not batch.num_rows:
        return
    change = pc.or_(pc.not_equal(f[1:], f[:-1]), pc.not_equal(b[1:], b[:-1])).to_numpy(zero_copy_only=False).nonzero()[0] + 1
    for i, k in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
        part = batch.slice(i, k - i)
        yield f[i].as_py(), b[i].as_py(), part.column("line"), part


def split(spark: SparkSession, path: str, sep: str, charset: str) -> tuple[DataFrame, str | None]:
    """(record) of all CSV records of a file or folder but the first of each file, and the first one. charset is UTF-8 or ISO-8859-1."""
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.col("value").cast("binary").alias("line"))
    apart = sep.encode()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple[str, int], list[bool]] = {}
        for batch in batches:
            for f, b, line, _ in _runs(batch):
                now = state.setdefault((f, b), [False, True, False])
                for x in line.filter(pc.match_substring(line, '"')).to_pylist():
                    now[:2] = [ends_inside(x, s, apart) for s in now[:2]]
                    now[2] = now[2] or not now[1]
        rows = [(*k, *v) for k, v in state.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()))], names=["f", "b", "shut", "open", "closes"])

    begins, now, opener, last = [], False, 0, None
    for r in sorted(lines.mapInArrow(ends, "f string, b bigint, shut boolean, open boolean, closes boolean").collect()):  # a row per block
        if r.f != last:
            now, last = False, r.f
        begins.append((r.f, r.b, now, opener if now else r.b))
        after = r.open if now else r.shut
        if after and (not now or r.closes):
            opener = r.b
        now = after
    if not begins:
        return spark.createDataFrame([], "record string"), None
    start = spark.createDataFrame(begins, "f string, b bigint, inside boolean, opener bigint")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, inside, held, whole, opener = None, False, [], True, 0

        def rest() -> list[tuple]:
            # what is open at a block's end waits for the next block's beginning
            return [(block[0], opener if not whole else block[1], block[1], b"\n".join(held))] if block and held else []

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["f", "opener", "b", "record"])

        for batch in batches:
            out: list[tuple] = []
            for f, b, line, part in _runs(batch):
                if (f, b) != block:
                    out += rest()
                    block, held = (f, b), []
                    inside, opener = part.column("inside")[0].as_py(), part.column("opener")[0].as_py()
                    whole = not inside
                    first = b == 0
                for x in line.to_pylist():
                    held.append(x)
                    if inside or b'"' in x:
                        inside = ends_inside(x, inside, apart)
                    if not inside:
                        record = b"\n".join(held)
                        out.append((f, None if whole else opener, -1 if first and record.strip() else b, record))
                        first = first and not record.strip()
                        held, whole = [], True
            yield rows(out)
        yield rows(rest())

    cuts = lines.join(F.broadcast(start), ["f", "b"]).mapInArrow(cut, "f string, opener bigint, b bigint, record binary")
    parts = F.array_sort(F.collect_list(F.struct("b", "record")))
    joined = cuts.where("opener IS NOT NULL").groupBy("f", "opener").agg(F.array_join(F.transform(parts, lambda x: F.decode(x["record"], charset)), "\n").alias("record"), F.min("b").alias("b"))
    each = cuts.where("opener IS NULL").select("f", F.decode("record", charset).alias("record"), "b").unionByName(joined.select("f", "record", "b"))
    trimmed: Column = F.regexp_replace("record", "\r$", "")
    each = each.select("f", "b", trimmed.alias("record")).where(F.trim("record") != "")
    head = each.where("b = -1").orderBy("f").limit(1).collect()
    return each.where("b <> -1").select("record"), head[0].record if head else None
