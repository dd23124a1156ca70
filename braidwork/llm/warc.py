"""WARC archives, index first.

Writing gives an index row per record: archive, byte offset and length, URL, payload digest. Reading starts from
selected index rows: sorted by place, near ones are coalesced into one byte-range read, and each record is then
unpacked on its own (records are separate gzip members), parsed, and its payload held against its digest. Archives go
to a folder that all executors share; a task that is run again writes a new file, and only files that the index names
count.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import partitions, shared_dir

#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
#: Ranges of an archive at most GAP bytes apart are read at once, READ bytes at most unless one record is longer.
GAP, READ = 64 << 10, 4 << 20
#: Bytes of an archive dealt to one task's reads at a time.
_REGION = 16 << 20
#: The index, a Parquet table in the archives' folder.
INDEX = "index.parquet"
_INDEX = "file string, offset bigint, length bigint, url string, digest string, record_type string, page_id bigint"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record, or with refers_to a revisit of the same payload, whose block stops after the HTTP header."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~.-_' + chr(39))}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _urn(value: str) -> int | None:
    number = value.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None, bytes]:
    """(page_id, payload_bytes, digest in hex, record type, refers_to, payload or b"" of a revisit); ValueError if broken."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    field = dict(line.split(": ", 1) for line in lines)
    if not first.startswith("WARC/1.") or len(rest) != int(field["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    n = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    sha1 = base64.b32decode(field["WARC-Payload-Digest"].removeprefix("sha1:"))
    revisit = field["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != n or hashlib.sha1(payload).digest() != sha1):
        raise ValueError("payload does not match its digest")
    return _urn(field["WARC-Record-ID"]), n, sha1.hex(), field["WARC-Type"], _urn(field["WARC-Refers-To"]) if revisit else None, payload


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of pages and the index beside the archives; return the index.

    A null html is an empty payload, a null url leaves its header out. Among equal payloads of REVISIT_BYTES or more the
    row with the largest id is the response (rows that repeat that id too); with no id but null ones all are responses.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    stored = rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1 AND keep IS NOT NULL")
    rows = rows.join(stored.select("digest", "keep"), "digest", "left")
    rows = rows.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, offset, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            index = []
            for page_id, url, payload, digest, refers in zip(*(batch.column(c) for c in range(5))):
                if out is None:
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                page_id, url, digest, refers = page_id.as_py(), url.as_py(), digest.as_py(), refers.as_py()
                pack = zlib.compressobj(4, wbits=31)
                data = pack.compress(record(page_id, url, payload.as_py(), bytes.fromhex(digest), refers, date)) + pack.flush()
                out.write(data)
                index.append((f"{folder}/{name}", offset, len(data), url, digest, "response" if refers is None else "revisit", page_id))
                offset += len(data)
            if index:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index), kinds)], names=["file", "offset", "length", "url", "digest", "record_type", "page_id"])
        if out is not None:
            out.close()

    rows.mapInArrow(run, _INDEX).write.parquet(f"{folder}/{INDEX}")
    return index(pages.sparkSession, folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of the archives in a folder that write() filled, in this session or another."""
    return spark.read.parquet(f"{folder}/{INDEX}")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) ranges as (begin, end, ranges within) of the reads that cover them."""
    begin = end = 0
    held: list[tuple[int, int]] = []
    for offset, length in ranges:
        if held and (offset - end > gap or offset + length - begin > most):
            yield begin, end, held
            held = []
        if not held:
            begin, end = offset, offset
        held.append((offset, length))
        end = max(end, offset + length)
    if held:
        yield begin, end, held


def read(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the index rows: page_id, payload_bytes, payload_digest, record_type, refers_to (and payload).

    Needs columns file, offset and length only. A broken record raises. An empty index gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 if with_payload else 5]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        opened, source = None, None
        for batch in batches:
            by_file: dict[str, list[tuple[int, int]]] = {}
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in range(3))):
                by_file.setdefault(file, []).append((offset, length))
            for file, ranges in by_file.items():
                if file != opened:
                    if source is not None:
                        source.close()
                    store, path = fs.FileSystem.from_uri(file)
                    opened, source = file, store.open_input_file(path)
                for begin, end, held in coalesced(sorted(ranges)):
                    data = source.read_at(end - begin, begin)
                    got = [parse(zlib.decompress(data[o - begin : o - begin + n], wbits=31)) for o, n in held]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*got))[: len(names)], kinds)], names=names)
        if source is not None:
            source.close()

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + (", payload binary" if with_payload else "")
    places = index.select("file", "offset", "length")
    dealt = places.repartition(partitions(index.sparkSession), "file", (F.col("offset") / _REGION).cast("bigint")).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, schema)
