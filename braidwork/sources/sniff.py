"""Looking at the beginning of a source: type, encoding, delimiter. Reads go through Spark, so any of its stores will do."""

from __future__ import annotations

import codecs

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..types import IngestionError, SourceType

_SUFFIXES = {".csv": SourceType.CSV, ".parquet": SourceType.PARQUET, ".json": SourceType.JSON, ".jsonl": SourceType.JSON, ".xlsx": SourceType.EXCEL, ".xls": SourceType.EXCEL}
_DATABASES = ("postgresql", "mysql", "sqlite", "mssql", "oracle", "jdbc:")


def source_type(source: str) -> SourceType:
    """By suffix, then by database URL, then by http(s)."""
    low = source.lower()
    if not low.startswith(("http://", "https://")):
        for suffix, kind in _SUFFIXES.items():
            if low.rstrip("/").endswith(suffix):
                return kind
    if any(d in low for d in _DATABASES) and ":" in low:
        return SourceType.SQL
    if low.startswith(("http://", "https://")):
        for suffix, kind in _SUFFIXES.items():
            if low.endswith(suffix):
                return kind
        return SourceType.REST
    raise IngestionError(f"Cannot detect source type: {source}")


def head(spark: SparkSession, path: str, size: int) -> bytes:
    """The first bytes of a file, or of the first file of a folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(hadoop).isDirectory():
        files = sorted(str(f.getPath()) for f in fs.listStatus(hadoop) if not f.getPath().getName().startswith(("_", ".")))
        return head(spark, files[0], size) if files else b""
    stream = fs.open(hadoop)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(size, fs.getFileStatus(hadoop).getLen())))
    finally:
        stream.close()


def encoding(raw: bytes, whole: bool = False) -> str:
    """By byte-order mark, then the first that decodes of UTF-8, Shift-JIS (where it gives kana) and Latin-1. Unless raw is
    whole, a character may be cut at its end."""
    if raw.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig"
    if raw.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "utf-16"
    for name in ("utf-8", "shift_jis"):
        try:
            text = codecs.getincrementaldecoder(name)().decode(raw, final=whole)
        except UnicodeDecodeError:
            continue
        if name == "utf-8" or any("\u3041" <= c <= "\u30ff" for c in text):
            return name
    return "latin-1"


def lines(spark: SparkSession, path: str) -> tuple[str, bool]:
    """(encoding, whether a quoted value holds a line end), from all lines of a text whose bytes may be UTF-8. One scan."""
    value = F.col("value")  # the text source hands bytes through as they are
    quotes = F.octet_length(value) - F.octet_length(F.replace(value, F.lit('"'), F.lit("")))
    broken = ~F.is_valid_utf8(value)
    some = F.min(F.when(broken, F.struct(value.cast("binary").alias("raw"))))
    odd, bad = spark.read.text(path).agg(F.coalesce(F.bool_or(quotes % 2 == 1), F.lit(False)), some).first()
    return ("utf-8" if bad is None else encoding(bytes(bad.raw), True)), bool(odd)


def delimiter(text: str) -> str:
    """The most frequent of comma, tab, semicolon, bar in the first 8192 characters; the earlier one on ties."""
    return max(",\t;|", key=text[:8192].count)
