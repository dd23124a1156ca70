"""Reading CSV, Parquet, JSON, Excel, SQL and REST sources into lazy DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rows import normalize_nan
from ..types import IngestionError, IngestorConfig, SourceType
from . import records, sniff
from .remote import read_rest, read_sql, rest_rows  # noqa: F401

#: Texts that stand for a missing value in CSV.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
_JAVA = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "latin-1": "ISO-8859-1", "utf-16": "UTF-16", "shift_jis": "Shift_JIS"}


def read_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, config: IngestorConfig | None = None) -> DataFrame:
    """With a header, types inferred after missing-value texts are nulled; integers become bigint. Delimiter and encoding
    are sniffed unless given; what the beginning says of UTF-8 is held against all lines, which also show whether values
    span lines. Files are read in splits either way, but for UTF-16 and Shift-JIS ones with such values."""
    size = max((config or IngestorConfig()).encoding_sample_bytes, 32768)
    raw = sniff.head(spark, path, size)
    given, encoding = encoding, encoding or sniff.encoding(raw, len(raw) < size)
    multiline = True
    if encoding in ("utf-8", "utf-8-sig", "latin-1"):
        found, multiline = sniff.lines(spark, path)
        encoding = encoding if given or encoding == "latin-1" or found == "utf-8" else found
    sep = sep or sniff.delimiter(raw.decode(_JAVA.get(encoding, encoding), "replace"))
    if multiline and encoding in ("utf-8", "utf-8-sig", "latin-1") and len(sep) == 1:
        return typed(_nulled(_spanning(spark, path, sep, _JAVA[encoding])))
    if encoding == "shift_jis":
        spark.conf.set("spark.sql.legacy.javaCharsets", True)  # else only Unicode's and Latin-1 are let through
    df = spark.read.option("header", True).option("sep", sep).option("encoding", _JAVA.get(encoding, encoding)).option("multiLine", multiline).option("escape", '"').csv(path)
    return typed(_nulled(df))


def _nulled(df: DataFrame) -> DataFrame:
    names = [n.lstrip("\ufeff") for n in df.columns]
    return df.toDF(*names).select([F.when(~F.col(f"`{n}`").isin(*NULL_TOKENS), F.col(f"`{n}`")).alias(n) for n in names])


def _spanning(spark: SparkSession, path: str, sep: str, charset: str) -> DataFrame:
    """A CSV file whose values may hold line ends, read in splits; its columns are named by Spark from the first record."""
    rows, head = records.split(spark, path, sep, charset)
    options = {"sep": sep, "escape": '"', "multiLine": "true"}
    names = spark.read.options(**options).option("header", True).csv(spark.sparkContext.parallelize([head or ""], 1)).columns
    if not names:
        return spark.createDataFrame([], T.StructType())
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = rows.select(F.from_csv("record", F.lit(schema), options).alias("r")).select("r.*")
    return parsed.toDF(*names)


def typed(df: DataFrame) -> DataFrame:
    """Text columns all of whose values are whole numbers, numbers or booleans, cast to bigint, double or boolean."""
    if not df.columns:
        return df
    ok = []
    for n in df.columns:
        c = F.trim(F.col(f"`{n}`"))
        some = F.count(c) > 0
        ok += [
            (some & F.coalesce(F.every(c.try_cast("bigint").isNotNull() & ~c.rlike("[.eE]") | c.isNull()), F.lit(False))).alias(f"i{len(ok)}"),
            (some & F.coalesce(F.every(c.try_cast("double").isNotNull() & ~c.rlike("[dDfF]$") | c.isNull()), F.lit(False))).alias(f"f{len(ok)}"),
            (some & F.coalesce(F.every(F.lower(c).isin("true", "false") | c.isNull()), F.lit(False))).alias(f"b{len(ok)}"),
        ]
    got = list(df.agg(*ok).first())
    out = []
    for k, n in enumerate(df.columns):
        whole, number, boolean = got[3 * k : 3 * k + 3]
        c = F.col(f"`{n}`")
        out.append((F.trim(c).try_cast("bigint") if whole else F.trim(c).try_cast("double") if number else F.lower(F.trim(c)) == "true" if boolean else c).alias(n))
    return df.select(*out)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A records document, or lines for .jsonl; columns in the order of the first record's keys."""
    lines = path.lower().rstrip("/").endswith((".jsonl", ".ndjson"))
    df = spark.read.option("multiLine", not lines).json(path)
    try:
        text = sniff.head(spark, path, 1 << 20).decode("utf-8", "replace").lstrip()
        first = json.JSONDecoder().raw_decode(text[1:].lstrip() if text.startswith("[") else text)[0]
        order = [k for k in first if k in df.columns]
    except (ValueError, TypeError):
        order = []
    return df.select(*[f"`{c}`" for c in [*order, *[c for c in df.columns if c not in order]]])


def read_excel(spark: SparkSession, path: str, sheet_name: str | int = 0) -> DataFrame:
    """One sheet, read on the driver (a workbook has a million rows a sheet at most). Needs openpyxl."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise IngestionError("Reading Excel files needs the package openpyxl") from e
    import io

    import pandas as pd

    frame = pd.read_excel(io.BytesIO(sniff.head(spark, path, 1 << 40)), sheet_name=sheet_name)
    return spark.createDataFrame(frame)


def read(spark: SparkSession, source: str, kind: SourceType | str | None = None, config: IngestorConfig | None = None, **options) -> DataFrame:
    """The source as a DataFrame with NaN nulled. Options are those of the kind's reader. SQL and REST need config.experimental_sources. Any failure is an IngestionError."""
    config = config or IngestorConfig()
    try:
        kind = SourceType(kind) if kind else sniff.source_type(source)
        if kind in (SourceType.SQL, SourceType.REST) and not config.experimental_sources:
            raise IngestionError(f"{kind.value} sources are experimental and not enabled")
        if kind is SourceType.CSV:
            df = read_csv(spark, source, options.get("delimiter"), options.get("encoding"), config)
        elif kind is SourceType.PARQUET:
            df = spark.read.parquet(source)
        elif kind is SourceType.JSON:
            df = read_json(spark, source)
        elif kind is SourceType.EXCEL:
            df = read_excel(spark, source, options.get("sheet_name", 0))
        elif kind is SourceType.SQL:
            df = read_sql(spark, source, **({"query": "", "timeout": config.sql_timeout} | options))
        else:
            df = read_rest(spark, source, **({"timeout": config.rest_timeout} | options))
        return normalize_nan(df)
    except Exception as e:
        raise IngestionError(f"Failed to ingest {source}: {e}") from e
