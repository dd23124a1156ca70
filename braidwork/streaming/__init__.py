"""Rows that keep arriving, put through the same column rules as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.transforms import apply_hint
from ..operators.rows import normalize_nan


def read_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", **options) -> DataFrame:
    """New files of a folder, as they appear, with NaN nulled."""
    return normalize_nan(spark.readStream.format(kind).schema(schema).options(**options).load(path))


def harmonize(stream: DataFrame, column_map: dict[str, str], hints: dict[str, str]) -> DataFrame:
    """Apply unit conversions (by column) and then rename columns; casts that must look at all rows are not for streams."""
    for column, hint in hints.items():
        if hint.endswith("->integer"):
            raise ValueError("a cast to integer looks at all rows first; cast to float on a stream")
        stream = apply_hint(stream, column, hint)
    return stream.withColumnsRenamed(column_map)
