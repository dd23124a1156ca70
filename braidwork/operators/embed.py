"""Embeddings of a table's texts by a provider, called once for each distinct text and kept in a table.

The table is a folder of Parquet with (text, embedding). Texts that are not in it yet are dealt out a call's worth to a task; a
task calls the provider once, again after a failure, and writes what it got. So a lost task repeats its own call alone, and
a later run calls for new texts only. Two runs at a time on one table may both call for a text; its embedding is then kept twice
and read once.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine

_SCHEMA = "text string, embedding array<double>"


def call(provider, texts: list[str], retries: int, wait: float) -> list[list[float]]:
    """The provider's answer, asked for again after a failure, each time after twice the wait; its number must fit."""
    for attempt in range(retries + 1):
        try:
            got = provider.embed(texts)
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} embeddings of {len(texts)} texts")
            return got
        except Exception:
            if attempt == retries:
                raise
            time.sleep(wait * 2**attempt)
    raise AssertionError


def _kept(spark: SparkSession, table: str) -> DataFrame:
    try:
        return spark.read.schema(_SCHEMA).parquet(table)
    except AnalysisException:  # not there yet
        return spark.createDataFrame([], _SCHEMA)


def remember(texts: DataFrame, provider, table: str, batch: int = 100, retries: int = 3, wait: float = 0.5, calls_per_second: float | None = None, at_once: int = 1) -> DataFrame:
    """(text, embedding) of all distinct texts (column text) that are not null or blank, from the table at a path, to which those
    that it lacks are added. calls_per_second bounds the calls of all tasks together, if at_once of them run at a time.
    """
    spark = texts.sparkSession
    asked = texts.select("text").where(F.col("text").rlike(r"\S")).distinct()
    new = asked.join(_kept(spark, table).select("text"), "text", "left_anti")
    n = new.count()
    if n:
        pause = at_once / calls_per_second if calls_per_second else 0.0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, batch):
                    began = time.monotonic()
                    part = b.column(0).slice(i, batch)
                    got = call(provider, part.to_pylist(), retries, wait)
                    yield pa.RecordBatch.from_arrays([part, pa.array([[float(x) for x in v] for v in got], pa.list_(pa.float64()))], names=["text", "embedding"])
                    time.sleep(max(0.0, began + pause - time.monotonic()))

        new.repartition(math.ceil(n / batch)).mapInArrow(run, _SCHEMA).write.mode("append").parquet(table)
    return _kept(spark, table).join(asked, "text", "left_semi").dropDuplicates(["text"])


def embedded(df: DataFrame, column: str, provider, table: str, out: str = "embedding", dimensions: int | None = None, **how) -> DataFrame:
    """df with the embeddings of a column's texts; a null or blank text gets null, or zeros if dimensions are given. Rows and
    their other columns stay as they are."""
    known = remember(df.select(F.col(f"`{column}`").cast("string").alias("text")), provider, table, **how).select(F.col("text").alias("__text"), F.col("embedding").alias("__embedding"))
    joined = df.drop(out).join(known, F.col(f"`{column}`").cast("string") == F.col("__text"), "left")
    vector = F.col("__embedding") if dimensions is None else F.coalesce("__embedding", F.array_repeat(F.lit(0.0), dimensions))
    return joined.withColumn(out, vector).drop("__text", "__embedding")


def semantic_similarity(df: DataFrame, a: str, b: str, provider, table: str, out: str = "similarity", **how) -> DataFrame:
    """df with the cosine of the embeddings of two columns' texts; null where one is null, blank or a zero vector."""
    text = lambda c: F.col(f"`{c}`").cast("string").alias("text")
    known = remember(df.select(text(a)).unionByName(df.select(text(b))), provider, table, **how)
    side = lambda name: known.select(F.col("text").alias(f"__t{name}"), F.col("embedding").alias(f"__v{name}"))
    same = lambda c, name: F.col(f"`{c}`").cast("string") == F.col(f"__t{name}")
    near: Column = cosine(F.col("__va"), F.col("__vb"))
    return df.join(side("a"), same(a, "a"), "left").join(side("b"), same(b, "b"), "left").withColumn(out, near).drop("__ta", "__va", "__tb", "__vb")
