"""Column profiles: counts, null and distinct ratios, samples, logical types.

Distinct counts are taken from an unpivoted frame in an aggregate of their own: one aggregate with a count_distinct per
column would expand every row once per column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.transforms import to_datetime
from ..types import DataType, data_type_of

_NESTED = (T.StructType, T.ArrayType, T.MapType)


def as_text(df: DataFrame, columns: list[str]) -> list:
    return [(F.to_json(c) if isinstance(df.schema[c].dataType, _NESTED) else F.col(c).cast("string")).alias(c) for c in columns]


def unpivoted(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field_name, value as text), a row per cell."""
    text = df.select(*as_text(df, columns))
    return text.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(f"`{c}`").alias("value")) for c in columns])).alias("c")).select("c.*")


def counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row per column: field_name, row_count, null_count, distinct_count, null_ratio, unique_ratio (0 for no rows)."""
    columns = columns or [c for c in df.columns if c != "__row_id"]
    one = df.agg(F.count("*").alias("__rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in columns])
    wide = one.select(F.col("__rows").alias("row_count"), F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(f"`{c}`").alias("n")) for c in columns])).alias("c")).select("row_count", "c.*")
    distinct = unpivoted(df, columns).where("value IS NOT NULL").distinct().groupBy("field_name").agg(F.count("*").alias("d"))
    ratio = lambda n: F.coalesce(F.try_divide(n.cast("double"), F.col("row_count")), F.lit(0.0))
    return (
        wide.join(F.broadcast(distinct), "field_name", "left")  # a row per column
        .select("field_name", "row_count", (F.col("row_count") - F.col("n")).alias("null_count"), F.coalesce("d", F.lit(0)).alias("distinct_count"))
        .withColumns({"null_ratio": ratio(F.col("null_count")), "unique_ratio": ratio(F.col("distinct_count"))})
    )


def samples(df: DataFrame, n: int = 20, order: str = "__row_id") -> DataFrame:
    """(field_name, samples): the first n non-null values of every column, as text, in row order.

    One scan for all columns: a task keeps the first n values of each, and these heads are merged by column.
    """
    from pyspark.sql import Window as W

    columns = [c for c in df.columns if c != order]
    if not columns:
        return df.sparkSession.createDataFrame([], "field_name string, samples array<string>")

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list[list[tuple[int, str]]] = [[] for _ in columns]
        for b in batches:
            at = b.column(0).to_numpy(zero_copy_only=False)
            for i, kept in enumerate(first):
                there = np.flatnonzero(b.column(1 + i).is_valid().to_numpy(zero_copy_only=False))
                if len(kept) == n:
                    there = there[at[there] < kept[-1][0]]
                there = there[np.argsort(at[there], kind="stable")[:n]]
                if len(there):
                    kept.extend(zip(at[there].tolist(), b.column(1 + i).take(pa.array(there)).to_pylist()))
                    kept.sort(key=lambda x: x[0])
                    del kept[n:]
        rows = [(i, o, v) for i, kept in enumerate(first) for o, v in kept]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.string()))], names=["c", "o", "v"])

    text = df.where(F.col(order).isNotNull()).select(F.col(order).cast("bigint").alias("__o"), *as_text(df, columns))
    heads = text.mapInArrow(head, "c int, o bigint, v string")
    kept = heads.withColumn("place", F.row_number().over(W.partitionBy("c").orderBy("o"))).where(F.col("place") <= n)
    rows = kept.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda s: s["v"]).alias("samples"))
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "c int, field_name string")
    return F.broadcast(names).join(rows, "c", "left").select("field_name", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def infer_types(df: DataFrame, order: str = "__row_id") -> dict[str, DataType]:
    """Logical types; a string column is a datetime if its first ten non-null values all parse (or there are none)."""
    out = {f.name: data_type_of(f.dataType) for f in df.schema.fields if f.name != order}
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != order]
    if text:
        heads = samples(df.select(order, *text), 10, order)
        for r in heads.select("field_name", F.forall("samples", lambda v: to_datetime(v).isNotNull()).alias("ok")).collect():
            if r.ok:
                out[r.field_name] = DataType.DATETIME
    return out


def content_hash(df: DataFrame) -> DataFrame:
    """One row, `digest`: SHA-256 over the rows' distinct SHA-256s in order, each with the number of its rows.

    Column order and row order don't matter; repeated rows do, and are counted before anything is gathered. Digests are
    put together in groups by their first four hex digits (65,536 at most) and the groups' digests then once more."""
    counted = row_hash(df).groupBy("row_sha256").count()
    line = F.concat("row_sha256", F.lit(":"), F.col("count").cast("string"))
    fine = counted.groupBy(F.substring("row_sha256", 1, 4).alias("a")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256).alias("h"))
    return fine.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "h"))), lambda s: F.concat(s["a"], s["h"])), ""), 256).alias("digest"))


def row_hash(df: DataFrame) -> DataFrame:
    """`row_sha256` per row: values in order of column names, joined by U+001F, null as U+0000."""
    columns = sorted(c for c in df.columns if c != "__row_id")
    parts = [F.coalesce(c, F.lit("\x00")) for c in as_text(df, columns)]
    return df.select(F.sha2(F.concat_ws("\x1f", *parts), 256).alias("row_sha256"))
