"""Vectors as array columns: cosine, distance, normalising, averages, top-k, and a deterministic embedding."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where sizes differ or a vector is zero."""
    return F.when(F.size(a) == F.size(b), F.try_divide(_dot(a, b), norm(a) * norm(b)))


def euclidean(a: Column, b: Column) -> Column:
    d = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    return F.when(F.size(a) == F.size(b), F.sqrt(d))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def average(df: DataFrame, vector: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """One row per group with `average`: the element-wise mean, weighted if a column is given. Sizes must be equal."""
    by = by or []
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    each = df.where(F.col(vector).isNotNull()).select(*by, w.alias("__w"), F.posexplode(vector).alias("__pos", "__x"))
    mean = each.groupBy(*by, "__pos").agg((F.sum(F.col("__x").cast("double") * F.col("__w")) / F.sum("__w")).alias("__m"))
    rows = mean.groupBy(*by) if by else mean.groupBy()
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__m"))), lambda s: s["__m"]).alias("average"))


def _plus(weight: float):
    return lambda x, y: x + y.cast("double") * weight


def combine(vectors: list[Column], weights: list[float]) -> Column:
    """Weighted sum of equally long vectors; the weights must sum to one."""
    if len(vectors) != len(weights) or not vectors:
        raise ValueError("one weight per vector is needed")
    if abs(sum(weights) - 1.0) > 1e-5:
        raise ValueError("weights must sum to 1")
    out = F.transform(vectors[0], lambda x: x.cast("double") * weights[0])
    for v, w in zip(vectors[1:], weights[1:]):
        out = F.zip_with(out, v, _plus(w))
    return out


def find_similar(query: list[float], corpus: DataFrame, vector: str, id_col: str, top_k: int = 5, threshold: float | None = None) -> DataFrame:
    """The top_k rows by cosine with the query, ties by id; zero vectors and other sizes are skipped."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = corpus.select(id_col, cosine(F.col(vector), q).alias("similarity")).where("similarity IS NOT NULL")
    if threshold is not None:
        rows = rows.where(F.col("similarity") >= threshold)
    return rows.orderBy(F.desc("similarity"), id_col).limit(top_k)


def tokens(text: str) -> list[str]:
    for c in "_-:,.":
        text = text.replace(c, " ")
    return text.lower().split()


def embed(text: str, dimensions: int = 1536) -> np.ndarray:
    """Normalised sum of a fixed random unit vector per word; zeros without words."""
    out = np.zeros(dimensions)
    for word in tokens(text):
        seed = int.from_bytes(hashlib.md5(word.encode()).digest(), "big") % (1 << 32)
        v = np.random.RandomState(seed).randn(dimensions)
        out += v / np.linalg.norm(v)
    size = np.linalg.norm(out)
    return out / size if size > 0 else out


def embedding(text: Column, dimensions: int = 1536) -> Column:
    def run(s: pd.Series) -> pd.Series:
        known: dict[str, list[float]] = {}
        return pd.Series([known.setdefault(t, embed(t or "", dimensions).tolist()) if t not in known else known[t] for t in s])

    return F.pandas_udf(run, "array<double>")(text)
