"""Filling nulls of numeric columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from ..types import ImputationMethod, numeric_columns
from .rows import quantiles, value_counts
from .sweep import nearest


@dataclass
class ImputationSummary:
    method_used: str
    total_nulls_filled: int = 0
    fields_imputed: dict[str, int] = field(default_factory=dict)


def eligible(df: DataFrame, max_null_ratio: float = 0.5) -> dict[str, int]:
    """Null counts of the numeric columns whose null ratio is above 0 and at most max_null_ratio."""
    columns = numeric_columns(df.schema)
    if not columns:
        return {}
    got = df.agg(F.count("*").alias("__n"), *[F.count(F.col(f"`{c}`")).alias(c) for c in columns]).first()
    n = got["__n"]
    return {c: n - got[c] for c in columns if n and 0 < (n - got[c]) / n <= max_null_ratio}


def fill_values(df: DataFrame, columns: list[str], method: ImputationMethod) -> dict[str, float]:
    """Mean, interpolated median or smallest mode of each column; the latter two from counts of distinct values."""
    if method == ImputationMethod.MEAN:
        got = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(c) for c in columns]).first()
        return {c: got[c] for c in columns if got[c] is not None}
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])).alias("c")).select("c.*")
    if method == ImputationMethod.MEDIAN:
        return {r.field_name: r.q[0] for r in quantiles(cells, [0.5]).collect()}
    if method != ImputationMethod.MODE:
        raise KeyError(method)
    most = value_counts(cells).groupBy("field_name").agg(F.max(F.struct("n", (-F.col("v")).alias("less"))).alias("m"))
    return {r.field_name: 0.0 - r.m.less for r in most.collect()}


def knn(df: DataFrame, columns: list[str], k: int = 5, order: str = "__row_id") -> DataFrame:
    """Each null becomes the mean of the k nearest rows that have the value, by nan-Euclidean distance over `columns`.

    Distance is sqrt(columns / present * sum of squares over what both have); without any, the column's mean is taken.
    Ties go to the lower row id. Rows with a null meet the rows of each combination of missing columns, by the columns both
    have: rows that agree in these are one point, which stands for its k lowest ids, and points are looked at in order of
    the column that spreads most, until its difference alone is over the k-th distance. So the work grows with the combinations
    of missing columns and with the neighbours, not with the square of the rows.
    """
    from pyspark.sql import Window as W

    n = len(columns)
    got = df.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{x}{i}") for i, c in enumerate(columns) for x, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    means, spread = {c: got[f"m{i}"] for i, c in enumerate(columns)}, [got[f"s{i}"] or 0.0 for i in range(n)]
    values = [F.col(f"`{c}`").cast("double") for c in columns]
    rows = checkpoint(df.select(F.col(order).alias("id"), F.array(*values).alias("v"), F.concat(*[F.when(v.isNull(), "0").otherwise("1") for v in values]).alias("has")))
    kinds = sorted(r.has for r in rows.select("has").distinct().collect())  # a row per combination of missing columns
    meets = []
    for q in kinds:
        for d in kinds:
            both = "".join("1" if x == y == "1" else "0" for x, y in zip(q, d))
            if "1" in both and any(x == "0" and y == "1" for x, y in zip(q, d)):
                meets.append((q, d, both, max((i for i in range(n) if both[i] == "1"), key=lambda i: spread[i]), both.count("1")))
    spark = df.sparkSession
    meet = F.broadcast(spark.createDataFrame(meets, "q string, d string, both string, at int, m int"))
    part = F.transform("v", lambda x, i: F.when(F.substr("both", i + 1, F.lit(1)) == "1", x))
    point = lambda pairs, kind: rows.join(pairs, F.col("has") == F.col(kind)).select("id", "v", F.concat_ws("|", "d", "both").alias("key"), part.alias("c"), "at", "m").withColumn("name", F.array_join(F.col("c").cast("array<string>"), ",", "-"))
    asks = checkpoint(point(meet.select("q", "d", "both", "at", "m"), "q").where(F.col("id").isNotNull()))
    gives = point(meet.select("d", "both", "at", "m").distinct(), "d")
    near = W.partitionBy("key", "name")
    few = checkpoint(gives.withColumn("place", F.row_number().over(near.orderBy("id"))).where(F.col("place") <= k))
    first = few.where("place = 1").select("key", "name", F.col("id").alias("rid"), "c", "at")
    points = first.select("key", F.get("c", F.col("at")).alias("v"), F.struct("key", "rid").alias("rid"), F.struct("c").alias("y"))
    queries = asks.groupBy("key", "name", "c", "at", "m").agg(F.min("id").alias("i")).select("key", F.get("c", F.col("at")).alias("v"), F.struct("key", "i").alias("lid"), F.struct("c", "m").alias("x"))
    total = lambda x, y: F.aggregate(F.zip_with(x["c"], y["c"], lambda a, b: F.coalesce((a - b) * (a - b), F.lit(0.0))), F.lit(0.0), lambda s, t: s + t)
    found = nearest(queries, points, lambda x, y: F.sqrt(total(x, y) * n / x["m"]), lambda x, v, edge: F.sqrt((v - edge) * (v - edge) * n / x["m"]), k)
    named = asks.groupBy("key", "name").agg(F.min("id").alias("i"))
    each = found.select("lid.key", "lid.i", F.explode("best").alias("b")).select("key", "i", "b.cost", F.col("b.rid.rid").alias("rid"))
    donors = few.join(first.select("key", "name", "rid"), ["key", "name"]).select("key", "rid", F.col("id").alias("donor"), F.col("v").alias("given"))
    ranked = each.join(donors, ["key", "rid"]).join(named, ["key", "i"]).select("key", "name", "cost", "donor", "given")
    cells = asks.join(ranked, ["key", "name"]).select("id", "cost", "donor", F.posexplode(F.zip_with("v", "given", lambda own, v: F.when(own.isNull(), v))).alias("i", "x")).where("x IS NOT NULL")
    best = cells.withColumn("place", F.row_number().over(W.partitionBy("id", "i").orderBy("cost", "donor"))).where(F.col("place") <= k)
    wide = best.groupBy(F.col("id").alias("__q")).agg(*[F.avg(F.when(F.col("i") == i, F.col("x"))).alias(f"__f{i}") for i in range(n)])
    joined = df.join(wide, F.col(order) == F.col("__q"), "left")
    out = {c: F.coalesce(F.col(f"`{c}`").cast("double"), F.col(f"__f{i}"), F.lit(means.get(c))) for i, c in enumerate(columns)}
    return joined.withColumns(out).drop("__q", *[f"__f{i}" for i in range(n)])


def impute(df: DataFrame, method: ImputationMethod | str = "mean", max_null_ratio: float = 0.5, k: int = 5, order: str = "__row_id") -> tuple[DataFrame, ImputationSummary]:
    """df with nulls filled, and what was; `model` and `none` fill nothing. Filled columns are double."""
    method = ImputationMethod(method)
    columns = eligible(df, max_null_ratio)
    if not columns or method in (ImputationMethod.NONE, ImputationMethod.MODEL):
        return df, ImputationSummary(method.value)
    if method is ImputationMethod.KNN:
        out = knn(df, list(columns), k, order)
    else:
        values = fill_values(df, list(columns), method)
        out = df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(v)) for c, v in values.items()})
    return out, ImputationSummary(method.value, sum(columns.values()), dict(columns))
