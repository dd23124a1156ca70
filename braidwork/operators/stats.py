"""Descriptive statistics, correlations with p-values, and interquartile-range outliers."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from ..types import numeric_columns
from .profile import unpivoted
from .rows import brackets, quantiles, ranks, value_counts

_SCHEMA = "field_a string, field_b string, n bigint, coefficient double, p_value double"


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row per numeric column with values: count, mean, std (sample; 0 for one value), min, quartiles, max, null and unique counts."""
    columns = columns or numeric_columns(df.schema)
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])).alias("c")).select("c.*")
    shares = [0.25, 0.5, 0.75]
    main = checkpoint(
        cells.groupBy("field_name").agg(
            F.count("v").alias("count"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"), F.min("v").alias("min"),
            F.max("v").alias("max"), (F.count("*") - F.count("v")).alias("null_count"), brackets(shares).alias("b"),
        )
    )
    unique = value_counts(cells).groupBy("field_name").agg(F.count("*").alias("unique_count"))
    q = quantiles(cells, shares, {r.field_name: (r["count"], r.b) for r in main.collect()})  # all three have a row per column
    return main.where(F.col("count") > 0).join(F.broadcast(unique), "field_name").join(F.broadcast(q), "field_name").select(
        "field_name", "count", "mean", "std", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max", "null_count", "unique_count"
    )


def _beta_cf(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a correlation by Student's t with n - 2 degrees of freedom."""
    if n < 3:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    return incomplete_beta(df / 2, 0.5, df / (df + t2))


def _pearson(df: DataFrame, pairs: list[tuple[str, str]]) -> list[tuple[str, str, int, float]]:
    """All pairs in one aggregate; pairs with fewer than 3 rows or a constant side are left out."""
    if not pairs:
        return []
    out = []
    for i in range(0, len(pairs), 200):
        exprs = []
        for k, (a, b) in enumerate(pairs[i : i + 200]):
            x, y = F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")
            both = x.isNotNull() & y.isNotNull()
            x, y = F.when(both, x), F.when(both, y)
            exprs += [F.count(x).alias(f"n{k}"), F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).alias(f"r{k}")]
        got = df.agg(*exprs).first()
        out += [(a, b, got[f"n{k}"], got[f"r{k}"]) for k, (a, b) in enumerate(pairs[i : i + 200]) if got[f"n{k}"] >= 3 and got[f"r{k}"] is not None]
    return out


def _whole_ranks(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(row, x0, x1, ...): the ranks of columns without nulls, all of them dealt together."""
    cells = df.select(F.col(order).alias("row"), F.explode(F.array(*[F.struct(F.lit(i).alias("key"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(columns)])).alias("c")).select("row", "c.*")
    ranked = ranks(cells.groupBy("key", "v").agg(F.count("*").alias("n")))
    return cells.join(ranked, ["key", "v"]).groupBy("row").agg(*[F.max(F.when(F.col("key") == i, F.col("rank"))).alias(f"x{i}") for i in range(len(columns))])


def _paired_ranks(df: DataFrame, pairs: list[tuple[str, str]]) -> list[tuple[str, str, int, float]]:
    """Rank correlations of pairs whose rows differ: distinct pairs of values are counted, both sides of all pairs ranked together,
    and the sums taken by pair. Mean ranks are (n + 1) / 2. Pairs with fewer than 3 rows or a constant side are left out."""
    if not pairs:
        return []
    value = lambda c: F.col(f"`{c}`").cast("double")
    each = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), value(a).alias("x"), value(b).alias("y")) for k, (a, b) in enumerate(pairs)])).alias("c")).select("c.*")
    met = checkpoint(each.where("x IS NOT NULL AND y IS NOT NULL").groupBy("k", "x", "y").agg(F.count("*").alias("n")))
    sides = met.select((2 * F.col("k")).alias("key"), F.col("x").alias("v"), "n").unionByName(met.select((2 * F.col("k") + 1).alias("key"), F.col("y").alias("v"), "n"))
    ranked = checkpoint(ranks(sides.groupBy("key", "v").agg(F.sum("n").alias("n"))))
    side = lambda s, v, name: ranked.where(F.col("key") % 2 == s).select(F.expr("key div 2").cast("int").alias("k"), F.col("v").alias(v), F.col("rank").alias(name))
    total = F.broadcast(met.groupBy("k").agg(F.sum("n").alias("total")))  # a row per pair
    both = met.join(side(0, "x", "p"), ["k", "x"]).join(side(1, "y", "q"), ["k", "y"]).join(total, "k")
    p, q = F.col("p") - (F.col("total") + 1) / 2, F.col("q") - (F.col("total") + 1) / 2
    sums = both.groupBy("k").agg(F.max("total").alias("total"), *[F.sum(F.col("n") * x).alias(name) for x, name in ((p * q, "pq"), (p * p, "pp"), (q * q, "qq"))]).collect()  # a row per pair
    return [(*pairs[r.k], r.total, r.pq / math.sqrt(r.pp * r.qq)) for r in sums if r.total >= 3 and r.pp and r.qq]


def correlations(df: DataFrame, method: str = "pearson", threshold: float = 0.5, columns: list[str] | None = None, order: str = "__row_id") -> DataFrame:
    """(field_a, field_b, n, coefficient, p_value) of pairs with |coefficient| >= threshold, the strongest first."""
    columns = columns or numeric_columns(df.schema)
    pairs = list(combinations(columns, 2))
    if method == "spearman":
        known = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns]).first()
        whole = [c for c in columns if not known[c]]
        found = {}
        if len(whole) > 1:  # these are ranked once, whatever they are paired with
            at = {f"x{i}": c for i, c in enumerate(whole)}
            found = {(at[a], at[b]): (n, r) for a, b, n, r in _pearson(checkpoint(_whole_ranks(df, whole, order)), list(combinations(at, 2)))}
        found |= {(a, b): (n, r) for a, b, n, r in _paired_ranks(df, [p for p in pairs if not {*p} <= {*whole}])}
        found = [(a, b, *found[a, b]) for a, b in pairs if (a, b) in found]
    elif method == "pearson":
        found = _pearson(df, pairs)
    else:
        raise ValueError(f"Unknown correlation method: {method}")
    rows = [(a, b, n, round(r, 6), round(correlation_p(r, n), 6)) for a, b, n, r in found if abs(r) >= threshold]
    rows.sort(key=lambda x: -abs(x[3]))
    return df.sparkSession.createDataFrame(rows, _SCHEMA)


def outlier_bounds(df: DataFrame, k: float = 1.5, columns: list[str] | None = None) -> DataFrame:
    """(field_name, lower_bound, upper_bound) of numeric columns with four values or more."""
    columns = columns or numeric_columns(df.schema)
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])).alias("c")).select("c.*")
    shares = [0.25, 0.75]
    got = cells.groupBy("field_name").agg(F.count("v").alias("n"), brackets(shares).alias("b")).where("n >= 4").collect()  # a row per column
    q = quantiles(cells, shares, {r.field_name: (r.n, r.b) for r in got})
    spread = (F.col("q")[1] - F.col("q")[0]) * k
    return q.select("field_name", (F.col("q")[0] - spread).alias("lower_bound"), (F.col("q")[1] + spread).alias("upper_bound"))


def outliers(df: DataFrame, k: float = 1.5, columns: list[str] | None = None, order: str = "__row_id") -> DataFrame:
    """(field_name, row, value, lower_bound, upper_bound) of values strictly beyond the bounds."""
    columns = columns or numeric_columns(df.schema)
    cells = df.select(F.col(order).alias("row"), F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])).alias("c")).select("row", "c.*")
    b = outlier_bounds(df, k, columns)  # a row per column
    return cells.join(F.broadcast(b), "field_name").where("value < lower_bound OR value > upper_bound")


def outlier_report(df: DataFrame, k: float = 1.5, columns: list[str] | None = None, order: str = "__row_id") -> DataFrame:
    """A row per column that has outliers: count and bounds, rounded."""
    return outliers(df, k, columns, order).groupBy("field_name").agg(F.count("*").alias("outlier_count"), F.round(F.first("lower_bound"), 6).alias("lower_bound"), F.round(F.first("upper_bound"), 6).alias("upper_bound"))


__all__ = ["correlations", "describe", "outlier_bounds", "outlier_report", "outliers", "unpivoted"]
