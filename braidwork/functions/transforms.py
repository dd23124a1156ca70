"""Unit transforms, safe casts, and the log of what they did."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name -> (Column -> Column). The factors are fixed values.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "celsius_to_fahrenheit": lambda v: v * 9 / 5 + 32,
    "fahrenheit_to_celsius": lambda v: (v - 32) * 5 / 9,
    "kg_to_lb": lambda v: v * 2.20462,
    "lb_to_kg": lambda v: v / 2.20462,
    "m_to_ft": lambda v: v * 3.28084,
    "ft_to_m": lambda v: v / 3.28084,
    "days_to_months": lambda v: v / 30.44,
    "months_to_days": lambda v: v * 30.44,
}

_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy")

_LOG = "field string, operation string, template string, sample_before string, sample_after string, records_affected bigint"


def register_transform(name: str, fn: Callable[[Column], Column] | str, field: str = "value") -> None:
    """Add a transform; a formula string is arithmetic over `field`."""
    if isinstance(fn, str):
        TRANSFORMS[name] = lambda v: _bound(fn, field, v)
    else:
        TRANSFORMS[name] = fn


def _bound(formula: str, field: str, x: Column) -> Column:
    import ast

    def walk(n: ast.AST) -> Column:
        if isinstance(n, ast.BinOp):
            a, b = walk(n.left), walk(n.right)
            return {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: F.try_divide(a, b)}[type(n.op)]()
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            return -walk(n.operand)
        if isinstance(n, ast.Name) and n.id == field:
            return x
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)):
            return F.lit(float(n.value))
        raise ValueError(f"formula may only use numbers, + - * / and {field}")

    return walk(ast.parse(formula, mode="eval").body)


def unit(name: str, v: Column) -> Column:
    """The named transform of a column as double; nulls stay. A name ending in _inverse is the opposite transform."""
    return TRANSFORMS[resolve(name)](v.cast("double"))


def resolve(name: str) -> str:
    if name.endswith("_inverse"):
        a, _, b = name.removesuffix("_inverse").partition("_to_")
        name = f"{b}_to_{a}"
    if name not in TRANSFORMS:
        raise ValueError(f"Unknown transform: {name}")
    return name


def to_float(v: Column) -> Column:
    """Null where the text is no number."""
    return F.trim(v.cast("string")).try_cast("double")


def to_integer(v: Column) -> Column:
    """Null where the text is no whole number; see cast() for the rule that a column with fractions stays."""
    return to_float(v).try_cast("bigint")


def to_datetime(v: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(v.cast("string"), F.lit(f)) for f in _FORMATS])


def cast(df: DataFrame, column: str, to: str) -> DataFrame:
    """df with the column cast; a cast to integer that would cut fractions leaves it as it is; unknown targets too."""
    v = F.col(column)
    if to == "float":
        return df.withColumn(column, to_float(v))
    if to == "integer":
        f = to_float(v)
        if df.where(f.isNotNull() & (f != F.floor(f))).limit(1).count():
            return df
        return df.withColumn(column, to_integer(v))
    if to == "string":
        return df.withColumn(column, v.cast("string"))
    if to == "datetime":
        return df.withColumn(column, to_datetime(v))
    return df


def apply_hint(df: DataFrame, column: str, hint: str) -> DataFrame:
    """Apply a `unit_conversion:name` or `type_cast:a->b` hint to a column; an absent column leaves df as it is."""
    kind, _, what = hint.partition(":")
    if column not in df.columns:
        return df
    if kind == "unit_conversion":
        return df.withColumn(column, unit(what, F.col(column)))
    if kind == "type_cast":
        return cast(df, column, what.partition("->")[2])
    return df


def applied(df: DataFrame, hints: list[tuple[str, str]], order: str) -> tuple[DataFrame, DataFrame]:
    """df with (column, hint) pairs applied in turn, and a row for each that changed something, all from one pass over df.

    A row has field, operation, template, the first value before and after (in the order of column `order`), and the values
    affected: non-null ones for units, all rows for casts.
    """
    names, traced, aggregates, rows = df.columns, df, [], []
    for i, (column, hint) in enumerate(hints):
        held = traced.withColumn(f"__was{i}", F.col(column)) if column in names else traced
        after = apply_hint(held, column, hint)
        if after is held:
            continue
        traced = after.withColumn(f"__is{i}", F.col(column))
        kind, _, what = hint.partition(":")
        first = lambda c: F.min_by(F.col(c).cast("string"), F.when(F.col(c).isNotNull(), F.col(order)))
        aggregates += [first(f"__was{i}").alias(f"b{i}"), first(f"__is{i}").alias(f"a{i}"), F.count(f"__was{i}" if kind == "unit_conversion" else F.lit(1)).alias(f"n{i}")]
        rows.append(F.struct(F.lit(column).alias("field"), F.lit(kind).alias("operation"), F.lit(what).alias("template"), F.col(f"b{i}").alias("sample_before"), F.col(f"a{i}").alias("sample_after"), F.col(f"n{i}").alias("records_affected")))
    if not rows:
        return df, df.sparkSession.createDataFrame([], _LOG)
    return traced.select(*[F.col(f"`{c}`") for c in names]), traced.agg(*aggregates).select(F.inline(F.array(*rows)))
