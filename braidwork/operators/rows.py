"""Row identity and null rules at ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint

ROW_ID = "__row_id"


def normalize_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in float columns."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names}) if names else df


def with_row_id(df: DataFrame) -> DataFrame:
    """df with consecutive numbers from 0 in partition order, by a count per partition instead of a global sort.

    The numbered rows are written once, so that the two passes agree whatever is recomputed.
    """
    return numbered(df)[0]


def numbered(df: DataFrame) -> tuple[DataFrame, int]:
    """with_row_id(df), and the number of rows, which numbering them gives."""
    part = checkpoint(df.withColumn("__mono", F.monotonically_increasing_id()))
    place = F.shiftright("__mono", 33)
    counts = {r["p"]: r["n"] for r in part.groupBy(place.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row per partition
    total, rows = 0, []
    for p in sorted(counts):
        rows.append((p, total))
        total += counts[p]
    if not rows:
        return df.withColumn(ROW_ID, F.lit(0).cast("bigint")), 0
    offset = df.sparkSession.createDataFrame(rows, "__p bigint, __o bigint")
    placed = part.join(F.broadcast(offset), place == F.col("__p"))
    return placed.withColumn(ROW_ID, F.col("__o") + F.col("__mono").bitwiseAND((1 << 33) - 1)).drop("__mono", "__p", "__o"), total


def value_counts(cells: DataFrame) -> DataFrame:
    """(field_name, v, n): the distinct non-null values of each field and how often they occur, from a row per cell."""
    return cells.where("v IS NOT NULL").groupBy("field_name", "v").agg(F.count("*").alias("n"))


#: A sketch's error is below one in ACCURACY of the rows; a bracket reaches so many times that to either side.
ACCURACY, REACH = 10_000, 3


def brackets(shares: list[float], accuracy: int = ACCURACY) -> Column:
    """An aggregate of v: the values between which each share's quantile must lie, two for each, from one sketch."""
    at = [min(max(p + side * REACH / accuracy, 0.0), 1.0) for p in shares for side in (-1, 1)]
    return F.percentile_approx("v", at, accuracy)


def quantiles(cells: DataFrame, shares: list[float], known: dict[str, tuple[int, list[float]]] | None = None) -> DataFrame:
    """(field_name, q): exact interpolated quantiles of each field's values v, from a row per cell; fields without any are left out.

    A sketch brackets each quantile; one pass counts what lies below a bracket and the distinct values inside it, which are
    few, and the ranks are found among these. known gives each field's number of values and brackets(shares), if they were
    taken in another pass. A bracket that doesn't hold its ranks, which no sketch should give, is opened to both ends.
    """
    from pyspark.sql import Window as W

    spark, cells = cells.sparkSession, cells.where("v IS NOT NULL")
    if known is None:
        known = {r.field_name: (r.n, r.b) for r in cells.groupBy("field_name").agg(F.count("*").alias("n"), brackets(shares).alias("b")).collect()}  # a row per column
    known = {f: (n, b) for f, (n, b) in known.items() if n}
    low, high = F.floor("at"), F.ceil("at")
    closed, out = [(f, k) for f in known for k in range(len(shares))], []
    for ends in ("sketch", "open"):
        wanted = [(f, k, shares[k] * (known[f][0] - 1), *(known[f][1][2 * k : 2 * k + 2] if ends == "sketch" else (None, None))) for f, k in closed]
        if not wanted:
            break
        asked = spark.createDataFrame(wanted, "field_name string, k int, at double, lo double, hi double")
        below, above = F.coalesce(F.col("v") < F.col("lo"), F.lit(False)), F.coalesce(F.col("v") > F.col("hi"), F.lit(False))
        # what is below or above a bracket is one row each
        met = cells.join(F.broadcast(asked), "field_name").withColumn("side", F.when(below, -1).when(above, 1).otherwise(0))
        counts = checkpoint(met.groupBy("field_name", "k", "at", "side", F.when(F.col("side") == 0, F.col("v")).alias("v")).agg(F.count("*").alias("n")).where("side <= 0"))
        upto = F.sum("n").over(W.partitionBy("field_name", "k").orderBy("side", "v").rowsBetween(W.unboundedPreceding, 0))
        ranked = counts.withColumn("upto", upto)
        covers = lambda x: (F.col("side") == 0) & (x < F.col("upto")) & (x >= F.col("upto") - F.col("n"))
        value = F.when((low == high) | (F.col("a") == F.col("b")), F.col("a")).otherwise((high - F.col("at")) * F.col("a") + (F.col("at") - low) * F.col("b"))
        found = ranked.groupBy("field_name", "k", "at").agg(F.max(F.when(covers(low), F.col("v"))).alias("a"), F.max(F.when(covers(high), F.col("v"))).alias("b"))
        got = {(r.field_name, r.k): r.q for r in found.select("field_name", "k", value.alias("q")).collect()}  # a row per column and share
        out += [(f, k, q) for (f, k), q in got.items() if q is not None]
        closed = [x for x in closed if got.get(x) is None]
    rows = [(f, [q for _, _, q in sorted(x for x in out if x[0] == f)]) for f in known]
    return spark.createDataFrame(rows, "field_name string, q array<double>")


def ranks(counts: DataFrame) -> DataFrame:
    """(key, v, rank): average ranks of the values of each key, from (key, v, n), each value once with the number of its rows.

    Values of all keys are range-partitioned together and counted within partitions; a small table of totals by partition and
    key, of which there are no more than partitions and keys together, shifts them. No window spans a key.
    """
    from pyspark.sql import Window as W

    dealt = checkpoint(counts.repartitionByRange("key", "v").withColumn("p", F.spark_partition_id()))
    before, offsets = {}, []
    for r in sorted(dealt.groupBy("p", "key").agg(F.sum("n").alias("n")).collect()):
        offsets.append((r.p, r.key, before.get(r.key, 0)))
        before[r.key] = before.get(r.key, 0) + r.n
    offset = counts.sparkSession.createDataFrame(offsets, "p int, key int, o bigint")
    upto = F.col("o") + F.sum("n").over(W.partitionBy("p", "key").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    return dealt.join(F.broadcast(offset), ["p", "key"]).select("key", "v", (upto - (F.col("n") - 1) / 2).alias("rank"))
