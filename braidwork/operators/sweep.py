"""Nearest neighbours by a cost that grows with the distance in one coordinate, without comparing all pairs.

Both sides are dealt by (key, coordinate) in ranges and given their places among the right points. Each left point looks at the
right points next to it on both sides, by an equi-join on places, then at more of them, until nothing beyond what it has seen
can be as good as its k-th best. Only left points that still look go into the next round. No key and no coordinate, however
common, is one task's: the ranges are cut by id as well, and a place is held by one right point.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

#: Places a left point looks at in one round at most, on each side.
WIDEST = 4096


def placed(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, v, kind, lid, rid, x, y, upto): left points (kind 1) and right points (kind 0) with the number of right points up to
    them in order of (key, v, rid); those of the same coordinate count."""
    from pyspark.sql import Window as W

    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    both = right.select("key", "v", F.lit(0).alias("kind"), none(left, "lid").alias("lid"), "rid", none(left, "x").alias("x"), "y")
    both = both.unionByName(left.select("key", "v", F.lit(1).alias("kind"), "lid", none(right, "rid").alias("rid"), "x", none(right, "y").alias("y")))
    order = ["key", "v", "kind", "rid", "lid"]
    dealt = checkpoint(both.repartitionByRange(*order).withColumn("p", F.spark_partition_id()))
    before, rows = 0, []
    for r in sorted(dealt.groupBy("p").agg(F.count_if(F.col("kind") == 0).alias("n")).collect()):  # a row per task
        rows.append((r.p, before))
        before += r.n
    offset = dealt.sparkSession.createDataFrame(rows, "p int, o bigint")
    here = F.sum(1 - F.col("kind")).over(W.partitionBy("p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return dealt.withColumn("here", here).join(F.broadcast(offset), "p").withColumn("upto", F.col("here") + F.col("o")).drop("p", "o", "here")


def nearest(left: DataFrame, right: DataFrame, cost: Callable[[Column, Column], Column], least: Callable[[Column, Column, Column], Column], k: int = 1, limit: float = float("inf"), seen: Callable[[int], None] | None = None) -> DataFrame:
    """(lid, best): the k right points of the same key with the least cost below limit, as an array of structs (cost, rid, y), in
    order of cost, then rid. Left points without any are left out.

    left has key, v, lid, x and right has key, v, rid, y; x and y are what cost(x, y) needs (null: no candidate), and
    least(x, v, edge) says what anything at the coordinate edge or beyond it costs at least. Keys and coordinates are not
    null, ids are unique. seen is told how many pairs each round looked at.
    """
    found = placed(left, right)
    points = checkpoint(found.where("kind = 0").select((F.col("upto") - 1).alias("place"), F.col("key").alias("__key"), F.col("v").alias("edge"), "rid", "y"))
    kind = points.select(F.struct(F.lit(0.0).alias("cost"), "rid", "y").alias("b")).schema["b"].dataType.simpleString()
    state = found.where("kind = 1").select("key", "v", "lid", "x", F.col("upto").alias("c"), F.expr(f"cast(array() as array<{kind}>)").alias("best"), F.lit(True).alias("down"), F.lit(True).alias("up"))
    state = checkpoint(state)
    low, high, done = 0, k + 1, None
    while True:
        below = F.when(F.col("down"), F.sequence(F.col("c") - 1 - low, F.col("c") - high))
        above = F.when(F.col("up"), F.sequence(F.col("c") + low, F.col("c") + high - 1))
        each = state.select("lid", "key", "x", "c", F.explode(F.concat(*[F.coalesce(s, F.array().cast("array<bigint>")) for s in (below, above)])).alias("place")).where("place >= 0")
        pairs = each.join(points, "place").where(F.col("key") == F.col("__key")).withColumn("cost", cost(F.col("x"), F.col("y")))
        took = F.when(F.col("cost") < limit, F.struct("cost", "rid", "y"))
        best = F.min(took).alias("new") if k == 1 else F.slice(F.array_sort(F.collect_list(took)), 1, k).alias("new")
        down, up = F.col("place") < F.col("c"), F.col("place") >= F.col("c")
        # a side is at its end if it saw fewer points than it looked for
        round_ = pairs.groupBy("lid").agg(best, F.min(F.when(down, F.col("edge"))).alias("a"), F.max(F.when(up, F.col("edge"))).alias("b"), F.count_if(down).alias("n_down"), F.count_if(up).alias("n_up"))
        new = F.when(F.col("new").isNotNull(), F.array("new")) if k == 1 else F.col("new")
        merged = F.slice(F.array_sort(F.concat("best", F.coalesce(new, F.expr(f"cast(array() as array<{kind}>)")))), 1, k)
        step = state.join(round_, "lid", "left").withColumn("best", merged)
        worst = F.when(F.size("best") == k, F.element_at("best", -1)["cost"]).otherwise(F.lit(1e300))
        worth = lambda edge: (least(F.col("x"), F.col("v"), F.col(edge)) <= worst + 1e-9 * F.abs(worst) + 1e-12) & (least(F.col("x"), F.col("v"), F.col(edge)) < limit)  # noqa: B023,E731
        step = step.withColumn("down", F.coalesce(F.col("down") & (F.col("n_down") == high - low) & worth("a"), F.lit(False))).withColumn("up", F.coalesce(F.col("up") & (F.col("n_up") == high - low) & worth("b"), F.lit(False)))
        if seen is not None:
            seen(pairs.count())
        step = checkpoint(step.select(*state.columns))
        over = step.where(~F.col("down") & ~F.col("up") & (F.size("best") > 0)).select("lid", "best")
        done = over if done is None else done.unionByName(over)
        state = step.where(F.col("down") | F.col("up"))
        if not state.limit(1).count():
            return done
        low, high = high, high + min(4 * high, WIDEST)
