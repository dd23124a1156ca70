"""Record joins: exact key, best match by similarity, one-to-one probabilistic, nearest in time, and their fold."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import null_rule, numeric_similarity, ratio_bound, similarity, stripped, weights_of
from ..session import checkpoint
from ..types import FusionError
from .grams import Index, normal
from .sweep import nearest

#: (left field, right field)
Pair = tuple[str, str]


def _same(left: DataFrame, right: DataFrame, a: str, b: str) -> tuple[Column, Column]:
    """__l.a and __r.b in one type: as they are if equal or both numeric, else as text."""
    x, y, s, t = F.col(f"__l.`{a}`"), F.col(f"__r.`{b}`"), left.schema[a].dataType, right.schema[b].dataType
    if s == t or (isinstance(s, T.NumericType) and isinstance(t, T.NumericType)):
        return x, y
    return x.cast("string"), y.cast("string")


#: Pairs of a key that one task makes at a time, pairs of a piece of a busier key, and right rows of such a piece.
PAIRS, PIECE, DEEP = 1 << 19, 1 << 22, 1 << 16


def _full(l_: DataFrame, r_: DataFrame, x: Column, y: Column) -> DataFrame:
    """Full outer join of __l and __r on keys, null keys matching each other.

    Spark's full outer join holds all pairs of a key before it hands on the first. So keys that make many are joined apart:
    both sides have them, so an inner join does, and their rows are cut into pieces, each of the left with each of the
    right. Rows are dealt to pieces by their values, the same whenever a task runs again; rows of equal values share a piece.
    """
    keys = l_.select(x.alias("k"), F.lit(1).alias("n"), F.lit(0).alias("m")).unionByName(r_.select(y.alias("k"), F.lit(0).alias("n"), F.lit(1).alias("m")))
    busy = keys.groupBy("k").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where(F.col("n").cast("double") * F.col("m") > PAIRS)
    found = busy.collect()  # a row per key with many pairs
    if not found:
        return l_.join(r_, x.eqNullSafe(y), "full")
    pieces = [(r.k, g, -(-r.n * min(r.m, DEEP) // PIECE), -(-r.m // DEEP)) for g, r in enumerate(found)]
    schema = T.StructType([T.StructField("__k", busy.schema["k"].dataType), *(T.StructField(c, T.IntegerType()) for c in ("__g", "__nl", "__nr"))])
    table = F.broadcast(l_.sparkSession.createDataFrame(pieces, schema))
    left, right = l_.join(table, x.eqNullSafe(F.col("__k")), "left"), r_.join(table, y.eqNullSafe(F.col("__k")), "left")
    deal = lambda row, n: F.pmod(F.xxhash64(F.col(row).cast("string")), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = left.where("__g IS NOT NULL").select("__l", "__g", deal("__l", "__nl").alias("__i"), each("__nr").alias("__j"))
    others = right.where("__g IS NOT NULL").select("__r", "__g", each("__nl").alias("__i"), deal("__r", "__nr").alias("__j"))
    piece = ["__g", "__i", "__j"]
    tasks = -(-sum(r.n * r.m for r in found) // (2 * PIECE))  # by what comes out: what goes in is small and would be put together
    apart = rows.repartition(min(tasks, 10_000), *piece).join(others.repartition(min(tasks, 10_000), *piece), piece).select("__l", "__r")
    return left.where("__g IS NULL").select("__l").join(right.where("__g IS NULL").select("__r"), x.eqNullSafe(y), "full").unionByName(apart)


def exact_merge(left: DataFrame, right: DataFrame, key: str, column_map: dict[str, str] | None = None) -> DataFrame:
    """Full outer join on one key, null keys matching each other; same-named values are coalesced, left first.

    column_map renames right columns to left ones; of several mapped to one name the first keeps it. A column that
    merely ends in `_right` is a column like any other.
    """
    seen: set[str] = set()
    names = []
    for c in right.columns:
        n = (column_map or {}).get(c, c)
        n = c if n in seen else n
        seen.add(n)
        names.append(n)
    right = right.toDF(*names)
    l_, r_ = left.select(F.struct("*").alias("__l")), right.select(F.struct("*").alias("__r"))
    x, y = _same(left, right, key, key)
    both = _full(l_, r_, x, y)
    out = [F.coalesce(*_same(left, right, c, c)).alias(c) if c in right.columns else F.col(f"__l.`{c}`").alias(c) for c in left.columns]
    return both.select(*out, *[F.col(f"__r.`{c}`").alias(c) for c in right.columns if c not in left.columns])


def concat(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union by name; a column whose types differ and are not both numeric becomes text."""
    for f in left.schema.fields:
        if f.name in right.columns:
            t = right.schema[f.name].dataType
            if f.dataType != t and not (isinstance(f.dataType, T.NumericType) and isinstance(t, T.NumericType)):
                left, right = left.withColumn(f.name, F.col(f"`{f.name}`").cast("string")), right.withColumn(f.name, F.col(f"`{f.name}`").cast("string"))
    return left.unionByName(right, allowMissingColumns=True)


def _is_number(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def _number(v: Column) -> Column:
    return F.trim(v.cast("string")).try_cast("double")


def _terms(left: DataFrame, right: DataFrame, pairs: list[Pair]) -> list[tuple[str, str, bool]]:
    return [(a, b, _is_number(left, a) and _is_number(right, b)) for a, b in pairs]


def _bands(v: Column, numeric: bool, bound: float) -> Column:
    """A number that differs by one at most between values whose similarity is above bound; one string for null."""
    if numeric:
        size = F.floor(F.log(F.greatest(F.abs(v.cast("double")), F.lit(1e-10))) / -math.log(bound)).cast("bigint")
        tiny = F.abs(v.cast("double")) <= 1e-10
        return F.struct(F.when(v.isNull(), 2).when(tiny, 0).otherwise(F.signum(v.cast("double"))).cast("int").alias("s"), F.when(v.isNull() | tiny, 0).otherwise(size).alias("b"))
    b = max(bound - 0.005, 1e-6)
    span = math.log((2 - b) / b)
    n = F.char_length(stripped(v.cast("string")))
    return F.struct(F.when(v.isNull(), 2).otherwise(1).alias("s"), F.when(v.isNull() | (n == 0), -1).otherwise(F.floor(F.log(n.cast("double")) / max(span, 1e-9))).cast("bigint").alias("b"))


def candidates(left: DataFrame, right: DataFrame, pairs: list[Pair], weights: dict[str, float], threshold: float, null_matches: bool) -> DataFrame:
    """Pairs of (__l, __r) structs among which every pair scoring above threshold is.

    If all other fields matched fully, a field of weight w must itself be above 1 - (1 - threshold) / w. Where that is
    positive it bounds the ratio of magnitudes (or lengths), so values fall into the same or neighbouring logarithmic
    bands: an equi-join. Without such a field all pairs are candidates, as the definition has it (so too where text may
    count as a number, null_matches being false, and no field is numeric).
    """
    l_, r_ = left.select(F.struct("*").alias("__l")), right.select(F.struct("*").alias("__r"))
    best = max(((1 - (1 - threshold) / weights[a], numeric, a, b) for a, b, numeric in _terms(left, right, pairs) if a in weights and (numeric or null_matches)), default=(0, False, "", ""), key=lambda x: x[:2])
    bound, numeric, a, b = best
    if bound <= 0.01 or bound >= 1:
        return l_.crossJoin(r_)
    va, vb = F.col(f"__l.`{a}`"), F.col(f"__r.`{b}`")
    own = _bands(va, numeric, bound)
    near = F.array(*[F.struct(own["s"].alias("s"), (own["b"] + d).alias("b")) for d in (-1, 0, 1)])
    l_ = l_.withColumn("__k", F.explode(near))
    if not null_matches:
        l_, r_ = l_.where(va.isNotNull()), r_.where(vb.isNotNull())
    r_ = r_.withColumn("__k", _bands(vb, numeric, bound))
    return l_.join(r_, "__k").drop("__k")


def _record(x: Column, y: Column, terms: list[tuple[str, str, bool]], weights: dict[str, float], threshold: float, null_matches: bool, method: str, numbers: bool) -> tuple[Column, Column]:
    """Of two records: a bound on their score from numbers and lengths alone, and the score, null where the bound is not above
    the threshold. The string kernel gets nulls there."""
    sure, most, strings = F.lit(0.0), F.lit(0.0), []
    for a, b, numeric in terms:
        if a not in weights:
            continue
        p, q, w = x[a], y[b], weights[a]
        rule = (lambda v, p=p, q=q: null_rule(p, q, v)) if null_matches else (lambda v, p=p, q=q: F.when(p.isNull() | q.isNull(), 0.0).otherwise(v))
        near, numbers_both = numeric_similarity(p, q), None
        if numbers:  # may be negative; text counts as a number where it is one
            m, n = _number(p), _number(q)
            near, numbers_both = 1 - F.abs(m - n) / F.greatest(F.abs(m), F.abs(n), F.lit(1e-9)), m.isNotNull() & n.isNotNull()
        if numeric:
            sure, most = sure + w * rule(near), most + w * rule(near)
        else:
            bound = F.least(ratio_bound(p.cast("string"), q.cast("string")), F.lit(1.0)) if method in ("levenshtein", "token_sort") else F.lit(1.0)
            most = most + w * rule(F.when(numbers_both, 1.0).otherwise(bound) if numbers else bound)
            strings.append((p, q, w, rule, near, numbers_both))
    total = sure
    for p, q, w, rule, near, numbers_both in strings:
        text = similarity(F.when(most > threshold, p.cast("string")), F.when(most > threshold, q.cast("string")), method)
        total = total + w * rule(F.when(numbers_both, near).otherwise(text) if numbers else text)
    return most, F.when(most > threshold, total)


def _score(rows: DataFrame, terms: list[tuple[str, str, bool]], weights: dict[str, float], threshold: float, null_matches: bool, method: str, numbers: bool) -> DataFrame:
    """The rows (with structs __l and __r) scoring above threshold, with their score."""
    most, score = _record(F.col("__l"), F.col("__r"), terms, weights, threshold, null_matches, method, numbers)
    return rows.where(most > threshold).withColumn("score", score).where(F.col("score") > threshold)


def _classes(df: DataFrame, columns: list[str], row: str) -> DataFrame:
    """The distinct values of columns, each with the least row id that has them."""
    return df.groupBy(*[F.col(f"`{c}`") for c in dict.fromkeys(columns)]).agg(F.min(f"`{row}`").alias("__first"))


#: Ratios down to which pairs of strings are listed in turn, while rows look for a best match.
LEVELS = (0.97, 0.94, 0.91, 0.88, 0.86, 0.84, 0.82, 0.8, 0.75, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)


def _by_numbers(left: DataFrame, right: DataFrame, field: Pair, terms, weights: dict[str, float], threshold: float, k: int, method: str, seen) -> DataFrame:
    """What _top returns, for a numeric field without nulls: what lies further off in its order is less similar."""
    a, b = field
    w = weights[a]
    point = lambda df, c, name, i: df.select(F.lit(0).alias("key"), F.col(f"`{c}`").cast("double").alias("v"), F.col("__first").alias(i), F.struct("*").alias(name))
    cost = lambda x, y: -_record(x, y, terms, weights, threshold, True, method, False)[1]
    found = nearest(point(left, a, "x", "lid"), point(right, b, "y", "rid"), cost, lambda _, v, edge: -(w * numeric_similarity(v, edge) + (1 - w)), k, -threshold, seen)
    return found.select("lid", F.explode("best").alias("b")).select("lid", "b.rid", (-F.col("b.cost")).alias("score"))


def _by_grams(left: DataFrame, right: DataFrame, field: Pair, bound: float, terms, weights: dict[str, float], threshold: float, k: int, seen) -> DataFrame:
    """What _top returns, for a string field without nulls: pairs above one ratio after the other are listed, and a row is done
    when its k-th best is above all that pairs of a lower ratio can reach."""
    from pyspark.sql import Window as W

    a, b = field
    w = weights[a]
    l_, r_ = left.select(F.col("__first").alias("lid"), F.struct("*").alias("__l")), right.select(F.col("__first").alias("rid"), F.struct("*").alias("__r"))
    text = lambda df, c: df.select(F.col("__first").alias("id"), normal(F.col(f"`{c}`").cast("string")).alias("s"))
    index = Index(checkpoint(text(left, a)), checkpoint(text(right, b)))
    active, out = None, []
    for level in (*[x for x in LEVELS if x > bound], bound):
        pairs = index.candidates(level, active)
        if seen is not None:
            seen(pairs.count())
        rows = _score(pairs.join(l_, "lid").join(r_, "rid"), terms, weights, threshold, True, "levenshtein", False).select("lid", "rid", "score")
        place = F.row_number().over(W.partitionBy("lid").orderBy(F.desc("score"), "rid"))
        best = checkpoint(rows.withColumn("place", place).where(F.col("place") <= k))
        if level == bound:
            out.append(best)
            break
        sure = best.where(F.col("place") == k).where(F.col("score") > w * level + (1 - w) + 1e-9).select("lid")
        out.append(best.join(sure, "lid", "left_semi"))
        rest = index.sides[0].select("id") if active is None else active
        active = checkpoint(rest.join(sure.select(F.col("lid").alias("id")), "id", "left_anti"))
        if not active.limit(1).count():
            break
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found.select("lid", "rid", "score")


def _top(left: DataFrame, right: DataFrame, pairs: list[Pair], weights: dict[str, float], threshold: float, k: int, method: str, free: list[Pair] | None = None, seen=None) -> DataFrame:
    """(lid, rid, score): of each class of the left the k best classes of the right that score above threshold, named by their
    __first, ties by rid.

    If all other fields matched fully, a field of weight w would still have to be similar above 1 - (1 - threshold) / w. The field
    with the highest such bound leads: rows that have it meet by its order or its grams, rows without it meet by the next
    field. Where none has a bound, all pairs are compared, as the definition has it.
    """
    from pyspark.sql import Window as W

    terms = _terms(left, right, pairs)
    free = pairs if free is None else free
    leads = [(1 - (1 - threshold) / weights[a], numeric, a, b) for a, b, numeric in terms if (a, b) in free and a in weights and (numeric or method == "levenshtein")]
    bound, numeric, a, b = max(leads, default=(0, False, "", ""), key=lambda x: x[:2])
    if bound <= 0.01 or bound >= 1:
        rows = _score(left.select(F.struct("*").alias("__l")).crossJoin(right.select(F.struct("*").alias("__r"))), terms, weights, threshold, True, method, False)
        rows = rows.select(F.col("__l.__first").alias("lid"), F.col("__r.__first").alias("rid"), "score")
        return rows.withColumn("place", F.row_number().over(W.partitionBy("lid").orderBy(F.desc("score"), "rid"))).where(F.col("place") <= k).drop("place")
    left, right = checkpoint(left), checkpoint(right)
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    sides = left.where(x.isNotNull()), right.where(y.isNotNull())
    out = _by_numbers(*sides, (a, b), terms, weights, threshold, k, method, seen) if numeric else _by_grams(*sides, (a, b), bound, terms, weights, threshold, k, seen)
    gaps = left.where(x.isNull()), right.where(y.isNull())
    if all(g.limit(1).count() for g in gaps):
        out = out.unionByName(_top(*gaps, pairs, weights, threshold, k, method, [p for p in free if p != (a, b)], seen))
    return out


def _to_rows(rows: DataFrame, columns: list[str], row: str, top: DataFrame, classes: DataFrame, class_id: str, as_: str) -> DataFrame:
    """top with the rows of each class in as_, beside the class's id."""
    named = classes.select(F.col("__first").alias(class_id), *[F.col(f"`{c}`").alias(f"__v{i}") for i, c in enumerate(columns)]).join(top, class_id)
    own = rows.select(F.col(f"`{row}`").alias(as_), *[F.col(f"`{c}`").alias(f"__w{i}") for i, c in enumerate(columns)])
    same = [F.col(f"__w{i}").eqNullSafe(F.col(f"__v{i}")) for i in range(len(columns))]
    return own.join(named, same).drop(*[f"__{x}{i}" for i in range(len(columns)) for x in "vw"])


def best_matches(left: DataFrame, right: DataFrame, pairs: list[Pair], left_id: str, right_id: str, threshold: float = 0.85, weights: dict[str, float] | None = None, method: str = "levenshtein", seen=None) -> DataFrame:
    """(left_id, right_id, score): per left row the best right row strictly above threshold, the lower right id on ties.

    Rows with equal values have equal scores, so distinct values are compared, not rows: on the right the lowest id stands
    for its equals, and what a value of the left finds goes to all rows that have it. seen is told of pairs looked at.
    """
    w = weights_of([a for a, _ in pairs], weights)
    own = list(dict.fromkeys(a for a, _ in pairs))
    classes = checkpoint(_classes(left, own, left_id))
    top = _top(classes, _classes(right, [b for _, b in pairs], right_id), pairs, w, threshold, 1, method, seen=seen)
    return _to_rows(left, own, left_id, top, classes, "lid", "left_id").select("left_id", F.col("rid").alias("right_id"), "score")


def all_matches(left: DataFrame, right: DataFrame, pairs: list[Pair], left_id: str, right_id: str, threshold: float = 0.7, max_matches: int = 5, weights: dict[str, float] | None = None, method: str = "levenshtein", seen=None) -> DataFrame:
    """(left_id, right_id, score, rank): per left row up to max_matches right rows at or above threshold, best first.

    Distinct values are compared here too. Of equal right rows the lowest max_matches ids can be among the best.
    """
    from pyspark.sql import Window as W

    w = weights_of([a for a, _ in pairs], weights)
    own, theirs = list(dict.fromkeys(a for a, _ in pairs)), list(dict.fromkeys(b for _, b in pairs))
    classes, others = checkpoint(_classes(left, own, left_id)), checkpoint(_classes(right, theirs, right_id))
    top = _top(classes, others, pairs, w, math.nextafter(threshold, 0), max_matches, method, seen=seen)
    place = F.row_number().over(W.partitionBy(*[F.col(f"`{b}`") for b in theirs]).orderBy(F.col(f"`{right_id}`")))
    few = right.withColumn("__place", place).where(F.col("__place") <= max_matches)
    each = _to_rows(few, theirs, right_id, top, others, "rid", "right_id").select("lid", "right_id", "score")
    each = each.withColumn("rank", F.row_number().over(W.partitionBy("lid").orderBy(F.desc("score"), "right_id"))).where(F.col("rank") <= max_matches)
    return _to_rows(left, own, left_id, each, classes, "lid", "left_id").select("left_id", "right_id", "score", "rank")


def _merged(left: DataFrame, right: DataFrame, matched: DataFrame, pairs: list[Pair], left_id: str, right_id: str) -> DataFrame:
    """Matched rows (left first, nulls filled from the right), then left and right rows without a partner."""
    to_left = {b: a for a, b in pairs}
    r = right.toDF(*[to_left[c] if c in to_left and (to_left[c] == c or to_left[c] not in right.columns) else c for c in right.columns])
    rid = r.columns[right.columns.index(right_id)]
    l_ = left.select(F.struct("*").alias("__l"))
    r_ = r.select(F.struct("*").alias("__r"))
    m = l_.join(matched, F.col(f"__l.`{left_id}`") == F.col("left_id"), "left").join(r_, F.col(f"__r.`{rid}`") == F.col("right_id"), "left")
    hidden = {right_id} if right_id.startswith("__") else set()
    cols = [F.coalesce(*_same(left, r, c, c)).alias(c) if c in r.columns and c != left_id else F.col(f"__l.`{c}`").alias(c) for c in left.columns]
    extra = [c for c in r.columns if c not in left.columns and c not in hidden]
    both = m.select(*cols, *[F.col(f"__r.`{c}`").alias(c) for c in extra])
    used = matched.select(F.col("right_id").alias("__u")).distinct()
    alone = r.join(used, F.col(f"`{rid}`") == F.col("__u"), "left_anti").drop(*hidden)
    alone = alone.select([F.col(f"`{c}`").cast(both.schema[c].dataType).alias(c) for c in alone.columns])
    return both.unionByName(alone, allowMissingColumns=True)


def semantic_join(left: DataFrame, right: DataFrame, pairs: list[Pair], left_id: str = "__row_id", right_id: str = "__rid", threshold: float = 0.85, weights: dict[str, float] | None = None, method: str = "levenshtein") -> DataFrame:
    """Outer join on best_matches; a right row may match many left rows. Without pairs the tables are concatenated."""
    if not pairs:
        return concat(left, right.drop(right_id) if right_id.startswith("__") else right)
    matched = checkpoint(best_matches(left, right, pairs, left_id, right_id, threshold, weights, method))
    return _merged(left, right, matched, pairs, left_id, right_id)


def _edges(left: DataFrame, right: DataFrame, pairs: list[Pair], weights: dict[str, float], threshold: float) -> DataFrame:
    """(lc, rc, score): the classes of both sides, named by their __first, that score above threshold; nulls score nothing, and text
    that is a number on both sides counts as one. Text alone meets by its grams, or as numbers in bands."""
    terms = _terms(left, right, pairs)
    bounds = [(1 - (1 - threshold) / weights[a], a, b) for a, b, _ in terms]
    bound, a, b = max(bounds, key=lambda x: x[0])
    rows = None
    if bound > 0.01 and not any(numeric for _, _, numeric in terms):
        l_, r_ = left.select(F.col("__first").alias("lid"), F.struct("*").alias("__l")), right.select(F.col("__first").alias("rid"), F.struct("*").alias("__r"))
        text = lambda df, c: df.where(F.col(f"`{c}`").isNotNull()).select(F.col("__first").alias("id"), normal(F.col(f"`{c}`").cast("string")).alias("s"))
        met = Index(checkpoint(text(left, a)), checkpoint(text(right, b))).candidates(bound)
        number = lambda df, c, i: df.select(F.col("__first").alias(i), _number(F.col(f"`{c}`")).alias("v")).where("v IS NOT NULL")
        m, n = number(left, a, "lid"), number(right, b, "rid")
        near = F.array(*[F.struct(_bands(F.col("v"), True, bound)["s"].alias("s"), (_bands(F.col("v"), True, bound)["b"] + d).alias("b")) for d in (-1, 0, 1)])
        banded = m.withColumn("k", F.explode(near)).join(n.withColumn("k", _bands(F.col("v"), True, bound)), "k").select("lid", "rid")
        rows = met.unionByName(banded).distinct().join(l_, "lid").join(r_, "rid")
    if rows is None:
        rows = candidates(left, right, pairs, weights, threshold, False)
    scored = _score(rows, terms, weights, threshold, False, "levenshtein", True)
    return scored.select(F.col("__l.__first").alias("lc"), F.col("__r.__first").alias("rc"), "score")


#: Left rows of ranges that are joined, about.
TOGETHER = 200_000


def _one_number(left: DataFrame, right: DataFrame, a: str, b: str, left_id: str, right_id: str, threshold: float) -> DataFrame | None:
    """probabilistic_matches of one pair of numbers, threshold not negative; None if a value is not finite.

    The less similar right values lie further off on either side, so nobody needs a list of wishes. Left rows are dealt by
    value in ranges, each with the right rows that its values can like. A right row has a bound: the lowest id that has asked for
    it, from which higher ids need not ask. In a round each range lets its left rows ask in order of id, each for the best
    right row whose bound allows it; of several that ask for one, from whatever range, the lowest id makes the new bound.
    That is deferred acceptance: who asks has been refused for good by all it likes better, so the order does not matter. It ends
    when no two ask for the same. After the first round only those who asked are left, as many as there are right rows or little
    more; ranges are joined to larger ones, at other places in every round, so that no border keeps rows apart for long.
    """
    value = lambda df, c, i, kind: df.select(_number(F.col(f"`{c}`")).alias("v"), F.lit(kind).alias("kind"), F.col(f"`{i}`").cast("bigint").alias("id"))
    both = value(left, a, left_id, 0).unionByName(value(right, b, right_id, 1)).where("v IS NOT NULL")
    both = checkpoint(both.repartitionByRange("v", "id", "kind").withColumn("q", F.spark_partition_id()))
    ends = both.groupBy("q").agg(F.min(F.when(F.col("kind") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("kind") == 0, F.col("v"))).alias("b"), F.count_if(F.isnan("v") | (F.abs("v") == math.inf)).alias("odd"))
    ends = ends.collect()  # a row per task
    if any(e.odd for e in ends):
        return None
    off = lambda v, up: v / threshold if threshold and (v > 0) == up else v * threshold if threshold else (math.inf if up else -math.inf)
    wider = lambda v, up: off(v, up) + (1 if up else -1) * (1e-9 * abs(v) + 2e-9) / (threshold or 1)
    mine, theirs = both.where("kind = 0").select(F.col("id").alias("l"), "v", "q"), both.where("kind = 1").select(F.col("id").alias("r"), "v")

    def reached(p: Column) -> DataFrame:
        """(p, r, v): the right rows that the ranges' values can like, ranges joined as p says."""
        spans = left.sparkSession.createDataFrame([(e.q, wider(e.a, False), wider(e.b, True)) for e in ends if e.a is not None], "q int, a double, b double")
        spans = spans.groupBy(p.alias("p")).agg(F.min("a").alias("a"), F.max("b").alias("b"))
        return theirs.join(F.broadcast(spans), (F.col("v") >= F.col("a")) & (F.col("v") <= F.col("b"))).select("p", "r", "v")

    def ask(both: pa.Table) -> pa.Table:
        rows, free = both.filter(both["l"].is_valid()), both.filter(both["r"].is_valid())
        ids, own, ranges = rows["l"].to_numpy(), rows["v"].to_numpy(), rows["q"].to_numpy()
        r, v, bound = free["r"].to_numpy(), free["v"].to_numpy(), free["bound"].to_numpy()
        order = np.lexsort((r, v))
        r, v, bound = r[order].tolist(), v[order], bound[order].tolist()
        values, first = np.unique(v, return_index=True)
        at, end = first.tolist(), [*first[1:].tolist(), len(v)]  # a value's first right row that may still be had, and where its rows end
        place = np.searchsorted(values, own)
        n, values = len(values), values.tolist()
        up, down = list(range(n + 1)), list(range(n + 1))  # the next value at or above, at or below with such a row; down is off by one

        def had(g: int, i: int) -> bool:
            k = at[g]
            while k < end[g] and bound[k] < i:
                k += 1
            at[g] = k
            return k < end[g]

        def step(links: list[int], g: int, by: int, i: int, last: int) -> int:
            """The next value from g on that has a row for i, or last; values without any are passed by from now on."""
            path = []
            while True:
                while links[g] != g:
                    path.append(g)
                    g = links[g]
                if g == last or had(g - (by < 0), i):
                    break
                links[g] = g + by
            for x in path:
                links[x] = g
            return g

        out = []
        for x in np.argsort(ids):
            i, m, g = int(ids[x]), float(own[x]), int(place[x])
            best = None
            for links, by, last, g in ((up, 1, n, g), (down, -1, 0, g)):
                while (g := step(links, g, by, i, last)) != last:
                    h = g - (by < 0)
                    score = 1 - abs(m - values[h]) / max(abs(m), abs(values[h]), 1e-9)
                    if score < max(threshold, best[0] if best else 0) - 1e-12:
                        break
                    if score > threshold and (not best or (-score, r[at[h]]) < (-best[0], best[1])):
                        best = (score, r[at[h]], at[h])
                    g += by  # another value may be as similar, as doubles are rounded
            if best:
                bound[best[2]] = i
                out.append((i, m, int(ranges[x]), best[1], best[0]))
        kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.float64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], names=["l", "v", "q", "r", "score"])

    none, bounds, p, shift = F.lit((1 << 63) - 1), None, F.col("q"), 0
    while True:
        known = reached(p).withColumn("bound", none) if bounds is None else reached(p).join(bounds, "r", "left").select("p", "r", "v", F.coalesce("bound", none).alias("bound"))
        each = mine.select(p.alias("p"), "l", "v", "q").unionByName(known, allowMissingColumns=True)
        asks = checkpoint(each.groupBy("p").applyInArrow(ask, "l bigint, v double, q int, r bigint, score double"))
        new = asks.groupBy("r").agg(F.min("l").alias("bound"), F.count("*").alias("n"))
        got = new.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
        if (got.most or 1) == 1:
            return asks.select(F.col("l").alias("left_id"), F.col("r").alias("right_id"), "score")
        new = new.select("r", "bound")
        bounds = checkpoint(new if bounds is None else bounds.unionByName(new).groupBy("r").agg(F.min("bound").alias("bound")))
        mine = asks.select("l", "v", "q")  # who did not ask has been refused by all
        together = 1 << max(1, (TOGETHER * len(ends) // got.rows).bit_length() - 1)
        shift = 0 if shift else together // 2
        p = F.floor((F.col("q") + shift) / together).cast("int")


def probabilistic_matches(left: DataFrame, right: DataFrame, pairs: list[Pair], left_id: str, right_id: str, threshold: float = 0.75) -> DataFrame:
    """One-to-one (left_id, right_id, score): left rows in order of id take their best free right row above threshold.

    Found by deferred acceptance with rights preferring the lowest left id, which gives the same matching in any order. Rows of
    equal values are a class: a left class has one list of wishes, a right class is a unit with as many seats as rows. Only
    right classes that some left class likes as much as another are taken apart, since the lower row id decides there.

    In a list the seats of its units are numbered. The rows of a left class, in order of id, end at seats that rise, whatever
    the other classes take. So a row proposes to the unit of the seat k + max(s - j) over the rows j up to it, the k-th,
    where s is the seat from which on row j has not been refused. A unit keeps its lowest ids, the refused go on behind it.
    Edges are pairs of classes, rounds pass over the rows that are still in, and a row needs no round per refused equal.
    """
    from pyspark.sql import Window as W

    whole = isinstance(left.schema[left_id].dataType, T.IntegralType) and isinstance(right.schema[right_id].dataType, T.IntegralType)
    if len(pairs) == 1 and whole and threshold >= 0 and all(numeric for _, _, numeric in _terms(left, right, pairs)):
        out = _one_number(left, right, *pairs[0], left_id, right_id, threshold)
        if out is not None:
            return out.select(F.col("left_id").cast(left.schema[left_id].dataType), F.col("right_id").cast(right.schema[right_id].dataType), "score")
    w = {a: 1 / len(pairs) for a, _ in pairs}
    own, theirs = list(dict.fromkeys(a for a, _ in pairs)), list(dict.fromkeys(b for _, b in pairs))
    mine, others = checkpoint(_classes(left, own, left_id)), checkpoint(_classes(right, theirs, right_id))
    edges = checkpoint(_edges(mine, others, pairs, w, threshold))
    alike = edges.groupBy("lc", "score").agg(F.count("*").alias("n")).where("n > 1")
    apart = checkpoint(edges.join(alike, ["lc", "score"]).select("rc").distinct())
    rows = _to_rows(right, theirs, right_id, edges.select("rc").distinct(), others, "rc", "r").select("rc", "r")
    single = rows.join(apart, "rc", "left_semi").select("rc", F.col("r").alias("u"), F.lit(1).alias("k"), "r")
    together = rows.join(apart, "rc", "left_anti").select("rc", F.col("rc").alias("u"), F.row_number().over(W.partitionBy("rc").orderBy("r")).alias("k"), "r")
    seats = checkpoint(single.unionByName(together))
    units = seats.groupBy("rc", "u").agg(F.count("*").alias("cap"))
    upto = F.sum("cap").over(W.partitionBy("lc").orderBy(F.desc("score"), "u"))
    wish = checkpoint(edges.join(units, "rc").withColumn("upto", upto).select("lc", (F.col("upto") - F.col("cap")).alias("x"), F.struct("u", "cap", "score", "upto").alias("unit")))
    state = _to_rows(left, own, left_id, edges.select("lc").distinct(), mine, "lc", "l").select("lc", "l", F.lit(0).cast("bigint").alias("base"))
    while True:
        k = F.row_number().over(W.partitionBy("lc").orderBy("l")).cast("bigint")
        seat = state.withColumn("k", k).withColumn("x", F.col("k") + F.max(F.col("base") - F.col("k")).over(W.partitionBy("lc").orderBy("l").rowsBetween(W.unboundedPreceding, 0)))
        none = F.lit(None).cast(wish.schema["unit"].dataType)
        both = wish.select("lc", "x", F.lit(0).alias("kind"), F.lit(None).cast(state.schema["l"].dataType).alias("l"), "unit").unionByName(seat.select("lc", "x", F.lit(1).alias("kind"), "l", none.alias("unit")))
        found = both.withColumn("unit", F.last("unit", ignorenulls=True).over(W.partitionBy("lc").orderBy("x", "kind", "l").rowsBetween(W.unboundedPreceding, 0)))
        asks = found.where((F.col("kind") == 1) & (F.col("x") < F.col("unit.upto"))).select("lc", "l", "unit.*")
        asks = checkpoint(asks.withColumn("place", F.row_number().over(W.partitionBy("u").orderBy("l"))))
        if not asks.where("place > cap").limit(1).count():
            taken = asks.select("l", "score", "u", F.col("place").alias("k"))
            return taken.join(seats.select("u", "k", "r"), ["u", "k"]).select(F.col("l").alias("left_id"), F.col("r").alias("right_id"), "score")
        state = asks.select("lc", "l", F.when(F.col("place") > F.col("cap"), F.col("upto")).otherwise(F.col("upto") - F.col("cap")).alias("base"))


def probabilistic_join(left: DataFrame, right: DataFrame, pairs: list[Pair], left_id: str = "__row_id", right_id: str = "__rid", threshold: float = 0.75) -> DataFrame:
    if not pairs:
        return concat(left, right.drop(right_id) if right_id.startswith("__") else right)
    return _merged(left, right, probabilistic_matches(left, right, pairs, left_id, right_id, threshold), pairs, left_id, right_id)


def _nearest(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, t, before, after): of each left (id, t) the last right (id, t) at or before it and the first after, as structs (t, id).

    Both are dealt by time in ranges and swept once each way within a task; what lies beyond a task's ends comes from a row
    per task. Rights of equal times stand for the lowest of their ids. No time, however busy, falls to one task.
    """
    from pyspark.sql import Window as W

    both = left.select("t", F.lit(1).alias("kind"), "id", F.lit(None).cast(right.schema["id"].dataType).alias("rid"))
    once = right.groupBy("t").agg(F.min("id").alias("rid"))
    own = left.schema["id"].dataType
    both = both.unionByName(once.select("t", F.lit(0).alias("kind"), F.lit(None).cast(own).alias("id"), "rid"))
    dealt = checkpoint(both.repartitionByRange("t", "kind", "id").withColumn("p", F.spark_partition_id()))
    mark = F.when(F.col("kind") == 0, F.struct("t", F.col("rid").alias("id")))
    ends = {r.p: (r.a, r.b) for r in dealt.groupBy("p").agg(F.min(mark).alias("a"), F.max(mark).alias("b")).collect()}  # a row per task
    carry: dict[int, list] = {p: [None, None] for p in ends}
    for side, order in ((0, sorted(ends)), (1, sorted(ends, reverse=True))):
        seen = None
        for p in order:
            carry[p][side] = seen
            seen = ends[p][1 - side] or seen
    mark_type = T.StructType([T.StructField("t", T.LongType()), T.StructField("id", right.schema["id"].dataType)])
    edge = left.sparkSession.createDataFrame([(p, *c) for p, c in carry.items()], T.StructType([T.StructField("p", T.IntegerType()), T.StructField("e0", mark_type), T.StructField("e1", mark_type)]))
    up = W.partitionBy("p").orderBy("t", "kind", "id").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("p").orderBy(F.desc("t"), F.desc("kind"), F.desc("id")).rowsBetween(W.unboundedPreceding, 0)
    swept = dealt.withColumn("before", F.last(mark, ignorenulls=True).over(up)).withColumn("after", F.last(mark, ignorenulls=True).over(down)).where("kind = 1")
    return swept.join(F.broadcast(edge), "p").select("id", "t", F.coalesce("before", "e0").alias("before"), F.coalesce("after", "e1").alias("after"))


def temporal_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, left_id: str, right_id: str, tolerance: int = 3600) -> DataFrame:
    """Left join to the nearest right row within tolerance seconds (inclusive); on ties the earlier, then the lower id.

    Same-named other columns get _x and _y. A null timestamp raises at once, for the times are dealt and
    written down here; so too in the command line, whose fuse then fails. Ids are unique.
    """
    micros = lambda c: F.unix_micros(F.col(f"`{c}`").cast("timestamp"))
    checked = lambda c: F.coalesce(micros(c), F.raise_error(F.lit(f"Merge keys contain null values: {c}")).cast("bigint"))
    l_, r_ = left.select(F.struct("*").alias("__l")), right.select(F.struct("*").alias("__r"))
    times = lambda df, c, i: df.select(checked(c).alias("t"), F.col(f"`{i}`").alias("id"))
    near = _nearest(times(left, left_ts, left_id), times(right, right_ts, right_id))
    gap = lambda side: F.abs(F.col("t") - F.col(f"{side}.t"))
    earlier = F.col("after.t").isNull() | (gap("before") <= gap("after"))
    choice = F.when(F.col("before.t").isNotNull() & earlier, F.col("before")).otherwise(F.col("after"))
    best = near.select(F.col("id").alias("__lid"), "t", choice.alias("c")).where(F.abs(F.col("t") - F.col("c.t")) <= tolerance * 1_000_000).select("__lid", F.col("c.id").alias("__rid"))
    out = l_.join(best, F.col(f"__l.`{left_id}`") == F.col("__lid"), "left").join(r_, F.col(f"__r.`{right_id}`") == F.col("__rid"), "left")
    common = (set(left.columns) & set(right.columns)) - ({left_ts} if left_ts == right_ts else set())
    cols = [F.col(f"__l.`{c}`").alias(f"{c}_x" if c in common else c) for c in left.columns]
    return out.select(*cols, *[F.col(f"__r.`{c}`").alias(f"{c}_y" if c in common else c) for c in right.columns if not (c == right_ts and left_ts == right_ts)])


def fold(frames: dict[str, DataFrame], edges: dict[tuple[str, str], object], merge) -> tuple[DataFrame, list[str]]:
    """Merge datasets in order, each that shares an edge with one already in; merge(fused, next, its edges). Others are left out."""
    if not frames:
        raise FusionError("nothing to fuse")
    names = list(frames)
    out, used = frames[names[0]], [names[0]]
    for name in names[1:]:
        own = {e: v for e, v in edges.items() if (e[0] in used and e[1] == name) or (e[1] in used and e[0] == name)}
        if own:
            out = merge(out, frames[name], own)
            used.append(name)
    return out, used


__all__ = ["all_matches", "best_matches", "candidates", "concat", "exact_merge", "fold", "probabilistic_join", "probabilistic_matches", "semantic_join", "temporal_join"]
