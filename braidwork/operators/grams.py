"""Pairs of strings whose ratio is above a bound, found through rare q-grams instead of comparing all pairs.

The ratio of strings of a and b characters is 2 LCS / (a + b). Leaving out the characters that are not in the common subsequence
breaks at most q grams of q characters for each one left out and q - 1 for each one put in, so strings of a ratio of r or more
share (a + b) ((2q - 1) r / 2 - (q - 1)) + 1 - q of their numbered q-grams at least (the second of two equal grams is
another one). Hence, with all grams in one order, the rarest first, the first |A| - shared + 1 of one string and of the other
have one in common: a join on these prefixes. Lengths must fit (a r / (2 - r) <= b <= a (2 - r) / r), and so must the places of
the common gram in both orders.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint


@F.pandas_udf(T.StringType())
def normal(s: pd.Series) -> pd.Series:
    """Stripped and in lower case, as the ratio compares it."""
    return s.map(lambda x: None if x is None else x.strip().lower())


def _numbered(q: int):
    def run(s: pd.Series) -> pd.Series:
        def grams(x: str) -> list[str]:
            count: Counter[str] = Counter()
            out = []
            for i in range(len(x) - q + 1):
                g = x[i : i + q]
                count[g] += 1
                out.append(g if count[g] == 1 else f"{g}\x00{count[g]}")
            return out

        return s.map(lambda x: grams(x or ""))

    return F.pandas_udf(run, T.ArrayType(T.StringType()))


def least_ratio(above: float) -> float:
    """What the exact ratio is at least if, rounded to whole percents, it is over a bound."""
    return (math.floor(100 * above - 1e-9) + 0.5) / 100


def width(ratio: float) -> int:
    """The q whose grams serve for a ratio: the larger, the rarer; small ratios leave no large ones whole."""
    return 3 if ratio >= 0.9 else 2 if ratio >= 0.75 else 1


def shared(ratio: float, q: int, both: Column) -> Column:
    """How many q-grams strings of so many characters together share at least."""
    return F.ceil(both * ((2 * q - 1) * ratio / 2 - (q - 1)) + 1 - q - 1e-9)


def _long(ratio: float, q: int) -> int:
    """The number of characters in both strings from which on q-grams are used; single characters serve for shorter ones."""
    return 0 if q == 1 else math.ceil((3 + q - 1) / ((2 * q - 1) * ratio / 2 - (q - 1)))


class Index:
    """The grams of both sides' strings, the rarest of the right side first. left and right have id and s, each id once."""

    def __init__(self, left: DataFrame, right: DataFrame):
        self.sides = [df.select("id", "s", F.char_length("s").alias("n")) for df in (left, right)]
        self.sorted: dict[int, list[DataFrame]] = {}
        ends = [df.agg(F.min("n").alias("a"), F.max("n").alias("b")).first() for df in self.sides]
        #: the fewest and the most characters that two strings have together, and whether both sides have empty ones
        self.least, self.most, self.empty = sum(e.a or 0 for e in ends), sum(e.b or 0 for e in ends), all(e.a == 0 for e in ends)

    def grams(self, q: int) -> list[DataFrame]:
        """(id, n, g) of both sides: numbered q-grams as an array, the rarest first."""
        if q not in self.sorted:
            split = [df.where(F.col("n") >= q).select("id", "n", F.explode(_numbered(q)("s")).alias("g")) for df in self.sides]
            often = checkpoint(split[1].groupBy("g").agg(F.count("*").alias("f")))
            self.sorted[q] = [
                checkpoint(df.join(often, "g", "left").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "g"))).alias("x")).select("id", "n", F.col("x.g").alias("g")))
                for df in split
            ]
        return self.sorted[q]

    def _pairs(self, ratio: float, q: int, least: int, most: float, active: DataFrame | None) -> DataFrame:
        """(lid, rid) of strings with least <= both lengths < most that may have the ratio."""
        a, b = self.grams(q)
        if active is not None:
            a = a.join(active, "id", "left_semi")
        sides = []
        for df, name in ((a, "l"), (b, "r")):
            smallest = F.greatest(F.lit(float(least)), 2 * F.col("n") / (2 - ratio))
            prefix = F.greatest(F.size("g") - F.greatest(shared(ratio, q, smallest), F.lit(1)) + 1, F.lit(0)).cast("int")
            own = df.where((2 * F.col("n") / ratio >= least) & (2 * F.col("n") / (2 - ratio) < most))
            sides.append(own.select(F.col("id").alias(f"{name}id"), F.col("n").alias(f"{name}n"), F.size("g").alias(f"{name}s"), F.posexplode(F.slice("g", 1, prefix)).alias(f"{name}p", "g")))
        both = F.col("ln") + F.col("rn")
        fits = (both >= least) & (both < most) & (F.least("ln", "rn") >= F.greatest("ln", "rn") * (ratio / (2 - ratio)) - 1e-9)
        rest = F.least("lp", "rp") + 1 + F.least(F.col("ls") - F.col("lp") - 1, F.col("rs") - F.col("rp") - 1)
        met = sides[0].join(sides[1], "g").where(fits & (rest >= shared(ratio, q, both))).select("lid", "rid").distinct()
        la, rb = (x.select(F.col("id").alias(f"{c}id"), F.col("n").alias(f"{c}n"), F.col("g").alias(f"{c}g")) for x, c in ((a, "l"), (b, "r")))
        whole = met.join(la, "lid").join(rb, "rid")
        return whole.where(F.size(F.array_intersect("lg", "rg")) >= shared(ratio, q, F.col("ln") + F.col("rn"))).select("lid", "rid")

    def candidates(self, above: float, active: DataFrame | None = None) -> DataFrame:
        """(lid, rid): among them every pair whose ratio, in whole percents, is over a bound, each once; with active only pairs
        of left ids in it. Two strings of no characters count as equal."""
        ratio = least_ratio(above)
        q = width(ratio)
        turn = _long(ratio, q)
        parts = []
        if self.most >= turn:
            parts.append(self._pairs(ratio, q, turn, math.inf, active))
        if self.least < turn:
            parts.append(self._pairs(ratio, 1, 0, turn, active))
        if self.empty:
            l_, r_ = (df.where("n = 0").select(F.col("id").alias(f"{c}id"), "n") for df, c in zip(self.sides, "lr"))
            parts.append((l_ if active is None else l_.join(active.select(F.col("id").alias("lid")), "lid", "left_semi")).join(r_, "n").select("lid", "rid"))
        out = parts[0]  # the two kinds of grams serve for any number of characters
        for x in parts[1:]:
            out = out.unionByName(x)
        return out
