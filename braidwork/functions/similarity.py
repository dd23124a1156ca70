"""String, set and record similarity.

`ratio` is 2·LCS/(len a + len b), rounded to a whole percent. The longest common subsequence is found bit-parallel
(Crochemore et al. 2001; Hyyrö 2004). Set similarities are built-in array expressions.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

METHODS = ("levenshtein", "token_sort", "token_set", "partial")

#: Code points that token methods leave out.
_DROPPED = dict.fromkeys(range(128, 256))


def lcs_length(a: str, b: str) -> int:
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 1 in whole percents; two empty strings are alike."""
    total = len(a) + len(b)
    return round(200 * lcs_length(a, b) / total) / 100 if total else 1.0


def _clean(s: str) -> list[str]:
    """Words of letters, digits and underscores, in lower case; code points 128 to 255 are dropped first."""
    return re.sub(r"\W", " ", s.translate(_DROPPED)).lower().split()


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(_clean(a))), " ".join(sorted(_clean(b))))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(_clean(a)), set(_clean(b))
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, [both, *sorted(d)])) for d in (x - y, y - x))
    return max(ratio(both, left) if both else 0.0, ratio(both, right) if both else 0.0, ratio(left, right))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string to windows as long of the longer one, where common blocks put it; a window
    that reaches over the end is cut off there."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0.0
    starts = {max(j - i, 0) for i, j, _ in SequenceMatcher(None, short, long).get_matching_blocks()}
    return max(ratio(short, long[i : i + len(short)]) for i in starts)


_BY_NAME = {"levenshtein": ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio, "partial": partial_ratio}


def string_similarity(a: str | None, b: str | None, method: str = "levenshtein") -> float:
    """0 if either is empty; 1 if equal after stripping and lower-casing; else the method's ratio."""
    if method not in _BY_NAME:
        raise ValueError(f"Unknown similarity method: {method}")
    if not a or not b:
        return 0.0
    a, b = a.strip().lower(), b.strip().lower()
    return 1.0 if a == b else _BY_NAME[method](a, b)


def similarity(a: Column, b: Column, method: str = "levenshtein") -> Column:
    """string_similarity of two columns, Arrow-batched and evaluated once; equal pairs cost one comparison."""
    if method not in _BY_NAME:
        raise ValueError(f"Unknown similarity method: {method}")

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([string_similarity(p, q, method) for p, q in zip(x, y)], dtype="float64")

    return F.pandas_udf(run, T.DoubleType()).asNondeterministic()(a.cast("string"), b.cast("string"))


def stripped(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def ratio_bound(a: Column, b: Column) -> Column:
    """No ratio of the two strings is above this: twice the shorter over the sum, and half a percent for rounding."""
    x, y = F.char_length(stripped(a)), F.char_length(stripped(b))
    return F.coalesce(F.try_divide(2.0 * F.least(x, y), x + y), F.lit(1.0)) + 0.005


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), union))


def dice(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, 1.0).otherwise(F.try_divide(2.0 * F.size(F.array_intersect(a, b)), total))


def ngrams(s: Column, n: int = 2) -> Column:
    """Distinct n-grams of the stripped, lower-cased string; a shorter one is its own only gram."""
    t = F.lower(stripped(s))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(t) - n + 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(n)))
    return F.array_distinct(grams)


def ngram_similarity(a: Column, b: Column, n: int = 2) -> Column:
    return jaccard(ngrams(a, n), ngrams(b, n))


def numeric_similarity(a: Column, b: Column) -> Column:
    """1 - min(|a-b| / max(|a|, |b|, 1e-10), 1)."""
    a, b = a.cast("double"), b.cast("double")
    return 1.0 - F.least(F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-10)), F.lit(1.0))


def null_rule(a: Column, b: Column, value: Column) -> Column:
    """1 if both are null, 0 if one is, else value."""
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(value)


def weights_of(fields: list[str], weights: dict[str, float] | None) -> dict[str, float]:
    """Weights normalised to one over the fields; equal if none are given or they sum to zero; zero-weight fields go."""
    w = {f: (weights or {}).get(f, 0.0 if weights else 1.0) for f in fields}
    total = sum(w.values())
    w = {f: x / total for f, x in w.items()} if total else {f: 1 / len(fields) for f in fields}
    return {f: x for f, x in w.items() if x}


def record_similarity(pairs: list[tuple[str, Column, Column, bool]], weights: dict[str, float] | None = None, method: str = "levenshtein") -> Column:
    """Weighted similarity of records; pairs are (field, left, right, whether both are numeric). 0 without fields."""
    w = weights_of([p[0] for p in pairs], weights) if pairs else {}
    out = F.lit(0.0)
    for name, a, b, numeric in pairs:
        if name in w:
            out = out + F.lit(w[name]) * null_rule(a, b, numeric_similarity(a, b) if numeric else similarity(a, b, method))
    return out
