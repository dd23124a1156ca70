"""Best matches against all pairs, and how many pairs are looked at."""

import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.functions.similarity import ratio, string_similarity, weights_of
from braidwork.operators import grams, joins, sweep


def near(a, b):
    return 1 - min(abs(a - b) / max(abs(a), abs(b), 1e-10), 1)


def field(a, b, numeric, method):
    if a is None or b is None:
        return float(a is b)
    return near(a, b) if numeric else string_similarity(a, b, method)


def plain(left, right, numeric, weights, threshold, k, method="levenshtein", inclusive=False):
    """(left id, right id) of the k best, by brute force; rows are (id, values...)."""
    names = [str(i) for i in range(len(numeric))]
    w = weights_of(names, dict(zip(names, weights)) if weights else None)
    out = {}
    for i, *a in left:
        scored = [(-sum(w.get(n, 0) * field(x, y, t, method) for n, x, y, t in zip(names, a, b, numeric)), j) for j, *b in right]
        best = sorted((round(s, 12), j) for s, j in scored if (-s >= threshold - 1e-12 if inclusive else -s > threshold + 1e-12))[:k]
        if best:
            out[i] = [j for _, j in best]
    return out


def frame(spark, rows, side, numeric):
    columns = ", ".join(f"{side}{n} {'double' if t else 'string'}" for n, t in enumerate(numeric))
    return spark.createDataFrame(rows, f"{side}id bigint, {columns}")


def matched(spark, left, right, numeric, weights, threshold, k=None, method="levenshtein", seen=None):
    pairs = [(f"l{i}", f"r{i}") for i in range(len(numeric))]
    w = dict(zip([a for a, _ in pairs], weights)) if weights else None
    sides = frame(spark, left, "l", numeric), frame(spark, right, "r", numeric)
    if k is None:
        return {x.left_id: [x.right_id] for x in joins.best_matches(*sides, pairs, "lid", "rid", threshold, w, method, seen).collect()}
    got = {}
    for x in joins.all_matches(*sides, pairs, "lid", "rid", threshold, k, w, method, seen).orderBy("left_id", "rank").collect():
        got.setdefault(x.left_id, []).append(x.right_id)
    return got


def words(r, n, letters="abcde fé", longest=14):
    return "".join(r.choice(letters) for _ in range(r.randint(0, longest)))


def typo(r, s):
    s = list(s)
    for _ in range(r.randint(0, 3)):
        at = r.randint(0, len(s))
        s[at : at + r.randint(0, 1)] = r.choice(["", "x", "A"])
    return "".join(s)


def test_numbers_in_turn(spark):
    r = random.Random(1)
    value = lambda: None if r.random() < 0.1 else r.choice([0.0, 1e-11, -3.0, 50.0, round(r.uniform(-100, 100), 1), r.uniform(1, 1e6)])
    left, right = [(i, value()) for i in range(150)], [(500 - j, value()) for j in range(120)]
    assert matched(spark, left, right, [True], None, 0.3) == plain(left, right, [True], None, 0.3, 1)
    assert matched(spark, left, right, [True], None, 0.7, 4) == plain(left, right, [True], None, 0.7, 4, inclusive=True)
    assert matched(spark, left, [], [True], None, 0.7) == {} == matched(spark, [], right, [True], None, 0.7)


def test_several_fields(spark):
    r = random.Random(2)
    row = lambda i: (i, r.choice([None, 10.0, float(r.randint(80, 120))]), r.choice([None, float(r.randint(1, 9))]), r.choice([None, "", "  ", "red", "Red ", "rod", "green", "greens"]))
    left, right = [row(i) for i in range(90)], [row(900 - j) for j in range(70)]
    kinds = [True, True, False]
    for weights, threshold in (((0.6, 0.1, 0.3), 0.7), ((0.2, 0.2, 0.6), 0.75), (None, 0.2)):
        assert matched(spark, left, right, kinds, weights, threshold) == plain(left, right, kinds, weights, threshold, 1), weights
    assert matched(spark, left, right, kinds, (0.5, 0.2, 0.3), 0.6, 3) == plain(left, right, kinds, (0.5, 0.2, 0.3), 0.6, 3, inclusive=True)


@pytest.mark.parametrize("threshold", [0.4, 0.85])
def test_strings_by_grams(spark, threshold):
    r = random.Random(3)
    texts = [words(r, 0) for _ in range(60)] + ["".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(15, 60))) for _ in range(60)] + [None, "", " ", "\t", "a", "A", "ab"]
    left = [(i, t) for i, t in enumerate(texts)]
    right = [(1000 - j, None if t is None else typo(r, t)) for j, t in enumerate(texts)]
    assert matched(spark, left, right, [False], None, threshold) == plain(left, right, [False], None, threshold, 1)
    if threshold == 0.85:
        assert matched(spark, left, right, [False], None, threshold, 3) == plain(left, right, [False], None, threshold, 3, inclusive=True)


def test_other_ratios(spark):
    r = random.Random(4)
    texts = ["red small ring", "small red ring", "ring", "the ring of red", "", "blue", None]
    left, right = [(i, t) for i, t in enumerate(texts)], [(20 - j, t) for j, t in enumerate(r.sample(texts, len(texts)))]
    for method in ("token_sort", "token_set", "partial"):
        assert matched(spark, left, right, [False], None, 0.6, method=method) == plain(left, right, [False], None, 0.6, 1, method), method


def test_grams_lose_no_pair(spark):
    r = random.Random(5)
    texts = sorted({words(r, 0, "abc ", 25).strip() for _ in range(150)})
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, s string")
    index = grams.Index(df, df)
    for above in (0.96, 0.91, 0.85, 0.72, 0.5, 0.2):
        rows = [tuple(x) for x in index.candidates(above).collect()]
        assert len(rows) == len(set(rows))
        want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if ratio(a, b) > above}
        assert want <= set(rows), above


def test_looks_grow_with_the_rows_alone(spark):
    r = np.random.default_rng(6)
    looked = {}
    for n in (500, 4000):
        rows = lambda at, n=n: [(at + i, float(x)) for i, x in enumerate(np.round(r.uniform(1, 10_000, n), 2))]
        looked[n] = []
        matched(spark, rows(0), rows(10**6), [True], None, 0.7, seen=looked[n].append)
    assert sum(looked[4000]) < 9 * sum(looked[500]) and sum(looked[4000]) < 10 * 4000


def test_few_pairs_of_strings(spark):
    r = random.Random(7)
    colours, things = ["red", "blue", "small", "large", "cold", "old", "hot", "green"], ["ring", "bolt", "rod", "plate", "gear", "widget", "gizmo", "nut"]
    names = sorted({f"{r.choice(colours)} {r.choice(things)} no {r.randint(100000, 999999)} lot {r.randint(1000, 9999)}" for _ in range(800)})
    left, right, looked = list(enumerate(names)), [(j, typo(r, t)) for j, t in enumerate(names)], []
    got = matched(spark, left, right, [False], None, 0.85, seen=looked.append)
    assert sum(looked) < 0.05 * len(names) ** 2
    sample = left[::40]
    assert plain(sample, right, [False], None, 0.85, 1) == {i: got[i] for i, _ in sample if i in got}


def test_no_cross_join(spark):
    sides = frame(spark, [(1, "a red ring", 2.0)], "l", [False, True]), frame(spark, [(1, "a red rings", 2.1)], "r", [False, True])
    for pairs in ([("l0", "r0")], [("l0", "r0"), ("l1", "r1")]):
        plan = joins.best_matches(*sides, pairs, "lid", "rid", 0.8)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_sweep_keeps_keys_apart(spark):
    r = random.Random(8)
    left = [(r.randint(0, 3), float(r.randint(0, 20)), i, r.random()) for i in range(60)]
    right = [(r.randint(0, 4), float(r.randint(0, 20)), 100 + j, r.random()) for j in range(50)]
    side = lambda rows, i, x: spark.createDataFrame(rows, f"key int, v double, {i} int, w double").select("key", "v", i, F.struct("v", "w").alias(x))
    cost = lambda x, y: F.sqrt((x["v"] - y["v"]) * (x["v"] - y["v"]) + (x["w"] - y["w"]) * (x["w"] - y["w"]))
    got = {x.lid: [b.rid for b in x.best] for x in sweep.nearest(side(left, "lid", "x"), side(right, "rid", "y"), cost, lambda x, v, e: F.abs(v - e), 3).collect()}
    for key, v, i, w in left:
        want = sorted((((v - b) ** 2 + (w - c) ** 2) ** 0.5, j) for k, b, j, c in right if k == key)[:3]
        assert got.get(i, []) == [j for _, j in want]


def in_turn(left, right, score, threshold):
    """Left rows in order take their best free right row, the first on ties."""
    used, out = set(), {}
    for i, a in sorted(left):
        best = max(((score(a, b), -j) for j, b in right if j not in used), default=None)
        if best and best[0] > threshold:
            out[i] = -best[1]
            used.add(-best[1])
    return out


def one_to_one(spark, left, right, kind, threshold):
    sides = spark.createDataFrame(left, f"l bigint, a {kind}"), spark.createDataFrame(right, f"r bigint, b {kind}")
    got = joins.probabilistic_matches(*sides, [("a", "b")], "l", "r", threshold).collect()
    assert len({x.right_id for x in got}) == len({x.left_id for x in got}) == len(got)
    return {x.left_id: x.right_id for x in got}


def test_one_to_one_of_numbers(spark):
    r = random.Random(9)
    for values in ([8.0, 10.0, 12.5, 15.625], [r.uniform(90, 110) for _ in range(25)]):  # in the second, ties
        left, right = [(i, r.choice([*values, None])) for i in range(60)], [(j, r.choice(values)) for j in r.sample(range(100, 200), 45)]
        score = lambda a, b: 0.0 if a is None else 1 - abs(a - b) / max(abs(a), abs(b), 1e-9)
        assert one_to_one(spark, left, right, "double", 0.75) == in_turn(left, right, score, 0.75), values


def test_one_to_one_of_strings(spark):
    r = random.Random(10)
    names = ["anna b", "anna c", "anne b", "hanna b", "bob", "bobby", "100", "101", "99.5", "", "zz"]
    left, right = [(i, r.choice([*names, None])) for i in range(50)], [(100 + j, r.choice(names)) for j in range(40)]

    def score(a, b):
        if a is None:
            return 0.0
        try:
            return 1 - abs(float(a) - float(b)) / max(abs(float(a)), abs(float(b)), 1e-9)
        except ValueError:
            return string_similarity(a, b)

    assert one_to_one(spark, left, right, "string", 0.7) == in_turn(left, right, score, 0.7)


def test_one_to_one_of_many_equals(spark):
    n = 20_000
    got = one_to_one(spark, [(i, 5.0) for i in range(n)], [(3 * j, 5.0) for j in range(n)], "double", 0.9)
    assert got == {i: 3 * i for i in range(n)}


@pytest.mark.parametrize("threshold", [0.0, 0.4, 0.97])
def test_one_to_one_of_numbers_in_ranges(spark, threshold, monkeypatch):
    r = random.Random(11)
    value = lambda: r.choice([0.0, 1e-10, -1e-10, 5.0, round(r.uniform(-20, 90), 1), round(r.uniform(80, 120), 1), None])
    left, right = [(i, value()) for i in r.sample(range(2000), 400)], [(3000 - j, value()) for j in range(150)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # four ranges, however few rows
    monkeypatch.setattr(joins, "TOGETHER", 1, raising=False)
    try:
        score = lambda a, b: 0.0 if a is None or b is None else 1 - abs(a - b) / max(abs(a), abs(b), 1e-9)
        assert one_to_one(spark, left, right, "double", threshold) == in_turn(left, right, score, threshold)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rounds_of_numbers_do_not_grow_with_the_wishes(spark, monkeypatch):
    r = random.Random(12)
    left, right = [(i, r.uniform(99, 101)) for i in range(240)], [(1000 + j, r.uniform(99, 101)) for j in range(40)]
    rounds, once = [], joins.checkpoint
    monkeypatch.setattr(joins, "checkpoint", lambda df: rounds.append(1) or once(df))
    score = lambda a, b: 1 - abs(a - b) / max(abs(a), abs(b))
    assert one_to_one(spark, left, right, "double", 0.9) == in_turn(left, right, score, 0.9)
    assert len(rounds) < 10
