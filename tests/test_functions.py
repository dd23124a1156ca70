"""Similarity, vectors, transforms and validation against values worked out from their definitions."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from braidwork.functions import similarity as sim
from braidwork.functions import transforms, validate, vectors
from braidwork.types import ValidationError


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcé ", max_size=30), st.text("abcé ", max_size=30))
def test_lcs_and_ratios(a, b):
    assert sim.lcs_length(a, b) == brute_lcs(a, b)
    for method in sim.METHODS:
        assert 0 <= sim.string_similarity(a, b, method) <= 1
    assert sim.ratio(a, b) == sim.ratio(b, a)


def test_string_similarity():
    assert sim.string_similarity("kitten", "sitting") == 0.62
    assert sim.string_similarity("employee_id", "emp_id") == 0.71
    assert sim.string_similarity("annual salary", "salary annual") == 0.46
    assert sim.string_similarity("annual salary", "salary annual", "token_sort") == 1.0
    assert sim.string_similarity("employee name", "name", "token_set") == 1.0
    assert sim.string_similarity("abc", "xxabcxx", "partial") == 1.0
    assert sim.partial_ratio("abcd", "xxab") == 0.67  # the window is cut off at the end: "ab"
    assert sim.partial_ratio("", "abc") == 0.0
    assert sim.token_sort_ratio("net_pay", "pay net") < 1.0  # an underscore is a letter
    assert sim.token_sort_ratio("Größe 1", "grsse 1 ".replace("ss", "")) > 0.8  # ö and ß are dropped
    assert sim.string_similarity(" A ", "a") == 1.0
    assert sim.string_similarity("", "a") == sim.string_similarity(None, "a") == 0.0
    with pytest.raises(ValueError):
        sim.string_similarity("a", "b", "nonsense")


def test_columns_and_bounds(spark):
    rows = [("kitten", "sitting"), (None, "a"), ("same", "same"), ("a", "abcdefghij")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(sim.similarity(F.col("a"), F.col("b")).alias("s"), sim.ratio_bound(F.col("a"), F.col("b")).alias("m")).collect()
    assert [r.s for r in got] == [0.62, 0.0, 1.0, 0.18]
    assert all(r.s <= r.m for r in got if r.m is not None)


def test_sets(spark):
    df = spark.createDataFrame([(["a", "b", "b"], ["b", "c"]), ([], []), (["a"], [])], "a array<string>, b array<string>")
    got = df.select(sim.jaccard(F.col("a"), F.col("b")), sim.dice(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(1 / 3, 0.5), (1.0, 1.0), (0.0, 0.0)]
    one = spark.createDataFrame([("Night", "nacht"), ("a", "a")], "a string, b string").select(sim.ngram_similarity(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in one] == [1 / 7, 1.0]


def test_record_similarity(spark):
    df = spark.createDataFrame([(1.0, 2.0, None, None), (None, 1.0, 4.0, 4.0), (0.0, 0.0, -1.0, 1.0)], "a double, b double, c double, d double")
    pairs = [("x", F.col("a"), F.col("b"), True), ("y", F.col("c"), F.col("d"), True)]
    assert [r[0] for r in df.select(sim.record_similarity(pairs)).collect()] == [0.75, 0.5, 0.5]
    assert [r[0] for r in df.select(sim.record_similarity(pairs, {"x": 1})).collect()] == [0.5, 0.0, 1.0]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [-4.0, 3.0]), (4, [1.0])], "id int, v array<float>")
    q = F.array(F.lit(3.0), F.lit(4.0))
    got = df.select(vectors.cosine(F.col("v"), q), vectors.euclidean(F.col("v"), q), vectors.normalize(F.col("v"))).collect()
    assert [r[0] for r in got] == [1.0, None, 0.0, None]
    assert [r[1] for r in got][:2] == [0.0, 5.0]
    assert got[0][2] == pytest.approx([0.6, 0.8]) and got[1][2] is None
    assert [r.id for r in vectors.find_similar([3, 4], df, "v", "id", 5).collect()] == [1, 3]
    mean = vectors.average(df.where("id <= 3"), "v").first()["average"]
    assert mean == pytest.approx([-1 / 3, 7 / 3])
    with pytest.raises(ValueError):
        vectors.combine([F.col("v")], [0.5])


def test_embedding(spark):
    a, b = vectors.embed("employee_name", 64), vectors.embed("Employee-Name", 64)
    assert np.allclose(a, b) and np.isclose(np.linalg.norm(a), 1) and not vectors.embed(" _ ", 8).any()
    assert vectors.embed("worker_name", 64) @ a > 0.2
    got = spark.createDataFrame([("employee_name",)], "t string").select(vectors.embedding(F.col("t"), 64)).first()[0]
    assert np.allclose(got, a)


def test_transforms(spark):
    df = spark.createDataFrame([(1, 0.0, "1.5"), (2, 100.0, "bad"), (3, None, None)], "id int, t double, s string")
    assert [r.t for r in transforms.apply_hint(df, "t", "unit_conversion:celsius_to_fahrenheit").collect()] == [32.0, 212.0, None]
    assert [r.t for r in transforms.apply_hint(df, "t", "unit_conversion:celsius_to_fahrenheit_inverse").collect()][1] == pytest.approx(37.7778, abs=1e-3)
    assert [r.s for r in transforms.cast(df, "s", "float").collect()] == [1.5, None, None]
    assert dict(transforms.cast(df, "s", "integer").dtypes)["s"] == "string"  # a fraction is in the way
    assert [r.t for r in transforms.cast(df, "t", "integer").collect()] == [0, 100, None]
    assert [r.t for r in transforms.cast(df, "t", "string").collect()][2] is None
    assert transforms.cast(df, "s", "boolean") is df
    assert transforms.apply_hint(df, "absent", "type_cast:string->float") is df
    hint = "unit_conversion:celsius_to_fahrenheit"
    log = transforms.applied(df, [("t", hint)], "id")[1].first()
    assert (log.records_affected, log.sample_before, log.sample_after) == (2, "0.0", "32.0")
    transforms.register_transform("twice_and_one", "value * 2 + 1")
    assert df.select(transforms.unit("twice_and_one", F.col("t"))).collect()[1][0] == 201.0
    with pytest.raises(ValueError):
        transforms.resolve("no_such_thing")


def test_sanitize_and_checks(spark, tmp_path):
    df = spark.createDataFrame([(" <a href=\"x\">'&'</a>\x00\n ",), (None,), ("x" * 2000,)], "s string")
    got = [r[0] for r in df.select(validate.sanitize(F.col("s"))).collect()]
    assert got == ["&lt;a href=&quot;x&quot;&gt;&#x27;&amp;&#x27;&lt;/a&gt;", "", "x" * 1000]
    assert [r[0] for r in df.select(validate.is_identifier(F.col("s"))).collect()] == [False, False, False]
    assert validate.check_identifier("col_1") == "col_1"
    for bad in ("1a", "select", "a b", "", "a" * 129):
        with pytest.raises(ValidationError):
            validate.check_identifier(bad)
    with pytest.raises(ValidationError):
        validate.check_dataset_id("-x")
    with pytest.raises(ValidationError):
        validate.check_url("http://127.0.0.1/x")
    assert validate.check_url("https://example.org/x")
    with pytest.raises(ValidationError):
        validate.check_path("../etc/passwd")
    f = tmp_path / "a.csv"
    f.write_text("x")
    assert validate.check_path(str(f), (".csv",), 1) == str(f)
    assert validate.check_field_name("a\x01b ") == "ab"
    with pytest.raises(ValidationError):
        validate.check_range(5, 0, 4)
    with pytest.raises(ValidationError):
        validate.check_length([], 1)
