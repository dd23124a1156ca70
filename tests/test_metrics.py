"""Stage records, job groups, structured logs, and counts that cost no pass of their own."""

import io
import json
import logging

import pytest
from pyspark.sql import functions as F

from braidwork.functions import transforms
from braidwork.operators.rows import ROW_ID, numbered
from braidwork.plans import metrics
from braidwork.plans.engine import Alignment, AlignmentResult, Engine


def jobs(spark, group):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_stage_records(spark):
    sc, heard = spark.sparkContext, []
    sc.setJobGroup("mine", "what ran before")
    with metrics.stage(spark, "outer", heard.append, dataset_id="d") as said:
        spark.range(3).count()
        with metrics.stage(spark, "inner", heard.append):
            spark.range(4).count()
        spark.range(5).count()
        said["rows_out"] = 8
    assert sc.getLocalProperty("spark.jobGroup.id") == "mine" and metrics.correlation.get() is None
    inner, outer = heard
    assert outer["rows_out"] == 8 and outer["dataset_id"] == "d" and outer["status"] == inner["status"] == "ok" and outer["seconds"] >= inner["seconds"] >= 0
    assert inner["correlation_id"] == outer["correlation_id"] == outer["stage_id"] and inner["parent"] == outer["stage_id"] and outer["parent"] is None
    assert jobs(spark, outer["stage_id"]) >= 2 and jobs(spark, inner["stage_id"]) >= 1
    with pytest.raises(ZeroDivisionError), metrics.stage(spark, "broken", heard.append):
        1 / 0
    assert heard[-1]["status"] == "failed" and heard[-1]["error"].startswith("ZeroDivisionError")
    assert heard[-1]["correlation_id"] != outer["correlation_id"]
    for k in ("spark.jobGroup.id", "spark.job.description"):
        sc.setLocalProperty(k, None)


def test_json_lines(spark):
    stream = io.StringIO()
    handler = metrics.log_to(stream)
    try:
        with metrics.stage(spark, "read", lambda _: None, source="x") as said:
            logging.getLogger("braidwork").info("plain %d", 7, extra={"rows": 3})
            said["rows_out"] = 5
        try:
            raise ValueError("no")
        except ValueError:
            logging.getLogger("braidwork").exception("it failed")
    finally:
        logging.getLogger("braidwork").removeHandler(handler)
    plain, done, failed = [json.loads(line) for line in stream.getvalue().splitlines()]
    assert plain["message"] == "plain 7" and plain["rows"] == 3 and plain["level"] == "INFO" and plain["logger"] == "braidwork"
    assert done["metrics"]["rows_out"] == 5 and done["metrics"]["source"] == "x" and done["correlation_id"] == plain["correlation_id"]
    assert "ValueError: no" in failed["exception"] and "correlation_id" not in failed


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_observed_counts(spark, tmp_path, n):
    df = spark.range(n).repartition(7).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).alias("a.b"), F.lit("x").alias("n"), F.col("id").alias("__hidden"))
    out, told = metrics.observed(df)
    out.write.parquet(str(tmp_path / "out"))
    assert told() == (n, {"id": 0, "a.b": n - len(range(0, n, 3)), "n": 0})
    assert numbered(df)[1] == n


def test_counts_come_with_the_writing(spark, tmp_path):
    e, heard = Engine(spark), []
    e.subscribe("stage.finished", heard.append)
    people = spark.createDataFrame([(1, 10.0, 20.0), (2, None, 25.0), (3, 30.0, None)], "k int, pay double, warm double")
    towns = spark.createDataFrame([(1, 0.0, "5"), (3, 100.0, None), (9, None, "x")], "key int, heat double, size string")
    a, b = e.register(people, "people", storage=str(tmp_path)), e.register(towns, "towns")
    assert (a.rows, a.nulls) == (3, {"k": 0, "pay": 1, "warm": 1}) and (b.rows, b.nulls) == (3, None)
    edges = [Alignment("1", "people", "k", "towns", "key", 1.0, "exact"), Alignment("2", "people", "warm", "towns", "heat", 0.9, "exact", "unit_conversion:celsius_to_fahrenheit"), Alignment("3", "people", "pay", "towns", "size", 0.8, "related", "type_cast:string->float")]
    fused = e.fuse(["people", "towns"], AlignmentResult("j", edges, [], ["people", "towns"]), output=str(tmp_path / "fused"), output_format="parquet")
    sc = spark.sparkContext
    sc.setJobGroup("probe", "none may run")
    assert fused.record_count == fused.rows == 4 and jobs(spark, "probe") == 0
    for k in ("spark.jobGroup.id", "spark.job.description"):
        sc.setLocalProperty(k, None)
    written = spark.read.parquet(str(tmp_path / "fused"))
    assert written.count() == 4 and fused.nulls_left == {c: written.where(F.col(c).isNull()).count() for c in written.columns}
    assert [(t["field"], t["operation"], t["template"], t["sample_before"], t["sample_after"], t["records_affected"]) for t in fused.transformations] == [
        ("heat", "unit_conversion", "celsius_to_fahrenheit", "0.0", "32.0", 2),
        ("size", "type_cast", "string->float", "5", "5.0", 3),
    ]
    said = next(x["payload"] for x in heard if x["payload"]["stage"] == "fuse")
    assert said["rows_in"] == {"people": 3, "towns": 3} and said["rows_out"] == 4 and said["nulls_filled"] == fused.imputation.total_nulls_filled and said["nulls_left"] == fused.nulls_left
    assert said["merges"] == [{"strategy": "exact_key", "rows_out": 4, "values_transformed": 5}] and said in e.metrics
    with pytest.raises(Exception):
        e.fuse(["people", "nobody"], AlignmentResult("j", edges, []))
    assert e.metrics[-1]["status"] == "failed"


def test_transforms_are_logged_in_one_pass(spark):
    df = spark.createDataFrame([(2, 1.0, "7"), (1, None, "8"), (0, None, None)], f"{ROW_ID} int, t double, s string")
    hints = [("t", "unit_conversion:kg_to_lb"), ("none", "type_cast:string->float"), ("t", "unit_conversion:lb_to_kg"), ("s", "type_cast:string->integer"), ("s", "unknown:x")]
    after, told = transforms.applied(df, hints, ROW_ID)
    assert after.columns == df.columns and [(r.t, r.s) for r in after.orderBy(ROW_ID).collect()] == [(None, None), (None, 8), (pytest.approx(1.0), 7)]
    assert [(r.field, r.template, r.sample_before, r.records_affected) for r in told.collect()] == [("t", "kg_to_lb", "1.0", 1), ("t", "lb_to_kg", "2.20462", 1), ("s", "string->integer", "8", 3)]
    assert told._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    same, none = transforms.applied(df, [], ROW_ID)
    assert same is df and none.count() == 0
