"""Sources, the engine's stages from end to end, configuration and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from braidwork import cli, streaming
from braidwork.plans import config
from braidwork.plans.engine import Engine
from braidwork.sources import readers, sniff, writers
from braidwork.types import IngestionError, IngestorConfig


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "emp.csv").write_text("emp_id,emp_name,dept,salary,hire_date,active\n1,Ann,HR,50000,2020-01-01,true\n2,Bob,IT,60000,2021-02-03,false\n3,Cy,IT,NA,2022-05-06,true\n")
    (d / "dep.csv").write_text("emp_id;location;budget\n1;Rome;10.5\n3;Oslo;20\n9;Bern;7\n")
    (d / "latin.csv").write_bytes("id,name\n1,Müller\n".encode("latin-1"))
    (d / "bom.csv").write_bytes(b"\xef\xbb\xbfid\tname\n1\tx\n")
    (d / "late.csv").write_bytes(b"id,name\n" + b"1,plain\n" * 9000 + "2,Müller\n".encode("latin-1"))
    (d / "kana.csv").write_bytes("id,name\n1,カタカナとひらがな\n".encode("shift_jis"))
    (d / "lines.csv").write_text('id,name\n1,"a\nb ""c"""\n2,d\n')
    (d / "empty.csv").write_text("id,name,value\n")
    (d / "rec.json").write_text(json.dumps([{"zeta": 1, "alpha": {"x": [1]}, "m": None}, {"zeta": 2, "alpha": {"x": []}, "m": "q"}]))
    (d / "rec.jsonl").write_text('{"id": 1, "b": "x"}\n{"id": 2, "b": "y"}\n')
    return d


def test_sniffing():
    assert sniff.delimiter("a;b;c\n1,5;2;3") == ";" and sniff.delimiter("abc") == ","
    assert sniff.encoding("é".encode()) == "utf-8" and sniff.encoding("é".encode("latin-1"), True) == sniff.encoding("éa".encode("latin-1")) == "latin-1"
    assert [sniff.source_type(s).value for s in ("a.csv", "b.parquet", "c.jsonl", "d.xlsx", "postgresql://h/d", "https://x.org/api")] == ["csv", "parquet", "json", "excel", "sql", "rest"]
    with pytest.raises(IngestionError):
        sniff.source_type("what")


def test_readers(spark, files):
    emp = readers.read(spark, f"{files}/emp.csv")
    assert dict(emp.dtypes) == {"emp_id": "bigint", "emp_name": "string", "dept": "string", "salary": "bigint", "hire_date": "string", "active": "boolean"}
    assert emp.where("salary IS NULL").count() == 1
    assert dict(readers.read(spark, f"{files}/dep.csv").dtypes)["budget"] == "double"
    assert readers.read(spark, f"{files}/dep.csv", delimiter=",").columns == ["emp_id;location;budget"]
    assert readers.read(spark, f"{files}/latin.csv").first().name == "Müller"
    assert readers.read(spark, f"{files}/late.csv").where("id = 2").first().name == "Müller"  # past what is sniffed
    assert readers.read(spark, f"{files}/kana.csv").first().name == "カタカナとひらがな"
    assert [tuple(r) for r in readers.read(spark, f"{files}/lines.csv").collect()] == [(1, 'a\nb "c"'), (2, "d")]
    assert readers.read(spark, f"{files}/bom.csv").columns == ["id", "name"]
    assert readers.read(spark, f"{files}/empty.csv").count() == 0
    assert readers.read(spark, f"{files}/rec.json").columns == ["zeta", "alpha", "m"]
    assert readers.read(spark, f"{files}/rec.jsonl").count() == 2
    with pytest.raises(IngestionError, match="experimental"):
        readers.read(spark, "https://example.org/api")
    with pytest.raises(IngestionError):
        readers.read(spark, f"{files}/none.csv")
    with pytest.raises(IngestionError, match="query"):
        readers.read(spark, "jdbc:x://h", config=IngestorConfig(experimental_sources=True))


def test_rest_payloads(spark, monkeypatch):
    assert readers.rest_rows([{"a": 1}]) == [{"a": 1}]
    assert readers.rest_rows({"n": 2, "none": [], "items": [{"a": 1}]}) == [{"a": 1}]
    assert readers.rest_rows({"a": 1}) == [{"a": 1}]
    with pytest.raises(IngestionError):
        readers.rest_rows("text")
    import io
    import urllib.request

    monkeypatch.setattr(urllib.request, "urlopen", lambda *a, **k: io.BytesIO(b'{"items": [{"a": 1, "b": {"c": "x"}}, {"a": 2}]}'))
    assert [r.a for r in readers.read_rest(spark, "https://example.org/x").collect()] == [1, 2]


def test_engine_end_to_end(spark, files, tmp_path):
    e = Engine(spark)
    heard = []
    e.subscribe("dataset.fused", heard.append)
    e.subscribe("dataset.fused", lambda _: 1 / 0)
    a, b = e.ingest(f"{files}/emp.csv", "emp", storage=str(tmp_path)), e.ingest(f"{files}/dep.csv", "dep")
    assert a.storage_path.endswith("emp.parquet") and e.get("nothing") is None
    assert [r["emp_id"] for r in e.sample("emp", 2)] == [1, 2]
    m = e.interpret("emp")
    assert {f["field_name"]: f["semantic_type"] for f in m.fields}["hire_date"] == "timestamp" and m.domain_tags == ["hr"]
    found = e.align(["emp", "dep"])
    assert ("emp_id", "emp_id") in {(x.source_field, x.target_field) for x in found.alignments}
    assert e.validate(found.job_id, found.alignments[0].alignment_id).human_validated
    fused = e.fuse(["emp", "dep"], found, output=str(tmp_path / "out"), output_format="parquet")
    assert fused.join_strategy == "exact_key" and fused.record_count == 4 and len(heard) == 1
    got = {r.emp_id: r for r in fused.frame.collect()}
    assert got[3].location == "Oslo" and got[9].emp_name is None and got[3].salary == 55000.0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    assert spark.read.option("header", True).csv(e.download(fused.fused_dataset_id, str(tmp_path / "one"), "csv")).count() == 4
    assert spark.sql("SELECT COUNT(*) FROM emp").first()[0] == 3
    r = e.analyze(fused.frame, ("statistics", "correlations", "outliers", "narrative"))
    assert r.row_count == 4 and r.narrative and {s["field_name"] for s in r.statistics} >= {"salary", "budget"}
    assert e.drop("emp") and not e.drop("emp")


def test_strategies_and_failing_provider(spark, files):
    class Broken:
        def embed(self, texts):
            raise RuntimeError("no")

        complete = embed

    e = Engine(spark, provider=Broken())
    e.ingest(f"{files}/emp.csv", "emp")
    e.ingest(f"{files}/dep.csv", "dep")
    m = e.interpret("emp")
    assert m.description.startswith("Dataset with 3 rows") and m.fields[0]["semantic_type"] == "identifier"
    found = e.align(["emp", "dep"])
    for strategy in ("semantic_similarity", "probabilistic"):  # the latter is off and reported as what ran
        assert e.fuse(["emp", "dep"], found, strategy).join_strategy == "semantic_similarity"
    e.config.fusion.experimental_strategies = True
    assert e.fuse(["emp", "dep"], found, "probabilistic").record_count >= 4
    assert e.fuse(["emp", "dep"], found, key="emp_id").record_count == 4
    alone = e.register(spark.range(2).withColumnRenamed("id", "q"), "alone")
    assert e.fuse(["emp", alone.dataset_id], found).source_datasets == ["emp"]


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("fusion:\n  max_null_ratio: 0.2\nalignment:\n  scoring_weights:\n    name: 0.5\n")
    c = config.load(str(tmp_path / "c.yaml"), {"BRAIDWORK_FUSION__MAX_NULL_RATIO": "0.3", "BRAIDWORK_INSIGHT__CLUSTERING": "true", "OTHER": "1"})
    assert c.fusion.max_null_ratio == 0.3 and c.insight.clustering is True and c.alignment.scoring_weights.name == 0.5
    assert c.alignment.synonym_threshold == 0.85


def test_cli(spark, files, capsys):
    assert cli.main(["fuse", f"{files}/emp.csv", f"{files}/dep.csv", "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out)["records"] == 4
    assert cli.main(["describe", f"{files}/emp.csv"]) == 0
    assert "hire_date" in capsys.readouterr().out
    assert cli.main(["ingest", f"{files}/absent.csv"]) == 1


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 0.0), (2, float("nan"))], "id int, temp double").write.parquet(src)
    s = streaming.harmonize(streaming.read_stream(spark, src, spark.read.parquet(src).schema), {"temp": "temp_f"}, {"temp": "unit_conversion:celsius_to_fahrenheit"})
    q = s.writeStream.format("memory").queryName("harmonized").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.sql("SELECT id, temp_f FROM harmonized").collect()) == [(1, 32.0), (2, None)]
    with pytest.raises(ValueError):
        streaming.harmonize(s, {}, {"temp_f": "type_cast:string->integer"})


def test_writer(spark, tmp_path):
    df = spark.range(3).withColumn("__row_id", F.col("id"))
    assert spark.read.parquet(writers.write(df, str(tmp_path / "p"))).columns == ["id"]
    with pytest.raises(ValueError):
        writers.write(df, str(tmp_path / "q"), "xml")
