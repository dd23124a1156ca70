"""The HTTP routes: over a socket once, else by calling the handlers."""

import json
import threading
import urllib.request

import pytest

from braidwork.plans.engine import Engine
from braidwork.server import Api, serve

EMP = b"emp_id,emp_name,dept,salary\n1,Ann,HR,50000\n2,Bob,IT,60000\n3,Cy,IT,NA\n"
DEP = b"emp_id,location\n1,Rome\n3,Oslo\n9,Bern\n"


@pytest.fixture(scope="module")
def api(spark):
    return Api(Engine(spark))


def test_upload_align_fuse(spark, api):
    status, emp = api("POST", "/datasets/upload?filename=emp.csv&dataset_id=emp", EMP)
    assert status == 201 and emp["row_count"] == 3 and emp["sample"][0]["emp_name"] == "Ann"
    assert api("POST", "/datasets/upload?filename=dep.csv&dataset_id=dep", DEP)[0] == 201
    assert api("GET", "/datasets/")[1]["count"] == 2
    assert [f["field_name"] for f in api("GET", "/datasets/emp")[1].fields] == ["emp_id", "emp_name", "dept", "salary"]
    assert len(api("GET", "/datasets/emp/sample?rows=2")[1]["data"]) == 2
    status, job = api("POST", "/align", json.dumps({"dataset_ids": ["emp", "dep"]}).encode())
    assert status == 201 and any(a.source_field == a.target_field == "emp_id" for a in job.alignments)
    assert api("GET", "/align")[1]["alignments"][0]["datasets"] == ["emp", "dep"] and api("GET", f"/align/{job.job_id}")[1] is job
    one = job.alignments[0]
    assert api("POST", f"/align/{job.job_id}/validate/{one.alignment_id}")[1]["validated"] and one.human_validated
    status, fused = api("POST", "/fuse", json.dumps({"alignment_job_id": job.job_id, "join_strategy": "exact_key", "key": "emp_id"}).encode())
    assert status == 201 and fused["record_count"] == 4
    at = f"/fuse/{fused['fused_dataset_id']}"
    assert api("GET", at)[1] == fused and api("GET", "/fuse/")[1]["count"] == 1
    assert api("GET", at + "/sample?rows=3")[1]["rows"] == 3
    assert spark.read.parquet(api("GET", at + "/download")[1]["path"]).count() == 4
    assert spark.read.option("header", True).csv(api("GET", at + "/download?format=csv")[1]["path"]).count() == 4
    assert api("DELETE", "/datasets/dep") == (204, None) and api("DELETE", "/datasets/dep")[0] == 404


def test_errors(api):
    wanted = {
        404: [("GET", "/datasets/none", b""), ("GET", "/align/none", b""), ("GET", "/fuse/none", b""), ("GET", "/nowhere", b""), ("POST", "/fuse", b"{}"), ("POST", "/align", b'{"dataset_ids": ["x", "y"]}')],
        422: [("POST", "/align", b'{"dataset_ids": ["x"]}'), ("POST", "/align", b"no"), ("POST", "/datasets/upload", b"{}"), ("POST", "/datasets/upload?filename=a.csv&dataset_id=../x", b"a\n1\n")],
        400: [("POST", "/datasets/upload?filename=a.exe", b"x"), ("POST", "/datasets/upload", b'{"source": "/no/such.csv"}')],
    }
    for status, calls in wanted.items():
        assert [(c, api(*c)[0]) for c in calls] == [(c, status) for c in calls]
    api("POST", "/datasets/upload?filename=e.csv&dataset_id=e", EMP)
    assert [api("GET", f"/datasets/e/sample?rows={n}")[0] for n in ("0", "101", "x", "3")] == [422, 422, 422, 200]


def test_over_a_socket(spark):
    server = serve(Engine(spark), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_address[1]}"
        assert json.load(urllib.request.urlopen(base + "/health"))["status"] == "healthy"
        assert len(json.load(urllib.request.urlopen(base + "/"))["routes"]) == 16
        put = urllib.request.Request(base + "/datasets/upload?filename=emp.csv", EMP * 1)
        assert json.load(urllib.request.urlopen(put))["row_count"] == 3
    finally:
        server.shutdown()
        server.server_close()
