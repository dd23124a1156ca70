"""The engine over HTTP, as JSON. Every route is one call of the engine; tables stay in Spark and its shared folder.

    POST   /datasets/upload?filename=&dataset_id=   the body is the file; or JSON {"source", "dataset_id"} of one that Spark reads
    GET    /datasets/  /datasets/{id}  /datasets/{id}/sample?rows=      DELETE /datasets/{id}
    POST   /align {"dataset_ids", "confidence_threshold", "include_partial_matches"}      POST /align/{job}/validate/{alignment}
    GET    /align/  /align/{job}
    POST   /fuse {"alignment_job_id", "join_strategy", "imputation_method", "key", "output", "output_format"}
    GET    /fuse/  /fuse/{id}  /fuse/{id}/sample?rows=  /fuse/{id}/download?format=
    GET    /health  /

An upload is copied to the shared folder piece by piece. A download is written there by the executors and answered by its
path: a fused table may be larger than any one machine. Unknown ids are 404, invalid values 422, failed stages 400.
"""

from __future__ import annotations

import argparse
import json
import logging
import re
import uuid
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from io import BytesIO
from typing import BinaryIO
from urllib.parse import parse_qsl, unquote, urlsplit

from .operators.rows import ROW_ID
from .plans.config import EngineConfig, load
from .plans.engine import Engine, FusionResult, Metadata
from .session import session, shared_folder
from .types import EngineError, ValidationError

_log = logging.getLogger("braidwork")
UPLOADS = (".csv", ".parquet", ".json", ".jsonl", ".xlsx", ".xls")
PIECE = 1 << 20


class NotFound(EngineError): ...


class Request:
    """Path values, query values and the body, which is read only by the route that wants it."""

    def __init__(self, values: dict[str, str], query: dict[str, str], body: BinaryIO, length: int, kind: str):
        self.values, self.query, self.body, self.length, self.kind = values, query, body, length, kind

    def json(self) -> dict:
        try:
            got = json.loads(self.body.read(self.length) or b"{}")
        except ValueError as e:
            raise ValidationError("The body is not JSON") from e
        if not isinstance(got, dict):
            raise ValidationError("The body must be a JSON object")
        return got

    def rows(self, most: int) -> int:
        text = self.query.get("rows", "10")
        if not text.isdigit() or not 1 <= int(text) <= most:
            raise ValidationError(f"rows must be a number from 1 to {most}")
        return int(text)


def _known(held: dict, key: str, what: str):
    if key not in held:
        raise NotFound(f"No {what} {key}")
    return held[key]


class Api:
    """Answers (status, JSON value) for a method, a path and a body; serve() puts it behind a socket."""

    def __init__(self, engine: Engine):
        self.engine = engine
        self.routes: list[tuple[str, re.Pattern, int, Callable[[Request], object]]] = []
        for line, status, handler in (
            ("POST /datasets/upload", 201, self.upload), ("GET /datasets/", 200, self.list_datasets),
            ("GET /datasets/{id}", 200, self.metadata), ("GET /datasets/{id}/sample", 200, self.sample),
            ("DELETE /datasets/{id}", 204, self.delete), ("POST /align", 201, self.align), ("GET /align/", 200, self.list_alignments),
            ("GET /align/{id}", 200, self.alignment), ("POST /align/{id}/validate/{alignment}", 200, self.validate),
            ("POST /fuse", 201, self.fuse), ("GET /fuse/", 200, self.list_fused), ("GET /fuse/{id}", 200, self.fused),
            ("GET /fuse/{id}/sample", 200, self.fused_sample), ("GET /fuse/{id}/download", 200, self.download),
            ("GET /health", 200, self.health), ("GET /", 200, self.root),
        ):
            method, path = line.split(" ")
            shape = re.sub(r"\{(\w+)\}", r"(?P<\1>[^/]+)", path.rstrip("/"))
            self.routes.append((method, re.compile(shape + "/?"), status, handler))

    def __call__(self, method: str, target: str, body: bytes | BinaryIO = b"", length: int | None = None, kind: str = "application/json") -> tuple[int, object]:
        if isinstance(body, bytes):
            body, length = BytesIO(body), len(body)
        url = urlsplit(target)
        try:
            for verb, shape, status, handler in self.routes:
                met = shape.fullmatch(url.path) if verb == method else None
                if met:
                    values = {k: unquote(v) for k, v in met.groupdict().items()}
                    return status, handler(Request(values, dict(parse_qsl(url.query)), body, length or 0, kind))
            raise NotFound(f"No route {method} {url.path}")
        except EngineError as e:
            status = 404 if isinstance(e, NotFound) else 422 if isinstance(e, ValidationError) else 400
            return status, {"error": type(e).__name__, "detail": str(e)}
        except Exception as e:
            _log.exception("%s %s failed", method, target)
            return 500, {"error": type(e).__name__, "detail": str(e)}

    # datasets

    def upload(self, r: Request) -> dict:
        name, told = r.query.get("filename"), {}
        if name is None:
            told = r.json()
            source = told.get("source") or ""
            if not source:
                raise ValidationError("Name the file in ?filename=, or a source in the body")
        else:
            suffix = next((s for s in UPLOADS if name.lower().endswith(s)), None)
            if suffix is None:
                raise EngineError(f"Unsupported file type: {name}; known are {', '.join(UPLOADS)}")
            source = self._store(r, suffix)
        d = self.engine.ingest(source, r.query.get("dataset_id") or told.get("dataset_id"))
        if d.rows is None:  # the file came with row numbers of its own
            d.rows = d.frame.count()
        return {"dataset_id": d.dataset_id, "source_type": d.source_type, "row_count": d.rows, "fields": [{"name": f.name, "type": f.dataType.simpleString()} for f in d.frame.drop(ROW_ID).schema], "sample": self.engine.sample(d.dataset_id)}

    def _store(self, r: Request, suffix: str) -> str:
        spark = self.engine.spark
        path = f"{shared_folder(spark)}/uploads/{uuid.uuid4().hex}{suffix}"
        file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        out = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(file)
        try:
            left = r.length
            while left > 0 and (piece := r.body.read(min(PIECE, left))):
                out.write(bytearray(piece))
                left -= len(piece)
        finally:
            out.close()
        return path

    def list_datasets(self, r: Request) -> dict:
        held = self.engine.datasets.values()
        return {"count": len(held), "datasets": [{"dataset_id": d.dataset_id, "row_count": d.rows, "field_count": len(d.frame.drop(ROW_ID).columns), "source_type": d.source_type} for d in held]}

    def metadata(self, r: Request) -> Metadata:
        _known(self.engine.datasets, r.values["id"], "dataset")
        return self.engine.interpret(r.values["id"])

    def sample(self, r: Request) -> dict:
        _known(self.engine.datasets, r.values["id"], "dataset")
        data = self.engine.sample(r.values["id"], r.rows(100))
        return {"dataset_id": r.values["id"], "rows": len(data), "data": data}

    def delete(self, r: Request) -> None:
        if not self.engine.drop(r.values["id"]):
            raise NotFound(f"No dataset {r.values['id']}")

    # alignments

    def align(self, r: Request) -> object:
        told = r.json()
        ids = told.get("dataset_ids")
        if not isinstance(ids, list) or len(ids) < 2:
            raise ValidationError("dataset_ids must list two datasets or more")
        for i in ids:
            _known(self.engine.datasets, i, "dataset")
        return self.engine.align(ids, told.get("confidence_threshold"), told.get("include_partial_matches", True))

    def list_alignments(self, r: Request) -> dict:
        held = self.engine.alignments.values()
        return {"count": len(held), "alignments": [{"job_id": a.job_id, "datasets": a.datasets, "alignment_count": len(a.alignments)} for a in held]}

    def alignment(self, r: Request) -> object:
        return _known(self.engine.alignments, r.values["id"], "alignment job")

    def validate(self, r: Request) -> dict:
        job, one = _known(self.engine.alignments, r.values["id"], "alignment job"), r.values["alignment"]
        _known({a.alignment_id: a for a in job.alignments}, one, "alignment")
        told = r.query.get("validated", "true").lower() in ("true", "1", "yes")
        self.engine.validate(job.job_id, one, told)
        return {"status": "updated", "alignment_id": one, "validated": told}

    # fused tables

    def fuse(self, r: Request) -> dict:
        told = r.json()
        job = _known(self.engine.alignments, told.get("alignment_job_id"), "alignment job")
        for i in job.datasets:
            _known(self.engine.datasets, i, "dataset")
        try:
            f = self.engine.fuse(job.datasets, job, told.get("join_strategy"), told.get("key"), told.get("imputation_method"), told.get("output"), told.get("output_format"))
        except (ValueError, KeyError) as e:  # a strategy, method or format of no such name
            raise ValidationError(str(e)) from e
        return _told(f)

    def _fused(self, r: Request) -> FusionResult:
        return _known(self.engine.fused, r.values["id"], "fused dataset")

    def list_fused(self, r: Request) -> dict:
        held = self.engine.fused.items()
        return {"count": len(held), "fused_datasets": [{"fused_id": i, "source_datasets": f.source_datasets, "field_count": len(f.frame.columns)} for i, f in held]}

    def fused(self, r: Request) -> dict:
        return _told(self._fused(r))

    def fused_sample(self, r: Request) -> dict:
        data = [x.asDict(recursive=True) for x in self._fused(r).frame.limit(r.rows(1000)).collect()]
        return {"fused_id": r.values["id"], "rows": len(data), "data": data}

    def download(self, r: Request) -> dict:
        f, kind = self._fused(r), "parquet" if r.query.get("format", "parquet") == "parquet" else "csv"
        path = f"{shared_folder(self.engine.spark)}/downloads/{f.fused_dataset_id}.{kind}"
        return {"fused_id": f.fused_dataset_id, "format": kind, "path": self.engine.download(f.fused_dataset_id, path, kind)}

    # the service itself

    def health(self, r: Request) -> dict:
        stopped = self.engine.spark.sparkContext._jsc.sc().isStopped()
        return {"status": "degraded" if stopped else "healthy", "checks": {"api": "ok", "spark": "stopped" if stopped else "ok"}}

    def root(self, r: Request) -> dict:
        return {"name": "braidwork", "routes": sorted(f"{m} {p.pattern}" for m, p, _, _ in self.routes)}


def _told(f: FusionResult) -> dict:
    return {"fused_dataset_id": f.fused_dataset_id, "source_datasets": f.source_datasets, "record_count": f.record_count, "field_count": len(f.frame.columns), "join_strategy": f.join_strategy, "transformations": f.transformations, "imputation": vars(f.imputation), "storage_path": f.storage_path}


def _plain(value: object) -> object:
    return vars(value) if hasattr(value, "__dict__") else str(value)


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is bound but not started: call serve_forever()."""
    api = Api(engine)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            status, value = api(self.command, self.path, self.rfile, int(self.headers.get("Content-Length") or 0), self.headers.get("Content-Type", ""))
            body = b"" if value is None else json.dumps(value, default=_plain).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        do_GET = do_POST = do_DELETE = _answer

        def log_message(self, form: str, *values) -> None:
            _log.info(form, *values)

    return ThreadingHTTPServer((host, port), Handler)


if __name__ == "__main__":
    p = argparse.ArgumentParser(prog="braidwork.server")
    p.add_argument("--config")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8000)
    a = p.parse_args()
    serve(Engine(session(), load(a.config) if a.config else EngineConfig()), a.host, a.port).serve_forever()
