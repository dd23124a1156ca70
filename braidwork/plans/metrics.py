"""What each stage did: a record per stage, Spark job groups under the stage's id, and counts from passes that run anyway.

Counts are observed at the root of a frame that is written. There Spark counts each task of the last stage once, also
where an executor was lost and the task ran again; an observation below a shuffle would count it twice, and one in a
branch that the optimizer drops would never answer.
"""

from __future__ import annotations

import json
import logging
import sys
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_log = logging.getLogger("braidwork")
_PLAIN = set(vars(logging.makeLogRecord({}))) | {"message", "asctime"}
_GROUP = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")
#: The id shared by all stages, events and log lines of one request, per thread or task.
correlation: ContextVar[str | None] = ContextVar("correlation", default=None)


class JsonLines(logging.Formatter):
    """A log record as one line of JSON, with the correlation id and whatever the record carries beside its message."""

    def format(self, record: logging.LogRecord) -> str:
        said = {"timestamp": datetime.fromtimestamp(record.created, timezone.utc).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        said |= {k: v for k, v in vars(record).items() if k not in _PLAIN and not k.startswith("_")}
        if correlation.get():
            said.setdefault("correlation_id", correlation.get())
        if record.exc_info:
            said["exception"] = self.formatException(record.exc_info)
        return json.dumps(said, default=str)


def log_to(stream=None, level: str = "INFO", as_json: bool = True) -> logging.Handler:
    """Send the library's log to a stream (stderr), as JSON lines or as text; the handler, to be removed when done."""
    handler = logging.StreamHandler(stream or sys.stderr)
    handler.setFormatter(JsonLines() if as_json else logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
    _log.setLevel(level.upper())
    _log.addHandler(handler)
    return handler


@contextmanager
def stage(spark: SparkSession, name: str, done: Callable[[dict], None], **facts) -> Iterator[dict]:
    """Run a stage's jobs under a job group of their own; done() gets its record, also if it fails.

    The block adds its counts to the record it is given. A stage inside another has the outer one's correlation id and
    names it as its parent; the outer job group comes back when it ends.
    """
    sc = spark.sparkContext
    outer = sc.getLocalProperty(_GROUP[0])
    before = {k: sc.getLocalProperty(k) for k in _GROUP}
    own = uuid.uuid4().hex
    token = correlation.set(correlation.get() or own)
    record = {"stage": name, "stage_id": own, "correlation_id": correlation.get(), "parent": outer if correlation.get() != own else None, "started": datetime.now(timezone.utc).isoformat()} | facts
    sc.setJobGroup(own, name)
    start = time.monotonic()
    try:
        yield record
        record["status"] = "ok"
    except BaseException as e:
        record |= {"status": "failed", "error": f"{type(e).__name__}: {e}"[:500]}
        raise
    finally:
        record["seconds"] = round(time.monotonic() - start, 3)
        for k, v in before.items():
            sc.setLocalProperty(k, v)
        _log.log(logging.INFO if record["status"] == "ok" else logging.ERROR, "stage %s: %s", name, record["status"], extra={"metrics": record, "correlation_id": record["correlation_id"]})
        try:
            done(record)
        finally:
            correlation.reset(token)


def observed(df: DataFrame) -> tuple[DataFrame, Callable[[], tuple[int, dict[str, int]]]]:
    """df, to be written as it is, and what tells its rows and its columns' nulls once it has been."""
    seen = Observation()
    shown = [c for c in df.columns if not c.startswith("__")]
    out = df.observe(seen, F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(shown)])

    def told() -> tuple[int, dict[str, int]]:
        got = seen.get
        return got["n"], {c: got["n"] - got[f"c{i}"] for i, c in enumerate(shown)}

    return out, told
