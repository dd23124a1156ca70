"""SQL queries and paged REST services, read by many tasks."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.validate import check_url
from ..session import checkpoint
from ..types import IngestionError

#: A range with more rows than wanted is cut into so many at a time.
CUTS = 64


def _asked(spark: SparkSession, url: str, sql: str, options: dict) -> list:
    """The one row of an aggregate, without nulls."""
    got = spark.read.format("jdbc").options(url=url, query=sql, **options).load().first()
    return [int(x or 0) for x in got]


def ranges(count: Callable[[list[tuple[int, int]]], list[int]], low: int, high: int, total: int, most: int) -> list[tuple[int, int]]:
    """Ranges [a, b) from low to high with at most `most` rows each, or one whole number wide; those without rows go to a
    neighbour. count() tells the rows of up to CUTS ranges. Only ranges that hold too many are cut, so it is asked about
    in proportion to the rows, however unevenly they lie."""
    found, open_ = [], [(low, high, total)]
    while open_:
        a, b, n = open_.pop()
        if n <= most or b - a <= 1:
            found.append((a, b, n))
            continue
        width = -(-(b - a) // CUTS)
        parts = [(x, min(x + width, b)) for x in range(a, b, width)]
        open_ += [(x, y, k) for (x, y), k in zip(parts, count(parts))]
    found.sort()
    out: list[list[int]] = []
    for a, b, n in found:
        if out and out[-1][2] + n <= most:
            out[-1][1:] = [b, out[-1][2] + n]
        else:
            out.append([a, b, n])
    return [(a, b) for a, b, _ in out]


def read_sql(spark: SparkSession, url: str, query: str, timeout: int = 300, partition_column: str | None = None, rows_per_partition: int = 1_000_000, **options: str) -> DataFrame:
    """A query's rows; with a numeric partition column by many tasks, of about so many rows each.

    The database counts the rows of ranges of that column, of dense ones again in finer ranges, down to whole numbers. The
    first range is open below and the last above, so rows that come in meanwhile are not lost; nulls are a range of their
    own. Only counts come to the driver. Each task's rows are as the database has them when that task, or its repeat, runs.
    """
    if not query:
        raise IngestionError("SQL sources need a query")
    options = {"queryTimeout": str(timeout), "fetchsize": "10000"} | options
    if not partition_column:
        return spark.read.format("jdbc").options(url=url, query=query, **options).load()
    if not re.fullmatch(r"\w+", partition_column):
        raise IngestionError(f"Not a column name: {partition_column}")
    if rows_per_partition < 1:
        raise IngestionError("rows_per_partition must be positive")
    table, c = f"({query.rstrip().rstrip(';')}) asked", f"asked.{partition_column}"
    low, high, total, known = _asked(spark, url, f"SELECT FLOOR(MIN({c})) AS a, FLOOR(MAX({c})) AS b, COUNT(*) AS n, COUNT({c}) AS k FROM {table}", options)

    def count(parts: list[tuple[int, int]]) -> list[int]:
        each = ", ".join(f"SUM(CASE WHEN {c} >= {a} AND {c} < {b} THEN 1 ELSE 0 END) AS n{i}" for i, (a, b) in enumerate(parts))
        return _asked(spark, url, f"SELECT {each} FROM {table} WHERE {c} >= {parts[0][0]} AND {c} < {parts[-1][1]}", options)

    cut = ranges(count, low, high + 1, known, rows_per_partition)
    inner = [b for _, b in cut[:-1]]
    tests = [" AND ".join([*([f"{c} >= {a}"] if a is not None else []), *([f"{c} < {b}"] if b is not None else [])]) or f"{c} IS NOT NULL" for a, b in zip([None, *inner], [*inner, None])]
    if total > known:
        tests.append(f"{c} IS NULL")
    return spark.read.jdbc(url, table, predicates=tests, properties=options)


def rest_rows(payload: object) -> list[dict]:
    """A list is the rows; of a dict the first non-empty list value is, else the dict is one row."""
    if isinstance(payload, list):
        return payload
    if isinstance(payload, dict):
        return next((v for v in payload.values() if isinstance(v, list) and v), [payload])
    raise IngestionError(f"Unexpected REST payload: {type(payload).__name__}")


def _get(url: str, headers: dict[str, str], timeout: int) -> bytes:
    import urllib.request

    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
        return r.read()


def _rows_of(page: bytes) -> list[str]:
    return [json.dumps(x) for x in rest_rows(json.loads(page))]


def read_rest(
    spark: SparkSession, url: str, timeout: int = 60, headers: dict[str, str] | None = None,
    pages: tuple[int, int] | None = None, retries: int = 3, wait: float = 0.5, tasks: int | None = None, get: Callable[[str, dict[str, str], int], bytes] = _get,
) -> DataFrame:
    """The rows of a service's answer; with pages (first, last) those of every page, the URL having {page} for its number.

    Pages are dealt to tasks, asked for again after a failure, each time after twice the wait, and written once, so that
    the columns found in them and the rows are of the same answers; a lost task asks for its own pages again. `tasks`
    bounds how many are asked for at a time. A page that answers an empty list gives no rows.
    """
    headers = headers or {}
    if pages is None:
        text = spark.createDataFrame([(x,) for x in _rows_of(get(check_url(url), headers, timeout))], "value string")
    else:
        first, last = pages
        if "{page}" not in url or last < first:
            raise IngestionError("Pages need {page} in the URL and a first and last number")
        check_url(url.replace("{page}", str(first)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for n in b.column(0).to_pylist():
                    for attempt in range(retries + 1):
                        try:
                            rows = _rows_of(get(url.replace("{page}", str(n)), headers, timeout))
                            break
                        except (OSError, ValueError):
                            if attempt == retries:
                                raise
                            time.sleep(wait * 2**attempt)
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])

        numbers = spark.range(first, last + 1, numPartitions=min(last - first + 1, tasks or spark.sparkContext.defaultParallelism))
        text = checkpoint(numbers.mapInArrow(run, "value string"))
    found = text.select(F.schema_of_variant_agg(F.parse_json("value")).alias("s")).first()["s"]
    if not found or not found.startswith("OBJECT<"):
        raise IngestionError("The service's rows are not objects" if found and found != "VOID" else "The service gave no rows")
    return text.select(F.from_json("value", found.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")).alias("r")).select("r.*")
