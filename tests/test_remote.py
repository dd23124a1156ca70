"""SQL queries in ranges, against a Derby database in memory, and paged REST services."""

import json
import random

import pytest
from pyspark.sql import functions as F

from braidwork.sources import readers, remote
from braidwork.types import IngestionError, IngestorConfig

URL, DRIVER = "jdbc:derby:memory:braidwork;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.mark.parametrize("seed", range(20))
def test_ranges(seed):
    rng = random.Random(seed)
    span = rng.choice([3, 1000, 10**12])
    values = sorted(rng.choice([rng.randrange(-span, span), 7]) for _ in range(rng.randrange(1, 3000)))
    most, asked = rng.choice([1, 10, 500]), []
    count = lambda parts: asked.append(len(parts)) or [sum(a <= v < b for v in values) for a, b in parts]
    found = remote.ranges(count, values[0], values[-1] + 1, len(values), most)
    assert found[0][0] == values[0] and found[-1][1] == values[-1] + 1 and all(x[1] == y[0] for x, y in zip(found, found[1:]))
    held = [sum(a <= v < b for v in values) for a, b in found]
    assert all(n <= most or len({v for v in values if a <= v < b}) == 1 for n, (a, b) in zip(held, found))
    assert all(m + n > most for m, n in zip(held, held[1:])) and max(asked, default=0) <= remote.CUTS


def test_sql_in_ranges(spark):
    # 3,000 rows far from each other, 1,000 close together, 500 of one number and 100 without one
    keys = F.when(F.col("id") < 3000, F.col("id") * 1_000_000_007).when(F.col("id") < 4000, F.col("id")).when(F.col("id") < 4500, F.lit(42))
    rows = spark.range(4600).select(F.col("id").alias("n"), keys.cast("bigint").alias("k"), F.concat(F.lit("t"), "id").alias("t"))
    rows.coalesce(1).write.jdbc(URL, "things", mode="overwrite", properties=DRIVER)
    config = IngestorConfig(experimental_sources=True)
    query = 'SELECT "n" AS n, "k" AS k, "t" AS t FROM things WHERE "n" <> 5'
    whole = readers.read(spark, URL, "sql", config, query=query, **DRIVER)
    parts = readers.read(spark, URL, "sql", config, query=query + ";", partition_column="k", rows_per_partition=200, **DRIVER)
    key = lambda r: r.N
    assert sorted(parts.collect(), key=key) == sorted(whole.collect(), key=key) and whole.count() == 4599
    sizes = [len(p) for p in parts.rdd.glom().collect()]
    assert whole.rdd.getNumPartitions() == 1 and sizes.count(500) + sizes.count(501) <= 1 and sorted(sizes)[-2] <= 200 and len(sizes) < 60
    empty = readers.read(spark, URL, "sql", config, query=query + ' AND "n" < 0', partition_column="k", **DRIVER)
    nulls = readers.read(spark, URL, "sql", config, query=query + ' AND "k" IS NULL', partition_column="k", **DRIVER)
    assert empty.count() == 0 and nulls.count() == 100
    for wrong in ({"partition_column": "k; DROP TABLE things"}, {"partition_column": "k", "rows_per_partition": 0}, {"partition_column": "t"}):
        with pytest.raises(IngestionError):
            readers.read(spark, URL, "sql", config, query=query, **wrong, **DRIVER)


def test_rest_pages(spark, tmp_path):
    tries = str(tmp_path)

    def get(url, headers, timeout):
        import os

        page = int(url.rpartition("=")[2])
        made = f"{tries}/{page}-{len([x for x in os.listdir(tries) if x.startswith(f'{page}-')])}"
        open(made, "w").close()
        if page % 4 == 0 and made.endswith("-0"):
            raise OSError("busy")
        assert headers == {"X": "y"} and timeout == 9
        return json.dumps({"page": page, "items": [{"id": 10 * page + i, "at": {"x": [i]}} | ({"more": "m"} if page == 6 else {}) for i in range(3)]} if page != 5 else []).encode()

    url = "https://example.org/list?page={page}"
    got = remote.read_rest(spark, url, 9, {"X": "y"}, pages=(1, 8), wait=0.01, get=get)
    want = {10 * p + i for p in range(1, 9) if p != 5 for i in range(3)}
    assert {r.id for r in got.collect()} == want and got.count() == len(want) and got.where("more = 'm'").count() == 3
    assert [r.x for r in got.where("id = 12").select("at.x").collect()] == [[2]]
    import os

    assert len(os.listdir(tries)) == 10  # eight pages, two of them twice, and none again for later jobs
    one = remote.read_rest(spark, "https://example.org/list?page=3", 9, {"X": "y"}, get=get)
    assert sorted(r.id for r in one.collect()) == [30, 31, 32]
    for wrong in ({"pages": (2, 1)}, {"pages": (5, 5), "headers": {"X": "y"}, "timeout": 9}):
        with pytest.raises(IngestionError):
            remote.read_rest(spark, url, get=get, **wrong)
    with pytest.raises(IngestionError):
        remote.read_rest(spark, "https://example.org/list", pages=(1, 2), get=get)
