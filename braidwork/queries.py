"""Driver queries over the stages' operators, and the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import similarity as sim
from .functions import transforms, validate, vectors
from .operators import align, cluster, embed, impute, joins, profile, semantics, stats
from .operators.rows import ROW_ID
from .plans.engine import Engine
from .plans.providers import DeterministicProvider
from .session import shared_folder
from .sources import readers
from .types import AlignmentConfig

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, n: int = 6):
    return F.round(c, n)


# profile

_GAPPY = "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer"


def _gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with every seventh balance missing."""
    return _t(spark, sf_dir, "customer").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")))


@query("SELECT 'customer' AS dataset_id, COUNT(*) AS row_count, 5 AS column_count FROM customer UNION ALL SELECT 'orders', COUNT(*), 6 FROM orders UNION ALL SELECT 'part', COUNT(*), 6 FROM part")
def ingest_row_counts(spark, sf_dir):
    out = None
    for name in ("customer", "orders", "part"):
        df = _t(spark, sf_dir, name)
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("dataset_id"), "row_count", F.lit(len(df.columns)).alias("column_count"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS field_name, COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS null_count, COUNT(DISTINCT {c}) AS distinct_count, "
        f"ROUND((COUNT(*) - COUNT({c})) / COUNT(*)::DOUBLE, 6) AS null_ratio, ROUND(COUNT(DISTINCT {c}) / COUNT(*)::DOUBLE, 6) AS unique_ratio FROM ({_GAPPY})"
        for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    )
)
def profile_null_unique(spark, sf_dir):
    p = profile.counts(_gappy(spark, sf_dir))
    return p.withColumns({"null_ratio": _r("null_ratio"), "unique_ratio": _r("unique_ratio")})


_TYPE = "CASE WHEN t IN ('TINYINT','SMALLINT','INTEGER','BIGINT') THEN 'integer' WHEN t IN ('FLOAT','DOUBLE') THEN 'float' WHEN t = 'BOOLEAN' THEN 'boolean' WHEN t LIKE 'TIMESTAMP%' OR t = 'DATE' THEN 'datetime' ELSE 'string' END"
_TYPED = {"orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), "events": ("event_id", "ts", "user_id", "event_type", "value", "props")}


@query(f"SELECT dataset_id, field_name, {_TYPE} AS data_type FROM (" + " UNION ALL ".join(f"SELECT '{d}' AS dataset_id, '{c}' AS field_name, (SELECT MAX(typeof({c})) FROM {d}) AS t" for d, cs in _TYPED.items() for c in cs) + ")")
def profile_dtype(spark, sf_dir):
    rows = []
    for name in _TYPED:
        df = _t(spark, sf_dir, name)
        rows += [(name, c, k.value) for c, k in profile.infer_types(df, df.columns[0]).items()] + [(name, df.columns[0], profile.data_type_of(df.schema[0].dataType).value)]
    return spark.createDataFrame(rows, "dataset_id string, field_name string, data_type string")


@query("SELECT sha256(concat_ws(chr(31), n_name, n_nationkey, n_regionkey)) AS row_sha256 FROM nation UNION ALL SELECT sha256(concat_ws(chr(31), r_name, r_regionkey)) FROM region")
def content_hash(spark, sf_dir):
    return profile.row_hash(_t(spark, sf_dir, "nation")).unionByName(profile.row_hash(_t(spark, sf_dir, "region")))


@query("""WITH r AS (SELECT sha256(concat_ws(chr(31), COALESCE(o_custkey::VARCHAR, chr(0)), COALESCE(o_orderdate::VARCHAR, chr(0)), COALESCE(o_orderkey::VARCHAR, chr(0)),
  COALESCE(o_orderpriority::VARCHAR, chr(0)), COALESCE(o_orderstatus::VARCHAR, chr(0)), COALESCE(o_totalprice::VARCHAR, chr(0)))) AS s, COUNT(*) AS n FROM orders GROUP BY 1),
g AS (SELECT substr(s, 1, 4) AS a, sha256(string_agg(s || ':' || n, '' ORDER BY s)) AS h FROM r GROUP BY 1)
SELECT sha256(string_agg(a || h, '' ORDER BY a)) AS digest FROM g""")
def content_digest(spark, sf_dir):
    return profile.content_hash(_t(spark, sf_dir, "orders"))


def _through_a_file(spark, df, suffix):
    """df written as a text source, then read like any other one."""
    path = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}.{suffix}"
    (df.write.option("header", True).csv(path) if suffix == "csv" else df.write.json(path))
    return readers.read(spark, path)


@query("SELECT s_suppkey::BIGINT AS s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier")
def ingest_csv(spark, sf_dir):
    return _through_a_file(spark, _t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), "csv")


@query("SELECT c_custkey::BIGINT AS c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal FROM customer")
def ingest_jsonl(spark, sf_dir):
    return _through_a_file(spark, _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), "jsonl")


@query("SELECT * FROM part")
def ingest_parquet(spark, sf_dir):
    return readers.read(spark, f"{sf_dir}/part.parquet")


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def sample_head(spark, sf_dir):
    return _t(spark, sf_dir, "orders").orderBy("o_orderkey").limit(10)


# statistics

_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "SELECT field_name, COUNT(v) AS count, ROUND(AVG(v), 4) AS mean, ROUND(COALESCE(STDDEV_SAMP(v), 0), 4) AS std, MIN(v) AS min, ROUND(QUANTILE_CONT(v, 0.25), 4) AS q1, ROUND(MEDIAN(v), 4) AS median, "
    "ROUND(QUANTILE_CONT(v, 0.75), 4) AS q3, MAX(v) AS max, COUNT(*) - COUNT(v) AS null_count, COUNT(DISTINCT v) AS unique_count FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS field_name, {c} AS v FROM lineitem" for c in _MEASURES) + ") GROUP BY field_name"
)
def stats_descriptive(spark, sf_dir):
    d = stats.describe(_t(spark, sf_dir, "lineitem"), list(_MEASURES))
    return d.withColumns({c: _r(c, 4) for c in ("mean", "std", "q1", "median", "q3")})


_PAIRS = [(a, b) for i, a in enumerate(_MEASURES) for b in _MEASURES[i + 1 :]]


def _pair_sql(threshold: float) -> str:
    each = " UNION ALL ".join(f"SELECT '{a}' AS field_a, '{b}' AS field_b, COUNT(*) AS n, CORR({a}, {b}) AS r FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _PAIRS)
    return f"SELECT field_a, field_b, n, ROUND(r, 5) AS coefficient FROM ({each}) WHERE ABS(r) >= {threshold}"


@query(_pair_sql(0.0))
def corr_pearson(spark, sf_dir):
    return stats.correlations(_t(spark, sf_dir, "lineitem"), "pearson", 0.0, list(_MEASURES)).select("field_a", "field_b", "n", _r("coefficient", 5).alias("coefficient"))


@query(_pair_sql(0.0005))
def corr_pairs_filtered(spark, sf_dir):
    return stats.correlations(_t(spark, sf_dir, "lineitem"), "pearson", 0.0005, list(_MEASURES)).select("field_a", "field_b", "n", _r("coefficient", 5).alias("coefficient"))


@query(
    "WITH g AS (" + _GAPPY + "), x AS (SELECT RANK() OVER (ORDER BY c_nationkey) + (COUNT(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0 AS a, "
    "RANK() OVER (ORDER BY c_acctbal) + (COUNT(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS b FROM g WHERE c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL) "
    "SELECT 'c_nationkey' AS field_a, 'c_acctbal' AS field_b, COUNT(*) AS n, ROUND(CORR(a, b), 5) AS coefficient FROM x"
)
def corr_spearman(spark, sf_dir):
    return stats.correlations(_gappy(spark, sf_dir), "spearman", 0.0, ["c_nationkey", "c_acctbal"], "c_custkey").select("field_a", "field_b", "n", _r("coefficient", 5).alias("coefficient"))


@query()
def corr_pvalue(spark, sf_dir):
    return stats.correlations(_t(spark, sf_dir, "customer"), "pearson", 0.0, ["c_custkey", "c_nationkey", "c_acctbal"])


_BOUNDS = "SELECT QUANTILE_CONT(value, 0.25) - 1.5 * (QUANTILE_CONT(value, 0.75) - QUANTILE_CONT(value, 0.25)) AS lo, QUANTILE_CONT(value, 0.75) + 1.5 * (QUANTILE_CONT(value, 0.75) - QUANTILE_CONT(value, 0.25)) AS hi FROM events"


@query(f"SELECT 'value' AS field_name, event_id AS row, value, ROUND(lo, 4) AS lower_bound, ROUND(hi, 4) AS upper_bound FROM events, ({_BOUNDS}) WHERE value < lo OR value > hi")
def outliers_iqr(spark, sf_dir):
    o = stats.outliers(_t(spark, sf_dir, "events"), 1.5, ["value"], "event_id")
    return o.select("field_name", "row", "value", _r("lower_bound", 4).alias("lower_bound"), _r("upper_bound", 4).alias("upper_bound"))


@query(f"SELECT 'value' AS field_name, ROUND(lo, 4) AS lower_bound, ROUND(hi, 4) AS upper_bound FROM ({_BOUNDS})")
def outlier_bounds(spark, sf_dir):
    return stats.outlier_bounds(_t(spark, sf_dir, "events"), 1.5, ["value"]).select("field_name", _r("lower_bound", 4).alias("lower_bound"), _r("upper_bound", 4).alias("upper_bound"))


# transforms


@query("SELECT p_partkey, ROUND(p_size * 9.0 / 5 + 32, 6) AS fahrenheit, ROUND((p_size - 32.0) * 5 / 9, 6) AS celsius FROM part")
def unit_temp(spark, sf_dir):
    c = F.col("p_size")
    return _t(spark, sf_dir, "part").select("p_partkey", _r(transforms.unit("celsius_to_fahrenheit", c)).alias("fahrenheit"), _r(transforms.unit("fahrenheit_to_celsius", c)).alias("celsius"))


def _measured(name_a: str, name_b: str, spark, sf_dir, a: str, b: str):
    c = F.col("l_quantity")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", _r(transforms.unit(name_a, c), 4).alias(a), _r(transforms.unit(name_b, c), 4).alias(b))


_UNIT = "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, ROUND(l_quantity * {f}::DOUBLE, 4) AS {a}, ROUND(l_quantity / {f}::DOUBLE, 4) AS {b} FROM lineitem"


@query(_UNIT.format(f="2.20462", a="lb", b="kg"))
def unit_weight(spark, sf_dir):
    return _measured("kg_to_lb", "lb_to_kg", spark, sf_dir, "lb", "kg")


@query(_UNIT.format(f="3.28084", a="ft", b="m"))
def unit_length(spark, sf_dir):
    return _measured("m_to_ft", "ft_to_m", spark, sf_dir, "ft", "m")


@query(_UNIT.format(f="30.44", a="days", b="months"))
def unit_duration(spark, sf_dir):
    return _measured("months_to_days", "days_to_months", spark, sf_dir, "days", "months")


@query("SELECT p_partkey, ROUND((p_size - 32.0) * 5 / 9, 6) AS converted FROM part")
def unit_inverse(spark, sf_dir):
    return transforms.apply_hint(_t(spark, sf_dir, "part"), "p_size", "unit_conversion:celsius_to_fahrenheit_inverse").select("p_partkey", _r("p_size").alias("converted"))


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'bad' ELSE CAST(user_id AS VARCHAR) END AS DOUBLE) AS number FROM events")
def cast_float(spark, sf_dir):
    text = F.when(F.col("event_id") % 5 == 0, "bad").otherwise(F.col("user_id").cast("string"))
    return transforms.cast(_t(spark, sf_dir, "events").select("event_id", text.alias("number")), "number", "float")


@query("SELECT doc_id, TRY_CAST(REPLACE(source, 'src', '') AS BIGINT) AS number FROM documents")
def cast_integer(spark, sf_dir):
    return transforms.cast(_t(spark, sf_dir, "documents").select("doc_id", F.replace("source", F.lit("src"), F.lit("")).alias("number")), "number", "integer")


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS customer FROM orders")
def cast_string(spark, sf_dir):
    return transforms.cast(_t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("customer")), "customer", "string")


@query("SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 9 = 0 THEN 'no date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS TIMESTAMP) AS day FROM orders")
def cast_datetime(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 9 == 0, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    df = transforms.cast(_t(spark, sf_dir, "orders").select("o_orderkey", text.alias("day")), "day", "datetime")
    return df.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("SELECT 'p_size' AS field, 'unit_conversion' AS operation, 'celsius_to_fahrenheit' AS template, COUNT(p_size) AS records_affected, MIN_BY(CAST(p_size AS VARCHAR), p_partkey) AS sample_before FROM part")
def transform_log(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    hint = "unit_conversion:celsius_to_fahrenheit"
    return transforms.applied(part, [("p_size", hint)], "p_partkey")[1].select("field", "operation", "template", "records_affected", "sample_before")


# joins


@query("SELECT COALESCE(c.c_custkey, o.c_custkey) AS c_custkey, c.c_name, COALESCE(c.c_acctbal, o.c_acctbal) AS c_acctbal, o.n_orders FROM (SELECT c_custkey, c_name, c_acctbal FROM (" + _GAPPY + ")) c FULL JOIN (SELECT o_custkey AS c_custkey, ROUND(SUM(o_totalprice), 2) AS c_acctbal, COUNT(*) AS n_orders FROM orders GROUP BY o_custkey) o ON c.c_custkey IS NOT DISTINCT FROM o.c_custkey")
def fuse_exact_key(spark, sf_dir):
    right = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("balance"), F.count("*").alias("n_orders"))
    return joins.exact_merge(_gappy(spark, sf_dir).select("c_custkey", "c_name", "c_acctbal"), right, "c_custkey", {"o_custkey": "c_custkey", "balance": "c_acctbal"})


@query("WITH l AS (SELECT CASE WHEN n_nationkey % 6 <> 0 THEN n_nationkey END AS k, n_name FROM nation), r AS (SELECT CASE WHEN s_suppkey % 10 <> 0 THEN s_nationkey END AS k, s_suppkey, s_name FROM supplier) SELECT COALESCE(l.k, r.k) AS k, n_name, s_suppkey, s_name FROM l FULL JOIN r ON l.k IS NOT DISTINCT FROM r.k")
def fuse_exact_null_keys(spark, sf_dir):
    left = _t(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 6 != 0, F.col("n_nationkey")).alias("k"), "n_name")
    right = _t(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 10 != 0, F.col("s_nationkey")).alias("nk"), "s_suppkey", "s_name")
    return joins.exact_merge(left, right, "k", {"nk": "k"})


@query("SELECT COALESCE(c.c_nationkey, s.s_nationkey) AS c_nationkey, c_custkey, s_suppkey FROM customer c FULL JOIN supplier s ON c.c_nationkey = s.s_nationkey")
def fuse_many_to_many(spark, sf_dir):
    return joins.exact_merge(_t(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), _t(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey"), "c_nationkey", {"s_nationkey": "c_nationkey"})


@query("SELECT COALESCE(c.k, r.r_regionkey) AS n_regionkey, c.nk AS n_nationkey, c.n_name, c.c_custkey, r.r_name FROM (SELECT COALESCE(n_nationkey, c_nationkey) AS nk, n_name, n_regionkey AS k, c_custkey FROM nation FULL JOIN customer ON n_nationkey = c_nationkey) c FULL JOIN region r ON c.k IS NOT DISTINCT FROM r.r_regionkey")
def fuse_three_way(spark, sf_dir):
    frames = {"nation": _t(spark, sf_dir, "nation"), "customer": _t(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), "region": _t(spark, sf_dir, "region")}
    edges = {("nation", "customer"): ("n_nationkey", "c_nationkey"), ("nation", "region"): ("n_regionkey", "r_regionkey")}
    out, _ = joins.fold(frames, edges, lambda left, right, own: [joins.exact_merge(left, right, a, {b: a}) for a, b in own.values()][0])
    return out.select("n_regionkey", "n_nationkey", "n_name", "c_custkey", "r_name")


@query("SELECT c_name AS name, c_nationkey AS nation, c_acctbal AS balance, NULL::VARCHAR AS brand FROM customer UNION ALL SELECT p_name, NULL, NULL, p_brand FROM part")
def fuse_concat(spark, sf_dir):
    left = _t(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return joins.concat(left, _t(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand")))


_SIM = "CASE WHEN a IS NULL AND b IS NULL THEN 1.0 WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE 1.0 - LEAST(ABS(a - b) / GREATEST(ABS(a), ABS(b), 1e-10), 1.0) END"
_SCORED = f"SELECT lid, rid, {_SIM} AS score FROM (SELECT c_custkey AS lid, s_suppkey AS rid, c_acctbal AS a, s_acctbal AS b FROM customer, supplier)"
_BEST = f"SELECT lid AS left_id, rid AS right_id, score FROM ({_SCORED}) WHERE score > 0.999 QUALIFY ROW_NUMBER() OVER (PARTITION BY lid ORDER BY score DESC, rid) = 1"


def _sides(spark, sf_dir):
    return _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier"), [("c_acctbal", "s_acctbal")], "c_custkey", "s_suppkey"


@query(f"SELECT left_id, right_id, ROUND(score, 6) AS score FROM ({_BEST})")
def fuse_semantic_numeric(spark, sf_dir):
    return joins.best_matches(*_sides(spark, sf_dir), 0.999).withColumn("score", _r("score"))


@query(f"WITH m AS ({_BEST}) SELECT c_custkey, c_acctbal, s_suppkey, s_name FROM customer LEFT JOIN m ON c_custkey = left_id LEFT JOIN supplier ON s_suppkey = right_id UNION ALL SELECT NULL, s_acctbal, s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT right_id FROM m)")
def fuse_semantic_outer(spark, sf_dir):
    return joins.semantic_join(*_sides(spark, sf_dir), 0.999).select("c_custkey", "c_acctbal", "s_suppkey", "s_name")


@query()
def fuse_semantic_string(spark, sf_dir):
    """Parts against parts whose brand is spelled in another way, by one string."""
    part, text = _t(spark, sf_dir, "part"), F.concat_ws(" ", "p_name", "p_brand")
    right = part.select(F.col("p_partkey").alias("other"), F.replace(text, F.lit("Brand#"), F.lit("br ")).alias("title"))
    return joins.best_matches(part.select("p_partkey", text.alias("name")), right, [("name", "title")], "p_partkey", "other", 0.8)


_IN_TURN = (
    "WITH RECURSIVE e AS (SELECT * FROM (SELECT lid, rid, CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE 1 - ABS(a - b) / GREATEST(ABS(a), ABS(b), 1e-9) END AS score FROM (SELECT c_custkey AS lid, s_suppkey AS rid, c_acctbal AS a, s_acctbal AS b FROM customer, supplier)) WHERE score > 0.99), "
    "o AS (SELECT ROW_NUMBER() OVER (ORDER BY lid) AS n, lid, LIST({'r': rid, 's': score} ORDER BY score DESC, rid) AS wish FROM e GROUP BY lid), "
    "g AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS lid, NULL::STRUCT(r BIGINT, s DOUBLE) AS got, []::BIGINT[] AS used UNION ALL "
    "SELECT n, lid, got, CASE WHEN got IS NULL THEN used ELSE LIST_APPEND(used, got.r) END FROM (SELECT o.n, o.lid, g.used, LIST_FILTER(o.wish, lambda x: NOT LIST_CONTAINS(g.used, x.r))[1] AS got FROM g JOIN o ON o.n = g.n + 1)) "
    "SELECT lid AS left_id, got.r AS right_id, ROUND(got.s, 6) AS score FROM g WHERE got IS NOT NULL"
)


@query(_IN_TURN)
def fuse_probabilistic(spark, sf_dir):
    return joins.probabilistic_matches(*_sides(spark, sf_dir), 0.99).withColumn("score", _r("score"))


_EVENTS = "WITH l AS (SELECT * FROM events WHERE event_type = 'purchase'), r AS (SELECT * FROM events WHERE event_type = 'error') "


@query(
    _EVENTS + "SELECT l.event_id AS left_event, l.ts AS left_ts, m.rid AS right_event, m.rts AS right_ts FROM l LEFT JOIN (SELECT l.event_id AS lid, r.event_id AS rid, r.ts AS rts FROM l JOIN r ON r.ts BETWEEN l.ts - INTERVAL 1 HOUR AND l.ts + INTERVAL 1 HOUR "
    "QUALIFY ROW_NUMBER() OVER (PARTITION BY l.event_id ORDER BY ABS(EPOCH_US(l.ts) - EPOCH_US(r.ts)), r.ts > l.ts, r.event_id) = 1) m ON l.event_id = m.lid"
)
def fuse_temporal_nearest(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select(F.col("event_id").alias("left_event"), F.col("ts").alias("left_ts"))
    right = e.where("event_type = 'error'").select(F.col("event_id").alias("right_event"), F.col("ts").alias("right_ts"))
    return joins.temporal_join(left, right, "left_ts", "right_ts", "left_event", "right_event", 3600)


@query(f"SELECT lid AS left_id, rid AS right_id, ROUND(score, 6) AS score FROM ({_SCORED}) WHERE score > 0.7 QUALIFY ROW_NUMBER() OVER (PARTITION BY lid ORDER BY score DESC, rid) = 1")
def best_match(spark, sf_dir):
    return joins.best_matches(*_sides(spark, sf_dir), 0.7).withColumn("score", _r("score"))


@query(f"SELECT lid AS left_id, rid AS right_id, ROUND(score, 6) AS score, ROW_NUMBER() OVER (PARTITION BY lid ORDER BY score DESC, rid) AS rank FROM ({_SCORED}) WHERE score >= 0.7 QUALIFY rank <= 5")
def all_matches_topk(spark, sf_dir):
    return joins.all_matches(*_sides(spark, sf_dir), 0.7, 5).withColumn("score", _r("score"))


# imputation

_HOLES = "SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS a, CASE WHEN c_custkey % 11 <> 0 THEN c_nationkey END AS b, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal END AS sparse FROM customer"


def _holes(spark, sf_dir):
    k = F.col("c_custkey")
    return _t(spark, sf_dir, "customer").select("c_custkey", F.when(k % 7 != 0, F.col("c_acctbal")).alias("a"), F.when(k % 11 != 0, F.col("c_nationkey")).alias("b"), F.when(k % 5 == 0, F.col("c_acctbal")).alias("sparse"))


def _filled(spark, sf_dir, method):
    df, _ = impute.impute(_holes(spark, sf_dir), method, 0.5, 5, "c_custkey")
    return df.select("c_custkey", _r("a", 4).alias("a"), _r("b", 4).alias("b"), "sparse")


def _filled_sql(f: str) -> str:
    return f"WITH h AS ({_HOLES}) SELECT c_custkey, ROUND(COALESCE(a, (SELECT {f.format(c='a')} FROM h)), 4) AS a, ROUND(COALESCE(b::DOUBLE, (SELECT {f.format(c='b')} FROM h)), 4) AS b, sparse FROM h"


@query(_filled_sql("AVG({c})"))
def impute_mean(spark, sf_dir):
    return _filled(spark, sf_dir, "mean")


@query(_filled_sql("MEDIAN({c}::DOUBLE)"))
def impute_median(spark, sf_dir):
    return _filled(spark, sf_dir, "median")


@query(f"WITH h AS ({_HOLES}) SELECT c_custkey, ROUND(COALESCE(a, (SELECT a FROM h WHERE a IS NOT NULL GROUP BY a ORDER BY COUNT(*) DESC, a LIMIT 1)), 4) AS a, ROUND(COALESCE(b::DOUBLE, (SELECT b FROM h WHERE b IS NOT NULL GROUP BY b ORDER BY COUNT(*) DESC, b LIMIT 1)), 4) AS b, sparse FROM h")
def impute_mode(spark, sf_dir):
    return _filled(spark, sf_dir, "mode")


@query(f"WITH h AS ({_HOLES}) SELECT * FROM (SELECT 'a' AS field_name, COUNT(*) - COUNT(a) AS nulls, (COUNT(*) - COUNT(a)) / COUNT(*) AS r FROM h UNION ALL SELECT 'b', COUNT(*) - COUNT(b), (COUNT(*) - COUNT(b)) / COUNT(*) FROM h UNION ALL SELECT 'sparse', COUNT(*) - COUNT(sparse), (COUNT(*) - COUNT(sparse)) / COUNT(*) FROM h) WHERE r > 0 AND r <= 0.5".replace("SELECT * FROM (SELECT 'a'", "SELECT field_name, nulls FROM (SELECT 'a'"))
def impute_ratio_gate(spark, sf_dir):
    return spark.createDataFrame(list(impute.eligible(_holes(spark, sf_dir), 0.5).items()), "field_name string, nulls bigint")


_KNN = f"""WITH h AS ({_HOLES}), d AS (
SELECT q.c_custkey AS q, x.c_custkey AS d, q.a IS NULL AS qa, q.b IS NULL AS qb, x.a AS xa, x.b AS xb,
  (CASE WHEN q.a IS NOT NULL AND x.a IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN q.b IS NOT NULL AND x.b IS NOT NULL THEN 1 ELSE 0 END) AS p,
  COALESCE((q.a - x.a) * (q.a - x.a), 0.0) + COALESCE(CAST((q.b - x.b) * (q.b - x.b) AS DOUBLE), 0.0) AS s
FROM h q JOIN h x ON q.c_custkey <> x.c_custkey WHERE q.a IS NULL OR q.b IS NULL),
n AS (SELECT q, d, qa, qb, xa, xb, SQRT(s * 2 / p) AS dist FROM d WHERE p > 0),
fa AS (SELECT q, AVG(xa) AS v FROM (SELECT * FROM n WHERE qa AND xa IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY q ORDER BY dist, d) <= 5) GROUP BY q),
fb AS (SELECT q, AVG(xb) AS v FROM (SELECT * FROM n WHERE qb AND xb IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY q ORDER BY dist, d) <= 5) GROUP BY q)
SELECT c_custkey, ROUND(COALESCE(a, fa.v, (SELECT AVG(a) FROM h)), 4) AS a, ROUND(COALESCE(b::DOUBLE, fb.v, (SELECT AVG(b) FROM h)), 4) AS b, sparse
FROM h LEFT JOIN fa ON fa.q = c_custkey LEFT JOIN fb ON fb.q = c_custkey"""


@query(_KNN)
def impute_knn(spark, sf_dir):
    return _filled(spark, sf_dir, "knn")


# set and string similarity

_TOKENS = "SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type || ' ' || p_name || ' ' || p_brand), ' ')) AS b FROM part"


def _tokens(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("a"), F.split(F.lower(F.concat_ws(" ", "p_type", "p_name", "p_brand")), " ").alias("b"))


@query(f"SELECT p_partkey, ROUND(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS similarity FROM ({_TOKENS})")
def sim_jaccard(spark, sf_dir):
    return _tokens(spark, sf_dir).select("p_partkey", _r(sim.jaccard(F.col("a"), F.col("b"))).alias("similarity"))


@query(f"SELECT p_partkey, ROUND(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) AS similarity FROM ({_TOKENS})")
def sim_dice(spark, sf_dir):
    return _tokens(spark, sf_dir).select("p_partkey", _r(sim.dice(F.col("a"), F.col("b"))).alias("similarity"))


_GRAMS = "list_distinct(list_transform(range(1, GREATEST(length({c}) - 1, 1) + 1), lambda i: substring({c}, i, 2)))"


@query("SELECT c_custkey, n_nationkey, ROUND(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE, 6) AS similarity FROM (SELECT c_custkey, n_nationkey, " + _GRAMS.format(c="a") + " AS x, " + _GRAMS.format(c="b") + " AS y FROM (SELECT c_custkey, n_nationkey, lower(trim(c_mktsegment)) AS a, lower(trim(n_name)) AS b FROM customer JOIN nation ON c_nationkey = n_nationkey))")
def sim_ngram(spark, sf_dir):
    both = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.select("c_custkey", "n_nationkey", _r(sim.ngram_similarity(F.col("c_mktsegment"), F.col("n_name"))).alias("similarity"))


def _ratios(method: str):
    def run(spark, sf_dir):
        return _t(spark, sf_dir, "part").select("p_partkey", sim.similarity(F.col("p_name"), F.concat_ws(" ", "p_brand", "p_name", "p_type"), method).alias("similarity"))

    return run


for _name, _method in (("sim_ratio", "levenshtein"), ("sim_token_sort", "token_sort"), ("sim_token_set", "token_set"), ("sim_partial", "partial")):
    QUERIES[_name] = _ratios(_method)

# vectors

_FIRST = "(SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)"


def _with_first(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    return e, [float(x) for x in e.orderBy("vec_id").limit(1).first()["embedding"]]


def _constant(v):
    return F.array(*[F.lit(x) for x in v])


@query(f"SELECT vec_id, ROUND(list_cosine_similarity(embedding::DOUBLE[], {_FIRST}), 5) AS similarity FROM embeddings")
def vec_cosine(spark, sf_dir):
    e, q = _with_first(spark, sf_dir)
    return e.select("vec_id", _r(vectors.cosine(F.col("embedding"), _constant(q)), 5).alias("similarity"))


@query(f"SELECT vec_id, ROUND(list_distance(embedding::DOUBLE[], {_FIRST}), 5) AS distance FROM embeddings")
def vec_euclidean(spark, sf_dir):
    e, q = _with_first(spark, sf_dir)
    return e.select("vec_id", _r(vectors.euclidean(F.col("embedding"), _constant(q)), 5).alias("distance"))


@query("SELECT vec_id, pos, ROUND(x / n, 5) AS value FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos, SQRT(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)")
def vec_normalize(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.normalize(F.col("embedding"))).alias("pos", "value")).withColumn("value", _r("value", 5))


_UNNEST = "SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x, vec_id FROM embeddings"


@query(f"SELECT label, pos, ROUND(AVG(x), 5) AS value FROM ({_UNNEST}) GROUP BY label, pos")
def vec_average(spark, sf_dir):
    return vectors.average(_t(spark, sf_dir, "embeddings"), "embedding", ["label"]).select("label", F.posexplode("average").alias("pos", "value")).withColumn("value", _r("value", 5))


@query(f"WITH q AS (SELECT unnest({_FIRST}) AS y, generate_subscripts({_FIRST}, 1) - 1 AS pos) SELECT vec_id, u.pos, ROUND(0.25 * x + 0.75 * y, 5) AS value FROM ({_UNNEST}) u JOIN q ON u.pos = q.pos")
def vec_combine(spark, sf_dir):
    e, q = _with_first(spark, sf_dir)
    return e.select("vec_id", F.posexplode(vectors.combine([F.col("embedding"), _constant(q)], [0.25, 0.75])).alias("pos", "value")).withColumn("value", _r("value", 5))


@query(f"SELECT vec_id, ROUND(s, 5) AS similarity FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], {_FIRST}) AS s FROM embeddings) WHERE s >= 0.1 ORDER BY s DESC, vec_id LIMIT 5")
def vec_topk(spark, sf_dir):
    e, q = _with_first(spark, sf_dir)
    return vectors.find_similar(q, e, "embedding", "vec_id", 5, 0.1).withColumn("similarity", _r("similarity", 5))


@query()
def embed_column(spark, sf_dir):
    """Every part's name, the provider being asked once for each distinct one."""
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_name")
    return embed.embedded(part, "p_name", DeterministicProvider(64), f"{shared_folder(spark)}/embeddings-{uuid.uuid4().hex}")


@query()
def vec_embedding(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", vectors.embedding(F.col("p_name"), 64).alias("embedding"))


# the catalog of some tables' columns as the engine interprets them; the last three are made from given ones

#: name: the table it is made from, that table's key, and its columns with what they are, in SQL that both engines read
_DATASETS = {
    "customer": ("customer", "c_custkey", {c: c for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")}),
    "supplier": ("supplier", "s_suppkey", {c: c for c in ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")}),
    "part": ("part", "p_partkey", {c: c for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")}),
    "readings": ("supplier", "s_suppkey", {"reading_id": "s_suppkey", "temp_c": "s_acctbal", "weight_kg": "CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END", "age_days": "s_nationkey", "is_valid": "s_acctbal > 0", "city_name": "s_name"}),
    "measures": ("part", "p_partkey", {"reading_id": "p_partkey", "temp_f": "p_retailprice", "weight_lb": "CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END", "age_months": "p_size", "is_valid": "p_size > 20", "town_name": "p_name"}),
    "staff": ("orders", "o_orderkey", {"employee_id": "o_orderkey", "salary": "o_totalprice", "department": "o_orderpriority", "hire_date": "o_orderdate", "is_valid": "o_orderstatus = 'F'"}),
}
_CATALOG = " UNION ALL ".join(
    f"SELECT {d} AS ds_ord, '{name}' AS dataset_id, {o} AS ord, '{c}' AS field_name, (SELECT {_TYPE} FROM (SELECT MAX(typeof({e})) AS t FROM {table})) AS data_type, "
    f"(COUNT(*) - COUNT({e})) / COUNT(*)::DOUBLE AS null_ratio, COUNT(DISTINCT {e}) / COUNT(*)::DOUBLE AS unique_ratio FROM {table}"
    for d, (name, (table, _, columns)) in enumerate(_DATASETS.items()) for o, (c, e) in enumerate(columns.items())
)


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    for name, (table, key, columns) in _DATASETS.items():
        e.register(_t(spark, sf_dir, table).select(*[F.expr(x).alias(c) for c, x in columns.items()], F.col(key).alias(ROW_ID)), name)
    return e.fields(list(_DATASETS))


def _like(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_FALLBACK = (
    f"CASE WHEN {_like('n', semantics.FALLBACK_ID)} THEN 'identifier' WHEN {_like('n', semantics.FALLBACK_TIME)} THEN 'timestamp' "
    f"WHEN data_type IN ('integer', 'float') AND {_like('n', semantics.FALLBACK_METRIC)} THEN 'metric' WHEN unique_ratio < 0.1 THEN 'category' WHEN data_type = 'string' THEN 'text' ELSE 'unknown' END"
)
_PROVIDER = (
    f"CASE WHEN len(list_intersect(string_split(n, '_'), [{', '.join(repr(w) for w in semantics.ID)}])) > 0 THEN 'identifier' WHEN {_like('n', semantics.TIME)} THEN 'timestamp' "
    f"WHEN {_like('n', semantics.METRIC)} THEN 'metric' WHEN {_like('n', semantics.CATEGORY)} THEN 'category' WHEN {_like('n', semantics.TEXT)} THEN 'text' ELSE 'unknown' END"
)
_CONFIDENCE = {"fallback": "CASE k WHEN 'identifier' THEN 0.7 WHEN 'timestamp' THEN 0.7 WHEN 'metric' THEN 0.6 WHEN 'category' THEN 0.5 ELSE 0.3 END", "provider": "CASE k WHEN 'identifier' THEN 0.85 WHEN 'timestamp' THEN 0.80 WHEN 'metric' THEN 0.75 WHEN 'category' THEN 0.70 WHEN 'text' THEN 0.70 ELSE 0.40 END"}


@query(f"SELECT dataset_id, field_name, k AS semantic_type, {_CONFIDENCE['fallback']}::DOUBLE AS confidence FROM (SELECT *, {_FALLBACK} AS k FROM (SELECT *, lower(field_name) AS n FROM ({_CATALOG})))")
def sem_fallback(spark, sf_dir):
    said = semantics.fallback(F.col("field_name"), F.col("data_type"), F.col("unique_ratio"))
    return _catalog(spark, sf_dir).select("dataset_id", "field_name", said.alias("s")).select("dataset_id", "field_name", "s.semantic_type", "s.confidence")


_PROVIDED = f"SELECT *, {_PROVIDER} AS k FROM (SELECT *, lower(field_name) AS n FROM ({_CATALOG}))"


@query(f"SELECT dataset_id, field_name, k AS semantic_type, {_CONFIDENCE['provider']}::DOUBLE AS confidence FROM ({_PROVIDED})")
def sem_provider(spark, sf_dir):
    said = semantics.provider_rules(F.col("field_name"))
    return _catalog(spark, sf_dir).select("dataset_id", "field_name", said.alias("s")).select("dataset_id", "field_name", "s.semantic_type", "s.confidence")


@query(
    f"WITH t AS (SELECT dataset_id, string_agg(lower(field_name), ' ') AS x FROM ({_CATALOG}) GROUP BY dataset_id), h AS (SELECT dataset_id, list_filter(["
    + ", ".join(f"CASE WHEN {_like('x', w)} THEN '{d}' END" for d, w in semantics.DOMAINS.items())
    + "], lambda v: v IS NOT NULL) AS l FROM t) SELECT dataset_id, CASE WHEN len(l) = 0 THEN 'general' ELSE array_to_string(l[1:3], ',') END AS tags FROM h"
)
def domain_tags(spark, sf_dir):
    return semantics.dataset_tags(_catalog(spark, sf_dir)).select("dataset_id", F.array_join("tags", ",").alias("tags"))


_OK = "NOT ((a.data_type = 'datetime' AND b.data_type IN ('boolean','integer','float')) OR (b.data_type = 'datetime' AND a.data_type IN ('boolean','integer','float')) OR (a.data_type = 'boolean' AND b.data_type = 'float') OR (b.data_type = 'boolean' AND a.data_type = 'float'))"
_NAMED = "a.dataset_id AS source_dataset, a.field_name AS source_field, b.dataset_id AS target_dataset, b.field_name AS target_field"
_TS = "ROUND(((a.data_type = b.data_type)::INT + (a.k = b.k)::INT) / 2.0, 6)::DOUBLE AS type_score, ROUND(1.0 - (ABS(a.null_ratio - b.null_ratio) + ABS(a.unique_ratio - b.unique_ratio)) / 2.0, 6)::DOUBLE AS stats_score"
_CROSS = f"FROM ({_PROVIDED}) a JOIN ({_PROVIDED}) b ON a.ds_ord < b.ds_ord"


def _names():
    return [F.col("a_dataset_id").alias("source_dataset"), F.col("a_field_name").alias("source_field"), F.col("b_dataset_id").alias("target_dataset"), F.col("b_field_name").alias("target_field")]


def _type_stats(p):
    t = align.type_match(F.col("a_data_type"), F.col("b_data_type"), F.col("a_semantic_type"), F.col("b_semantic_type"))
    return t, align.stats_match(F.col("a_null_ratio"), F.col("b_null_ratio"), F.col("a_unique_ratio"), F.col("b_unique_ratio"))


@query(f"SELECT {_NAMED}, {_TS} {_CROSS}")
def align_type_stats(spark, sf_dir):
    p = align.pairs(_catalog(spark, sf_dir), gate=False)
    t, s = _type_stats(p)
    return p.select(*_names(), _r(t).alias("type_score"), _r(s).alias("stats_score"))


@query(f"SELECT {_NAMED} {_CROSS} AND {_OK}")
def align_gate(spark, sf_dir):
    return align.pairs(_catalog(spark, sf_dir)).select(*_names())


_HALF = f"SELECT {_NAMED}, a.ord AS aord, b.ord AS bord, (((a.data_type = b.data_type)::INT + (a.k = b.k)::INT) / 2.0 + 1.0 - (ABS(a.null_ratio - b.null_ratio) + ABS(a.unique_ratio - b.unique_ratio)) / 2.0) / 2 AS s {_CROSS} AND {_OK}"


def _half(spark, sf_dir):
    p = align.pairs(_catalog(spark, sf_dir))
    t, s = _type_stats(p)
    return p.withColumn("similarity", _r((t + s) / 2))


@query(f"SELECT source_dataset, source_field, target_dataset, target_field, CASE WHEN s >= 0.95 THEN 'exact' WHEN s >= 0.85 THEN 'synonym' WHEN s >= 0.70 THEN 'related' WHEN s >= 0.50 THEN 'partial' ELSE 'none' END AS alignment_type FROM (SELECT * REPLACE (ROUND(s, 6) AS s) FROM ({_HALF}))")
def align_classify(spark, sf_dir):
    return _half(spark, sf_dir).select(*_names(), align.classify(F.col("similarity")).alias("alignment_type"))


def _hint_sql() -> str:
    out = "CASE WHEN a.data_type <> b.data_type THEN 'type_cast:' || a.data_type || '->' || b.data_type"
    for left, right, name in align.UNITS:
        out += f" WHEN {_like('a.n', left)} AND {_like('b.n', right)} THEN 'unit_conversion:{name}' WHEN {_like('b.n', left)} AND {_like('a.n', right)} THEN 'unit_conversion:{name}_inverse'"
    return out + " END AS transformation_hint"


@query(f"SELECT {_NAMED}, {_hint_sql()} {_CROSS} AND {_OK}")
def align_hint(spark, sf_dir):
    return align.pairs(_catalog(spark, sf_dir)).select(*_names(), align.hint(F.col("a_field_name"), F.col("b_field_name"), F.col("a_data_type"), F.col("b_data_type")).alias("transformation_hint"))


_RESOLVED = f"SELECT * FROM (SELECT * FROM (SELECT * REPLACE (ROUND(s, 6) AS s) FROM ({_HALF})) WHERE s >= 0.8 QUALIFY ROW_NUMBER() OVER (PARTITION BY source_dataset, aord, target_dataset ORDER BY s DESC, bord) <= 3) QUALIFY ROW_NUMBER() OVER (PARTITION BY source_dataset, target_dataset, bord ORDER BY s DESC, aord) = 1"


def _resolved(spark, sf_dir):
    return align.resolve(_half(spark, sf_dir), AlignmentConfig(similarity_threshold=0.8))


@query(f"SELECT source_dataset, source_field, target_dataset, target_field, ROUND(s, 6)::DOUBLE AS similarity FROM ({_RESOLVED})")
def align_resolve(spark, sf_dir):
    return _resolved(spark, sf_dir).select(*_names(), "similarity")


@query(f"WITH r AS ({_RESOLVED}) SELECT dataset_id, field_name FROM ({_CATALOG}) c WHERE NOT EXISTS (SELECT 1 FROM r WHERE source_dataset = dataset_id AND source_field = field_name) AND NOT EXISTS (SELECT 1 FROM r WHERE target_dataset = dataset_id AND target_field = field_name)")
def align_unmatched(spark, sf_dir):
    return align.unmatched(_catalog(spark, sf_dir), _resolved(spark, sf_dir).select(*_names()))


@query()
def align_full(spark, sf_dir):
    return align.align(_catalog(spark, sf_dir)).withColumn("similarity", _r("similarity"))


@query(f"WITH r AS ({_RESOLVED}), p AS (SELECT source_field, target_field FROM r), e AS (SELECT a.field_name AS source_field, b.field_name AS target_field FROM ({_CATALOG}) a JOIN ({_CATALOG}) b ON a.ds_ord < b.ds_ord AND a.data_type = b.data_type AND split_part(a.field_name, '_', -1) = split_part(b.field_name, '_', -1)), n AS (SELECT (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM p)) AS p, (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM e)) AS e, (SELECT COUNT(*) FROM (SELECT * FROM p INTERSECT SELECT * FROM e)) AS t) SELECT ROUND(t / p::DOUBLE, 6) AS precision, ROUND(t / e::DOUBLE, 6) AS recall, ROUND(2.0 * t / (p + e), 6)::DOUBLE AS f1 FROM n")
def align_f1(spark, sf_dir):
    predicted = _resolved(spark, sf_dir).select(F.col("a_field_name").alias("source_field"), F.col("b_field_name").alias("target_field"))
    tail = lambda c: F.substring_index(c, "_", -1)
    expected = align.pairs(_catalog(spark, sf_dir), gate=False).where((F.col("a_data_type") == F.col("b_data_type")) & (tail(F.col("a_field_name")) == tail(F.col("b_field_name"))))
    expected = expected.select(F.col("a_field_name").alias("source_field"), F.col("b_field_name").alias("target_field"))
    return align.f1(predicted, expected, ["source_field", "target_field"]).select(*[_r(c).alias(c) for c in ("precision", "recall", "f1")])


# clusters


@query()
def kmeans_clusters(spark, sf_dir):
    got = cluster.kmeans(_t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), 3, order="c_custkey")
    return got.labels.withColumn("inertia", F.lit(got.inertia))


@query()
def silhouette(spark, sf_dir):
    got = cluster.kmeans(_t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), 3, order="c_custkey")
    return spark.createDataFrame([(got.silhouette, got.inertia)], "silhouette double, inertia double")


# validation

_ESCAPED = "replace(replace(replace(replace(replace(replace(substring(html, 1, 1000), chr(0), ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"SELECT page_id, regexp_replace({_ESCAPED}, '^\\s+|\\s+$', '', 'g') AS clean FROM pages")
def sanitize_text(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", validate.sanitize(F.col("html")).alias("clean"))


@query("SELECT c_custkey, regexp_matches(c_name, '^[a-zA-Z0-9][a-zA-Z0-9_-]{0,63}$') AS name_ok, regexp_matches(c_mktsegment || '-' || c_nationkey, '^[a-zA-Z0-9][a-zA-Z0-9_-]{0,63}$') AS tag_ok FROM customer")
def valid_ids(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", validate.is_dataset_id(F.col("c_name")).alias("name_ok"), validate.is_dataset_id(F.concat_ws("-", "c_mktsegment", "c_nationkey")).alias("tag_ok"))


@query(f"SELECT conv_id, turn, regexp_matches(role, '^[a-zA-Z_][a-zA-Z0-9_]*$') AND length(role) <= 128 AND lower(role) NOT IN ({', '.join(repr(k) for k in validate.KEYWORDS)}) AS role_ok, regexp_matches(text, '^[a-zA-Z_][a-zA-Z0-9_]*$') AND length(text) <= 128 AS text_ok FROM conversations")
def valid_identifiers(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", validate.is_identifier(F.col("role")).alias("role_ok"), validate.is_identifier(F.col("text")).alias("text_ok"))


@query("SELECT o_orderkey, o_totalprice BETWEEN 1000 AND 250000 AS price_ok FROM orders")
def valid_range(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", validate.in_range(F.col("o_totalprice"), 1000, 250000).alias("price_ok"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two differently named projections of customer, fused on their key, then mean imputation."""
    c = _t(spark, sf_dir, "customer")
    left = _gappy(spark, sf_dir).select("c_custkey", "c_name", "c_acctbal")
    right = c.select(F.col("c_custkey").alias("customer_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("balance"), F.col("c_mktsegment").alias("segment"))
    merged = joins.exact_merge(left, right, "c_custkey", {"customer_id": "c_custkey", "balance": "c_acctbal"})
    return impute.impute(merged, "mean", order="c_custkey")[0]


@query("WITH m AS (SELECT COALESCE(l.c_custkey, r.c_custkey) AS c_custkey, l.c_name, COALESCE(l.c_acctbal, r.balance) AS c_acctbal, r.c_mktsegment AS segment FROM (" + _GAPPY + ") l FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS balance, c_mktsegment FROM customer) r ON l.c_custkey = r.c_custkey) SELECT c_custkey, c_name, ROUND(COALESCE(c_acctbal, (SELECT AVG(c_acctbal) FROM m)), 4) AS c_acctbal, segment FROM m")
def fuse_and_impute(spark, sf_dir):
    return flagship(spark, sf_dir).withColumn("c_acctbal", _r("c_acctbal", 4))
