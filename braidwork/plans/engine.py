"""The five stages over a catalog of lazy DataFrames."""

from __future__ import annotations

import json
import logging
import uuid
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import transforms
from ..functions.validate import check_dataset_id
from ..operators import align, cluster, impute, joins, profile, semantics, stats
from ..operators.rows import ROW_ID, numbered
from ..session import checkpoint
from ..sources import readers, writers
from ..types import AlignmentError, DataType, EngineError, FusionError, ImputationMethod, JoinStrategy, SourceType
from . import metrics
from .config import EngineConfig
from .providers import DeterministicProvider, Provider

_log = logging.getLogger("braidwork")
_FIELDS = "ds_ord int, dataset_id string, ord int, field_name string, data_type string, semantic_label string, semantic_type string, description string, confidence double, null_ratio double, unique_ratio double, samples array<string>, embedding array<double>"


@dataclass
class Dataset:
    dataset_id: str
    source: str
    frame: DataFrame
    source_type: str
    created: str
    storage_path: str | None = None
    metadata: Metadata | None = None
    rows: int | None = None  # where it has been counted
    nulls: dict[str, int] | None = None  # by column, where it has been written


@dataclass
class Metadata:
    dataset_id: str
    row_count: int
    description: str
    domain_tags: list[str]
    fields: list[dict]


@dataclass
class Alignment:
    alignment_id: str
    source_dataset: str
    source_field: str
    target_dataset: str
    target_field: str
    similarity: float
    alignment_type: str
    transformation_hint: str | None = None
    human_validated: bool = False


@dataclass
class AlignmentResult:
    job_id: str
    alignments: list[Alignment]
    unmatched_fields: list[str]
    datasets: list[str] = field(default_factory=list)


@dataclass
class FusionResult:
    fused_dataset_id: str
    source_datasets: list[str]
    frame: DataFrame
    join_strategy: str
    transformations: list[dict]
    imputation: impute.ImputationSummary
    storage_path: str | None = None
    rows: int | None = None  # counted while rows were numbered
    nulls_left: dict[str, int] | None = None  # by column, counted while it was written

    @property
    def record_count(self) -> int:
        if self.rows is None:
            self.rows = self.frame.count()
        return self.rows


@dataclass
class InsightResult:
    row_count: int
    column_count: int
    statistics: list[dict] = field(default_factory=list)
    correlations: list[dict] = field(default_factory=list)
    outliers: list[dict] = field(default_factory=list)
    clusters: cluster.Clusters | None = None
    narrative: str | None = None


class Engine:
    """Holds datasets, alignments and fused results by id; listeners hear of every finished stage.

    Every stage also leaves a record (stage, ids, seconds, status, rows in and out, ...) with the listeners of
    `stage.finished` and in the log; `metrics` keeps the last thousand.
    """

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None, provider: Provider | None = None):
        self.spark, self.config = spark, config or EngineConfig()
        self.provider = provider or DeterministicProvider(self.config.interpreter.dimensions)
        self.datasets: dict[str, Dataset] = {}
        self.alignments: dict[str, AlignmentResult] = {}
        self.fused: dict[str, FusionResult] = {}
        self._listeners: dict[str, list[Callable[[dict], None]]] = {}
        self.metrics: deque[dict] = deque(maxlen=1000)

    # events

    def subscribe(self, event: str, listener: Callable[[dict], None]) -> None:
        self._listeners.setdefault(event, []).append(listener)

    def _publish(self, event: str, payload: dict) -> None:
        said = {"event_type": event, "payload": payload, "timestamp": datetime.now(timezone.utc).isoformat(), "correlation_id": metrics.correlation.get() or uuid.uuid4().hex}
        for listener in self._listeners.get(event, []):
            try:
                listener(said)
            except Exception:
                _log.exception("a listener for %s failed", event)

    def _stage(self, name: str, **facts):
        def done(record: dict) -> None:
            self.metrics.append(record)
            self._publish("stage.finished", record)

        return metrics.stage(self.spark, name, done, **facts)

    # ingest

    def ingest(self, source: str, dataset_id: str | None = None, kind: SourceType | str | None = None, storage: str | None = None, **options) -> Dataset:
        with self._stage("ingest", source=source) as said:
            frame = readers.read(self.spark, source, kind, self.config.ingestor, **options)
            d = self.register(frame, dataset_id, source, str(SourceType(kind).value if kind else readers.sniff.source_type(source).value), storage)
            said |= {"dataset_id": d.dataset_id, "rows_out": d.rows}
            return d

    def register(self, frame: DataFrame, dataset_id: str | None = None, source: str = "frame", kind: str = "frame", storage: str | None = None) -> Dataset:
        """Add a DataFrame under an id, with row numbers, as a temporary view; with a folder also as Parquet."""
        dataset_id = check_dataset_id(dataset_id or uuid.uuid4().hex)
        with self._stage("register", dataset_id=dataset_id) as said:
            frame, rows = (frame, None) if ROW_ID in frame.columns else numbered(frame)
            d = Dataset(dataset_id, source, frame, kind, datetime.now(timezone.utc).isoformat(), rows=rows)
            if storage:
                d.storage_path = f"{storage.rstrip('/')}/{dataset_id}.parquet"
                out, told = metrics.observed(frame)
                out.write.mode("overwrite").parquet(d.storage_path)
                d.frame = self.spark.read.parquet(d.storage_path)
                d.rows, d.nulls = told()
            self.datasets[dataset_id] = d
            d.frame.drop(ROW_ID).createOrReplaceTempView(dataset_id.replace("-", "_"))
            said |= {"rows_out": d.rows} | ({"nulls": d.nulls} if d.nulls is not None else {})
            self._publish("dataset.ingested", {"dataset_id": dataset_id})
            return d

    def get(self, dataset_id: str) -> DataFrame | None:
        d = self.datasets.get(dataset_id)
        return d.frame if d else None

    def sample(self, dataset_id: str, rows: int = 10) -> list[dict]:
        """The first rows, 1 to 100 of them."""
        if not 1 <= rows <= 100:
            raise EngineError("rows must be between 1 and 100")
        return [r.asDict() for r in self.datasets[dataset_id].frame.orderBy(ROW_ID).limit(rows).drop(ROW_ID).collect()]

    def drop(self, dataset_id: str) -> bool:
        return self.datasets.pop(dataset_id, None) is not None

    # interpret

    def interpret(self, dataset_id: str) -> Metadata:
        """Profile and label every column; kept with the dataset."""
        d = self.datasets[dataset_id]
        if not d.metadata:
            with self._stage("interpret", dataset_id=dataset_id) as said:
                d.metadata = self._interpreted(dataset_id, d)
                d.rows = d.metadata.row_count
                said |= {"rows_in": d.rows, "fields": len(d.metadata.fields)}
                self._publish("dataset.interpreted", {"dataset_id": dataset_id})
        return d.metadata

    def _interpreted(self, dataset_id: str, d: Dataset) -> Metadata:
        names = [c for c in d.frame.columns if c != ROW_ID]
        counted = {r.field_name: r for r in profile.counts(d.frame, names).collect()}
        heads = {r.field_name: r.samples for r in profile.samples(d.frame, self.config.interpreter.sample_values, ROW_ID).collect()}
        types = profile.infer_types(d.frame, ROW_ID)
        vectors = self._embed([f"{n}: {', '.join(heads[n][:5])}" for n in names])
        labels = {n: self._semantics(n, types[n], heads[n], counted[n].null_ratio, counted[n].unique_ratio) for n in names}
        labels |= self._by_rules([(n, types[n].value, float(counted[n].unique_ratio)) for n, said in labels.items() if said is None])
        fields = []
        for n, v in zip(names, vectors):
            c, said = counted[n], labels[n]
            fields.append({"field_name": n, "data_type": types[n].value, "null_ratio": c.null_ratio, "unique_ratio": c.unique_ratio, "samples": heads[n], "embedding": v} | said)
        rows = next(iter(counted.values())).row_count if counted else d.frame.count()
        text = self._description(dataset_id, rows, fields)
        tags = self.spark.range(1).select(semantics.domain_tags(F.lit(" ".join(f"{f['field_name']} {f['semantic_label']}" for f in fields) + " " + text)).alias("t")).first().t
        return Metadata(dataset_id, rows, text, list(tags), fields)

    def _embed(self, texts: list[str]) -> list[list[float]]:
        try:
            return self.provider.embed(texts)
        except Exception as e:
            _log.warning("embedding failed: %s", e)
            return [[0.0] * self.config.interpreter.dimensions for _ in texts]

    def _semantics(self, name: str, kind: DataType, samples: list[str], null_ratio: float, unique_ratio: float) -> dict | None:
        """What the provider says of a column; None if it fails."""
        prompt = f"Field Name: {name}\nData Type: {kind.value}\nSample Values: {samples[:10]}\nNull Ratio: {null_ratio:.4f}\nUnique Ratio: {unique_ratio:.4f}\nAnswer with JSON: semantic_label, description, semantic_type, confidence."
        try:
            got = json.loads(self.provider.complete([{"role": "user", "content": prompt}]))
            kinds = ("identifier", "metric", "category", "timestamp", "text", "unknown")
            return {"semantic_label": str(got["semantic_label"]), "description": str(got.get("description", "")), "semantic_type": got.get("semantic_type") if got.get("semantic_type") in kinds else "unknown", "confidence": float(got.get("confidence", 0.5))}
        except Exception as e:
            _log.warning("labelling %s by rules: %s", name, e)
            return None

    def _by_rules(self, columns: list[tuple[str, str, float]]) -> dict[str, dict]:
        """The fallback's labels of (name, type, distinct ratio), in one job."""
        if not columns:
            return {}
        table = self.spark.createDataFrame(columns, "name string, type string, ratio double")
        rule = semantics.fallback(F.col("name"), F.col("type"), F.col("ratio"))
        return {r.name: r.r.asDict() for r in table.select("name", rule.alias("r")).collect()}

    def _description(self, dataset_id: str, rows: int, fields: list[dict]) -> str:
        labels = ", ".join(f["semantic_label"] for f in fields[:10])
        try:
            return self.provider.complete([{"role": "user", "content": f"Describe the dataset {dataset_id}: {rows} rows, fields {labels}. Two or three sentences."}]).strip()
        except Exception as e:
            _log.warning("description failed: %s", e)
            # a fixed value
            return f"Dataset with {rows} rows and {len(fields)} fields including: {labels}"

    def fields(self, dataset_ids: list[str]) -> DataFrame:
        rows = []
        for o, i in enumerate(dataset_ids):
            for n, f in enumerate(self.interpret(i).fields):
                v = f["embedding"] if any(f["embedding"]) else None
                rows.append((o, i, n, f["field_name"], f["data_type"], f["semantic_label"], f["semantic_type"], f["description"], f["confidence"], f["null_ratio"], f["unique_ratio"], [str(s) for s in f["samples"]], v))
        return self.spark.createDataFrame(rows, _FIELDS)

    # align

    def align(self, dataset_ids: list[str], confidence_threshold: float | None = None, include_partial: bool = True) -> AlignmentResult:
        if len(dataset_ids) < 2:
            raise AlignmentError("At least two datasets are needed")
        with self._stage("align", datasets=list(dataset_ids)) as said:
            fields = self.fields(dataset_ids)
            edges = checkpoint(align.align(fields, self.config.alignment, confidence_threshold, include_partial))
            found = [Alignment(uuid.uuid4().hex, *r) for r in edges.orderBy(F.desc("similarity")).collect()]  # of fields, not rows
            left = [f"{r.dataset_id}.{r.field_name}" for r in align.unmatched(fields, edges).collect()]
            out = AlignmentResult(uuid.uuid4().hex, found, sorted(left), list(dataset_ids))
            self.alignments[out.job_id] = out
            said |= {"job_id": out.job_id, "alignments": len(found), "unmatched": len(left)}
            self._publish("ontology.aligned", {"job_id": out.job_id})
            return out

    def validate(self, job_id: str, alignment_id: str, validated: bool = True) -> Alignment:
        for a in self.alignments[job_id].alignments:
            if a.alignment_id == alignment_id:
                a.human_validated = validated
                return a
        raise AlignmentError(f"No alignment {alignment_id}")

    # fuse

    def strategy(self, edges: list[Alignment], left: DataFrame, right: DataFrame, key: str | None) -> JoinStrategy:
        """Exact if a key is given or an exact or synonym edge fits both tables, else by similarity."""
        fits = any(a.alignment_type in ("exact", "synonym") and _orient(a, left, right) for a in edges)
        return JoinStrategy.EXACT_KEY if key or fits else JoinStrategy.SEMANTIC_SIMILARITY

    def merge(self, left: DataFrame, right: DataFrame, edges: list[Alignment], strategy: JoinStrategy = JoinStrategy.AUTO, key: str | None = None, reconcile: bool = False) -> tuple[DataFrame, JoinStrategy, list[dict]]:
        """Transform, then join two tables; the strategy used and what was transformed. Both need row ids.

        Hints are applied to the target column by the name they carry; with reconcile, in the direction that brings the
        target's unit or type to the source's.
        """
        out, strategy, logs, _ = self._merge(left, right, edges, strategy, key, reconcile)
        return out, strategy, logs

    def _merge(self, left: DataFrame, right: DataFrame, edges: list[Alignment], strategy: JoinStrategy, key: str | None, reconcile: bool) -> tuple[DataFrame, JoinStrategy, list[dict], int]:
        """merge(), and its number of rows."""
        c = self.config.fusion
        hints = [(a.target_field, _reversed(a.transformation_hint) if reconcile else a.transformation_hint) for a in edges if a.transformation_hint and a.target_field in right.columns]
        right, told = transforms.applied(right, hints, ROW_ID)
        logs = [r.asDict() for r in told.collect()] if hints else []  # a row per hint
        if strategy is JoinStrategy.AUTO:
            strategy = self.strategy(edges, left, right, key)
        if strategy in (JoinStrategy.PROBABILISTIC, JoinStrategy.TEMPORAL) and not c.experimental_strategies:
            _log.warning("%s is experimental and disabled; joining by similarity", strategy.value)
            strategy = JoinStrategy.SEMANTIC_SIMILARITY
        oriented = [p for p in (_orient(a, left, right) for a in edges) if p]
        if strategy is JoinStrategy.EXACT_KEY:
            column_map = {r: l_ for l_, r in oriented}
            own = _key(edges, left, right, column_map, key)
            plain = right.drop(ROW_ID)
            out = joins.exact_merge(left.drop(ROW_ID), plain, own, column_map) if own else joins.concat(left.drop(ROW_ID), plain)
            out, rows = numbered(out)
            return out, strategy, logs, rows
        forward = [(a.source_field, a.target_field) for a in edges if a.source_field in left.columns and a.target_field in right.columns]
        r = right.withColumnRenamed(ROW_ID, "__rid")
        if strategy is JoinStrategy.PROBABILISTIC:
            out = joins.probabilistic_join(left, r, forward, ROW_ID, "__rid", c.probabilistic_threshold)
        elif strategy is JoinStrategy.TEMPORAL:
            ts = next(((a, b) for a, b in forward if "time" in a.lower() or "date" in a.lower()), None)
            if ts:
                parsed = [df.withColumn(n, transforms.to_datetime(F.col(n))) if dict(df.dtypes)[n] == "string" else df for df, n in ((left, ts[0]), (r, ts[1]))]
                out = joins.temporal_join(*parsed, *ts, ROW_ID, "__rid", c.temporal_tolerance_seconds)
            else:
                out = joins.concat(left, r.drop("__rid"))
        else:
            out = joins.semantic_join(left, r, forward, ROW_ID, "__rid", c.semantic_threshold)
        out, rows = numbered(out.drop(ROW_ID, "__rid"))
        return out, strategy, logs, rows

    def fuse(self, dataset_ids: list[str], alignment: AlignmentResult, strategy: JoinStrategy | str | None = None, key: str | None = None, imputation: ImputationMethod | str | None = None, output: str | None = None, output_format: str | None = None, reconcile: bool = False) -> FusionResult:
        """Merge the datasets in order, each that shares an edge with one already in; impute; write if a path is given."""
        with self._stage("fuse", datasets=list(dataset_ids)) as said:
            strategy = JoinStrategy(strategy) if strategy else self.config.fusion.default_join_strategy
            edges: dict[tuple[str, str], list[Alignment]] = {}
            for a in alignment.alignments:
                edges.setdefault((a.source_dataset, a.target_dataset), []).append(a)
            used_strategy, logs, counts = [], [], []

            def step(left: DataFrame, right: DataFrame, own: dict) -> DataFrame:
                out, s, log, n = self._merge(left, right, [a for e in own.values() for a in e], strategy, key, reconcile)
                used_strategy.append(s)
                logs.extend(log)
                counts.append(n)
                said.setdefault("merges", []).append({"strategy": s.value, "rows_out": n, "values_transformed": sum(x["records_affected"] for x in log)})
                return out

            missing = [i for i in dataset_ids if i not in self.datasets]
            if missing:
                raise FusionError(f"Unknown datasets: {missing}")
            frame, used = joins.fold({i: self.datasets[i].frame for i in dataset_ids}, edges, step)
            for i in set(dataset_ids) - set(used):
                _log.warning("%s shares no alignment and is left out", i)
            c = self.config.fusion
            frame, summary = impute.impute(frame, imputation or c.imputation_method, c.max_null_ratio, c.knn_neighbors, ROW_ID)
            reported = used_strategy[-1] if used_strategy else (JoinStrategy.EXACT_KEY if strategy is JoinStrategy.AUTO else strategy)
            out = FusionResult(uuid.uuid4().hex, used, frame.drop(ROW_ID), reported.value, logs, summary, rows=counts[-1] if counts else self.datasets[used[0]].rows if used else None)
            if output:
                written, told = metrics.observed(out.frame.drop(*[x for x in out.frame.columns if x.startswith("__")]))
                out.storage_path = writers.write(written, output, output_format or c.output_format)
                out.rows, out.nulls_left = told()
            self.fused[out.fused_dataset_id] = out
            said |= {"fused_dataset_id": out.fused_dataset_id, "rows_in": {i: self.datasets[i].rows for i in used}, "rows_out": out.rows, "nulls_filled": summary.total_nulls_filled, "nulls_left": out.nulls_left}
            self._publish("dataset.fused", {"fused_dataset_id": out.fused_dataset_id})
            return out

    def download(self, fused_id: str, path: str, kind: str = "parquet") -> str:
        return writers.write(self.fused[fused_id].frame, path, kind, single_file=True)

    # analyze

    def analyze(self, frame: DataFrame, do: tuple[str, ...] = ("statistics", "correlations", "outliers")) -> InsightResult:
        with self._stage("analyze", did=list(do)) as said:
            c = self.config.insight
            frame, n = (frame, frame.count()) if ROW_ID in frame.columns else numbered(frame)
            out = InsightResult(n, len([x for x in frame.columns if x != ROW_ID]))
            rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  a row per column or pair
            numeric = [x for x in stats.numeric_columns(frame.schema)]
            if numeric and "statistics" in do:
                out.statistics = rows(stats.describe(frame))
            if len(numeric) > 1 and "correlations" in do:
                out.correlations = rows(stats.correlations(frame, c.correlation_method, c.correlation_threshold))
            if numeric and "outliers" in do:
                out.outliers = rows(stats.outlier_report(frame, c.outlier_multiplier))
            if c.clustering or "clustering" in do:
                out.clusters = cluster.kmeans(frame, c.n_clusters)
            if c.narrative or "narrative" in do:
                try:
                    facts = json.dumps({"rows": out.row_count, "statistics": out.statistics, "correlations": out.correlations, "outliers": out.outliers}, default=str)
                    out.narrative = self.provider.complete([{"role": "user", "content": f"Explain these results briefly: {facts}"}]).strip()
                except Exception as e:
                    _log.warning("narrative failed: %s", e)
            said |= {"rows_in": out.row_count, "columns": out.column_count}
            self._publish("insight.generated", {"row_count": out.row_count})
            return out


def _orient(a: Alignment, left: DataFrame, right: DataFrame) -> tuple[str, str] | None:
    """(left field, right field) of an edge in whichever direction fits."""
    if a.source_field in left.columns and a.target_field in right.columns:
        return a.source_field, a.target_field
    if a.target_field in left.columns and a.source_field in right.columns:
        return a.target_field, a.source_field
    return None


def _key(edges: list[Alignment], left: DataFrame, right: DataFrame, column_map: dict[str, str], key: str | None) -> str | None:
    """The left key column: the one named (mapped, or same-named on both sides), else the first exact or synonym edge's, else any edge's."""
    if key:
        if key in left.columns and (key in column_map.values() or key in right.columns):
            return key
        if key in column_map:
            return column_map[key]
        return None
    strong = [a for a in edges if a.alignment_type in ("exact", "synonym")]
    for a in [*strong, *edges]:
        p = _orient(a, left, right)
        if p:
            return p[0]
    return None


def _reversed(hint: str) -> str:
    kind, _, what = hint.partition(":")
    if kind == "type_cast":
        a, _, b = what.partition("->")
        return f"type_cast:{b}->{a}"
    return f"{kind}:{what.removesuffix('_inverse') if what.endswith('_inverse') else what + '_inverse'}"
