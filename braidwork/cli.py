"""Command line: ingest, describe, align, fuse, analyze."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .plans.config import EngineConfig, load
from .plans.engine import Engine
from .plans.metrics import log_to
from .plans.providers import DeterministicProvider, HttpProvider, Provider
from .session import session
from .types import ConfigurationError, EngineError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="braidwork")
    p.add_argument("--config")
    p.add_argument("--log", choices=("json", "text"), help="write the log, with a record of each stage, to stderr")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *files: str) -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        for f in files:
            s.add_argument(f)
        s.add_argument("--format", choices=("table", "json"), default="table")
        s.add_argument("--provider", choices=("deterministic", "http"), default="deterministic")
        s.add_argument("--provider-url", help="base URL of a chat-completions and embeddings service; its key is read from BRAIDWORK_API_KEY")
        s.add_argument("--chat-model", default="")
        s.add_argument("--embedding-model", default="")
        return s

    add("ingest", "file").add_argument("--dataset-id")
    add("describe", "file")
    add("align", "file1", "file2").add_argument("--threshold", type=float, default=0.5)
    f = add("fuse", "file1", "file2")
    f.add_argument("--key")
    f.add_argument("--strategy", choices=("auto", "exact", "semantic", "probabilistic", "temporal"), default="auto")
    f.add_argument("--imputation", choices=("none", "mean", "median", "mode", "knn"), default="mean")
    f.add_argument("--output")
    f.add_argument("--output-format", choices=("csv", "parquet"), default="csv")
    a = add("analyze", "file")
    for flag in ("--stats", "--correlations", "--outliers", "--clustering", "--narrative"):
        a.add_argument(flag, action="store_true")
    a.add_argument("--n-clusters", type=int, default=3)
    a.add_argument("--output")
    return p


def provider(args: argparse.Namespace, config: EngineConfig) -> Provider:
    dimensions = config.interpreter.dimensions
    if args.provider == "deterministic":
        return DeterministicProvider(dimensions)
    if not args.provider_url:
        raise ConfigurationError("--provider http needs --provider-url")
    return HttpProvider(args.provider_url, os.environ.get("BRAIDWORK_API_KEY", ""), args.chat_model, args.embedding_model, dimensions)


def run(args: argparse.Namespace, engine: Engine) -> dict:
    if args.command == "ingest":
        d = engine.ingest(args.file, args.dataset_id)
        return {"dataset_id": d.dataset_id, "rows": d.frame.count(), "columns": [c for c in d.frame.columns if c != "__row_id"], "sample": engine.sample(d.dataset_id)}
    if args.command == "describe":
        m = engine.interpret(engine.ingest(args.file).dataset_id)
        return {"rows": m.row_count, "description": m.description, "domain_tags": m.domain_tags, "fields": [{k: v for k, v in f.items() if k != "embedding"} for f in m.fields]}
    if args.command == "analyze":
        c = engine.config.insight
        c.n_clusters = args.n_clusters
        chosen = tuple(n for n, on in (("statistics", args.stats), ("correlations", args.correlations), ("outliers", args.outliers)) if on)
        extra = tuple(n for n, on in (("clustering", args.clustering), ("narrative", args.narrative)) if on)
        r = engine.analyze(engine.ingest(args.file).frame, (chosen or ("statistics", "correlations", "outliers")) + extra)
        out = {"rows": r.row_count, "columns": r.column_count, "statistics": r.statistics, "correlations": r.correlations, "outliers": r.outliers}
        if r.clusters:
            sizes = r.clusters.labels.groupBy("cluster").count().orderBy("cluster").collect()
            out["clusters"] = {"sizes": {str(x["cluster"]): x["count"] for x in sizes}, "centroids": r.clusters.centroids, "inertia": r.clusters.inertia, "silhouette": r.clusters.silhouette}
        return out | ({"narrative": r.narrative} if r.narrative else {})
    if args.command == "align":
        engine.config.alignment.similarity_threshold = args.threshold
    ids = [engine.ingest(f).dataset_id for f in (args.file1, args.file2)]
    found = engine.align(ids)
    edges = [vars(a) for a in found.alignments]
    if args.command == "align":
        return {"alignments": edges, "unmatched_fields": found.unmatched_fields}
    strategy = {"exact": "exact_key", "semantic": "semantic_similarity"}.get(args.strategy, args.strategy)
    r = engine.fuse(ids, found, strategy, args.key, args.imputation, args.output, args.output_format)
    return {"records": r.record_count, "fields": r.frame.columns, "join_strategy": r.join_strategy, "transformations": r.transformations, "nulls_filled": r.imputation.total_nulls_filled, "output": r.storage_path}


def shown(result: dict) -> str:
    lines = []
    for k, v in result.items():
        if isinstance(v, list) and v and isinstance(v[0], dict):
            names = list(v[0])
            rows = [names, *[[("" if r[n] is None else f"{r[n]:.4g}" if isinstance(r[n], float) else str(r[n]))[:40] for n in names] for r in v]]
            wide = [max(len(r[i]) for r in rows) for i in range(len(names))]
            lines += [f"{k}:", *["  " + "  ".join(c.ljust(w) for c, w in zip(r, wide)) for r in rows]]
        else:
            lines.append(f"{k}: {v}")
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.log:
        log_to(as_json=args.log == "json")
    try:
        config = load(args.config) if args.config else EngineConfig()
        config.fusion.experimental_strategies |= getattr(args, "strategy", "") in ("probabilistic", "temporal")
        result = run(args, Engine(session(), config, provider(args, config)))
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    text = json.dumps(result, default=str, indent=2) if args.format == "json" else shown(result)
    if args.command == "analyze" and args.output:
        with open(args.output, "w") as f:
            f.write(text + "\n")
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
