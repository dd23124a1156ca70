"""Configuration: environment over YAML over defaults."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field, fields, is_dataclass

from ..types import AlignmentConfig, ConfigurationError, FusionConfig, IngestorConfig, InsightConfig, InterpreterConfig


@dataclass
class EngineConfig:
    ingestor: IngestorConfig = field(default_factory=IngestorConfig)
    interpreter: InterpreterConfig = field(default_factory=InterpreterConfig)
    alignment: AlignmentConfig = field(default_factory=AlignmentConfig)
    fusion: FusionConfig = field(default_factory=FusionConfig)
    insight: InsightConfig = field(default_factory=InsightConfig)


def coerce(text: str) -> bool | int | float | str:
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def _apply(target, values: dict, where: str = ""):
    known = {f.name for f in fields(target)}
    for k, v in values.items():
        if k not in known:
            continue
        now = getattr(target, k)
        if is_dataclass(now):
            if not isinstance(v, dict):
                raise ConfigurationError(f"{where}{k} must be a section")
            _apply(now, v, f"{where}{k}.")
        else:
            setattr(target, k, type(now)(v) if not isinstance(now, bool) else bool(v))


def load(path: str | None = None, env: dict[str, str] | None = None, prefix: str = "BRAIDWORK_") -> EngineConfig:
    """Defaults, then the YAML file, then variables such as BRAIDWORK_FUSION__MAX_NULL_RATIO."""
    config = EngineConfig()
    if path:
        import yaml

        try:
            with open(path) as f:
                _apply(config, yaml.safe_load(f) or {})
        except (OSError, yaml.YAMLError) as e:
            raise ConfigurationError(f"Cannot read {path}: {e}") from e
    for k, v in (os.environ if env is None else env).items():
        if k.startswith(prefix):
            parts, value = k[len(prefix) :].lower().split("__"), coerce(v)
            for p in reversed(parts):
                value = {p: value}
            _apply(config, value)
    return config


def as_dict(config: EngineConfig) -> dict:
    return asdict(config)
