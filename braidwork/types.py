"""Enumerations, configurations and errors shared by the stages."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T


class DataType(str, Enum):
    STRING, INTEGER, FLOAT, DATETIME, BOOLEAN, OBJECT = "string", "integer", "float", "datetime", "boolean", "object"


class SemanticType(str, Enum):
    IDENTIFIER, METRIC, CATEGORY, TIMESTAMP, TEXT, UNKNOWN = "identifier", "metric", "category", "timestamp", "text", "unknown"


class AlignmentType(str, Enum):
    EXACT, SYNONYM, RELATED, PARTIAL, NONE = "exact", "synonym", "related", "partial", "none"


class JoinStrategy(str, Enum):
    AUTO, EXACT_KEY, SEMANTIC_SIMILARITY, PROBABILISTIC, TEMPORAL = "auto", "exact_key", "semantic_similarity", "probabilistic", "temporal"


class ImputationMethod(str, Enum):
    NONE, MEAN, MEDIAN, MODE, KNN, MODEL = "none", "mean", "median", "mode", "knn", "model"


class SourceType(str, Enum):
    CSV, PARQUET, JSON, EXCEL, SQL, REST = "csv", "parquet", "json", "excel", "sql", "rest"


@dataclass
class IngestorConfig:
    max_file_size_mb: int = 500
    sample_rows: int = 10
    encoding_sample_bytes: int = 10_000
    sql_timeout: int = 300
    rest_timeout: int = 60
    experimental_sources: bool = False


@dataclass
class InterpreterConfig:
    dimensions: int = 1536
    sample_values: int = 20
    batch_size: int = 50


@dataclass
class ScoringWeights:
    name: float = 0.30
    embedding: float = 0.40
    type_match: float = 0.15
    stats: float = 0.15


@dataclass
class AlignmentConfig:
    similarity_threshold: float = 0.50
    exact_match_threshold: float = 0.95
    synonym_threshold: float = 0.85
    related_threshold: float = 0.70
    max_alignments_per_field: int = 3
    conflict_resolution: str = "highest_similarity"
    enforce_type_compatibility: bool = True
    scoring_weights: ScoringWeights = field(default_factory=ScoringWeights)


@dataclass
class FusionConfig:
    default_join_strategy: JoinStrategy = JoinStrategy.AUTO
    semantic_threshold: float = 0.85
    probabilistic_threshold: float = 0.75
    temporal_tolerance_seconds: int = 3600
    imputation_method: ImputationMethod = ImputationMethod.MEAN
    knn_neighbors: int = 5
    max_null_ratio: float = 0.5
    output_format: str = "csv"
    experimental_strategies: bool = False


@dataclass
class InsightConfig:
    correlation_method: str = "pearson"
    correlation_threshold: float = 0.5
    outlier_multiplier: float = 1.5
    clustering: bool = False
    n_clusters: int = 3
    narrative: bool = False


class EngineError(Exception):
    """Base of the engine's errors."""


class IngestionError(EngineError): ...


class InterpretationError(EngineError): ...


class AlignmentError(EngineError): ...


class FusionError(EngineError): ...


class InsightError(EngineError): ...


class ConfigurationError(EngineError): ...


class ValidationError(EngineError): ...


def data_type_of(kind: T.DataType) -> DataType:
    """The logical type of a Spark type, before strings are looked into."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return DataType.INTEGER
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return DataType.FLOAT
    if isinstance(kind, T.BooleanType):
        return DataType.BOOLEAN
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DataType.DATETIME
    if isinstance(kind, (T.StringType, T.StructType, T.ArrayType, T.MapType)):
        return DataType.STRING
    return DataType.OBJECT


def numeric_columns(schema: T.StructType, leave_out: tuple[str, ...] = ("__row_id",)) -> list[str]:
    """Integer, float and decimal columns; booleans are none."""
    return [f.name for f in schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in leave_out]
