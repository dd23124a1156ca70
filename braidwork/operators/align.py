"""Matching the fields of datasets: gate, four signals, threshold, conflicts, and how well it did.

A fields table has a row per column: ds_ord (order of the dataset), dataset_id, ord (order of the field), field_name,
semantic_label, data_type, semantic_type, null_ratio, unique_ratio, embedding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.similarity import similarity
from ..functions.vectors import cosine
from ..types import AlignmentConfig

#: Words for the source's unit, for the target's, and the transform between.
UNITS = (
    (("celsius", "temp_c"), ("fahrenheit", "temp_f"), "celsius_to_fahrenheit"),
    (("kg", "kilogram"), ("lb", "pound"), "kg_to_lb"),
    (("meter", "metres"), ("feet", "ft"), "m_to_ft"),
    (("days",), ("months",), "days_to_months"),
)


def compatible(a: Column, b: Column) -> Column:
    """False for datetime against boolean, integer or float, and for boolean against float."""
    clash = lambda x, y: ((x == "datetime") & y.isin("boolean", "integer", "float")) | ((x == "boolean") & (y == "float"))
    return ~(clash(a, b) | clash(b, a))


def type_match(dt_a: Column, dt_b: Column, st_a: Column, st_b: Column) -> Column:
    return ((dt_a == dt_b).cast("double") + (st_a == st_b).cast("double")) / 2.0


def stats_match(null_a: Column, null_b: Column, unique_a: Column, unique_b: Column) -> Column:
    return 1.0 - (F.abs(null_a - null_b) + F.abs(unique_a - unique_b)) / 2.0


def classify(score: Column, c: AlignmentConfig | None = None) -> Column:
    c = c or AlignmentConfig()
    return (
        F.when(score >= c.exact_match_threshold, "exact").when(score >= c.synonym_threshold, "synonym")
        .when(score >= c.related_threshold, "related").when(score >= c.similarity_threshold, "partial").otherwise("none")
    )


def hint(name_a: Column, name_b: Column, type_a: Column, type_b: Column) -> Column:
    """`type_cast:a->b` where types differ, else the unit conversion that substrings of the names suggest, else null."""
    a, b = F.lower(name_a), F.lower(name_b)
    has = lambda n, words: n.rlike("|".join(words))
    out = F.when(type_a != type_b, F.concat(F.lit("type_cast:"), type_a, F.lit("->"), type_b))
    for left, right, name in UNITS:
        out = out.when(has(a, left) & has(b, right), f"unit_conversion:{name}").when(has(b, left) & has(a, right), f"unit_conversion:{name}_inverse")
    return out


def pairs(fields: DataFrame, gate: bool = True) -> DataFrame:
    """All pairs of fields of different datasets, the earlier dataset as source; columns are prefixed a_ and b_.

    A fields table has a row per column of each dataset: metadata, whatever the size of the data.
    """
    a = fields.select([F.col(c).alias(f"a_{c}") for c in fields.columns])
    b = fields.select([F.col(c).alias(f"b_{c}") for c in fields.columns])
    ok = F.col("a_ds_ord") < F.col("b_ds_ord")
    return a.join(b, (ok & compatible(F.col("a_data_type"), F.col("b_data_type"))) if gate else ok)


def score(p: DataFrame, c: AlignmentConfig) -> DataFrame:
    """pairs() with similarity: weighted name, embedding (or label), type and profile signals, capped at 1."""
    clean = lambda x: F.replace(F.lower(x), F.lit("_"), F.lit(" "))
    p = p.withColumns({
        "__name": similarity(clean(F.col("a_field_name")), clean(F.col("b_field_name")), "token_set"),
        "__label": similarity(F.lower("a_semantic_label"), F.lower("b_semantic_label"), "token_set"),
    })
    near = cosine(F.col("a_embedding"), F.col("b_embedding"))
    vector = F.when(near > 1, 1.0).otherwise(F.coalesce(near, F.col("__label")))  # least() would take a null for 1
    w = c.scoring_weights
    total = (
        w.name * F.col("__name") + w.embedding * vector
        + w.type_match * type_match(F.col("a_data_type"), F.col("b_data_type"), F.col("a_semantic_type"), F.col("b_semantic_type"))
        + w.stats * stats_match(F.col("a_null_ratio"), F.col("b_null_ratio"), F.col("a_unique_ratio"), F.col("b_unique_ratio"))
    )
    return p.withColumn("similarity", F.least(total, F.lit(1.0))).drop("__name", "__label")


def resolve(scored: DataFrame, c: AlignmentConfig) -> DataFrame:
    """Edges at or above the threshold: the best few per source field, then (by policy) the best per target field."""
    per_source = W.partitionBy("a_dataset_id", "a_ord", "b_dataset_id").orderBy(F.desc("similarity"), "b_ord")
    out = scored.where(F.col("similarity") >= c.similarity_threshold).withColumn("__n", F.row_number().over(per_source)).where(F.col("__n") <= c.max_alignments_per_field)
    if c.conflict_resolution == "highest_similarity":
        per_target = W.partitionBy("a_dataset_id", "b_dataset_id", "b_ord").orderBy(F.desc("similarity"), "a_ord")
        out = out.withColumn("__n", F.row_number().over(per_target)).where("__n = 1")
    return out.drop("__n")


def align(fields: DataFrame, c: AlignmentConfig | None = None, confidence_threshold: float | None = None, include_partial: bool = True) -> DataFrame:
    """The alignments of all pairs of datasets: source and target, similarity, alignment_type, transformation_hint."""
    c = c or AlignmentConfig()
    edges = resolve(score(pairs(fields, c.enforce_type_compatibility), c), c)
    out = edges.select(
        F.col("a_dataset_id").alias("source_dataset"), F.col("a_field_name").alias("source_field"),
        F.col("b_dataset_id").alias("target_dataset"), F.col("b_field_name").alias("target_field"),
        "similarity", classify(F.col("similarity"), c).alias("alignment_type"),
        hint(F.col("a_field_name"), F.col("b_field_name"), F.col("a_data_type"), F.col("b_data_type")).alias("transformation_hint"),
    )
    if confidence_threshold is not None:
        out = out.where(F.col("similarity") >= confidence_threshold)
    return out if include_partial else out.where("alignment_type <> 'partial'")


def unmatched(fields: DataFrame, alignments: DataFrame) -> DataFrame:
    """(dataset_id, field_name) of fields in no alignment."""
    used = alignments.select(F.col("source_dataset").alias("dataset_id"), F.col("source_field").alias("field_name")).unionByName(
        alignments.select(F.col("target_dataset").alias("dataset_id"), F.col("target_field").alias("field_name"))
    )
    return fields.select("dataset_id", "field_name").join(used.distinct(), ["dataset_id", "field_name"], "left_anti")


def f1(predicted: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """One row: precision, recall, f1 of distinct pairs; all 1 if both are empty, 0 where a side alone is."""
    p, e = predicted.select(*by).distinct(), expected.select(*by).distinct()
    n = (
        p.withColumn("__p", F.lit(1)).join(e.withColumn("__e", F.lit(1)), by, "full")
        .agg(F.count("__p").alias("p"), F.count("__e").alias("e"), F.count(F.when(F.col("__p").isNotNull() & F.col("__e").isNotNull(), 1)).alias("t"))
    )
    both = (F.col("p") == 0) & (F.col("e") == 0)
    share = lambda d: F.when(both, 1.0).otherwise(F.coalesce(F.try_divide(F.col("t").cast("double"), d), F.lit(0.0)))
    return n.select(share(F.col("p")).alias("precision"), share(F.col("e")).alias("recall"), F.when(both, 1.0).otherwise(F.coalesce(F.try_divide(2.0 * F.col("t"), F.col("p") + F.col("e")), F.lit(0.0))).alias("f1"))
