"""What a column means, from its name and profile: two rule sets, domain tags, labels. All are when-chains on a fields table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words of both rule sets and of the domains, in the order they are tried.
FALLBACK_ID = ("id", "key", "code", "uuid")
FALLBACK_TIME = ("date", "time", "created", "updated", "timestamp")
FALLBACK_METRIC = ("count", "amount", "total", "sum", "avg", "price", "cost")
ID = ("id", "key", "code", "uuid", "identifier", "pk")
TIME = ("date", "time", "created", "updated", "timestamp", "dob", "born", "hired", "started", "ended", "expires")
METRIC = (
    "count", "amount", "total", "sum", "avg", "price", "cost", "salary", "revenue", "profit", "score",
    "rate", "ratio", "percent", "weight", "height", "age", "quantity", "budget", "income", "pay",
    "compensation", "balance", "fee", "tax", "value",
)
CATEGORY = (
    "type", "status", "category", "group", "class", "level", "tier", "dept", "department", "team", "role", "gender",
    "country", "state", "city", "region",
)
TEXT = ("name", "title", "label", "description", "comment", "note", "text", "email", "address", "phone", "url")
DOMAINS = {
    "healthcare": ("patient", "diagnosis", "treatment", "medical", "hospital", "drug", "clinical"),
    "genomics": ("gene", "dna", "rna", "sequence", "mutation", "variant", "expression"),
    "finance": ("price", "revenue", "profit", "transaction", "account", "payment", "currency"),
    "ecommerce": ("product", "order", "customer", "cart", "shipping", "inventory"),
    "marketing": ("campaign", "conversion", "click", "impression", "engagement"),
    "hr": ("employee", "salary", "department", "hire", "performance"),
    "logistics": ("shipment", "delivery", "warehouse", "route", "tracking"),
}


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def humanize(name: Column) -> Column:
    return titled(F.translate(name, "_-", "  "))


def titled(text: Column) -> Column:
    """Every letter after none in upper case, the others in lower case."""
    return F.array_join(F.transform(F.split(text, r"(?<=[^\p{L}])(?=\p{L})"), F.initcap), "")


def _label(kind: Column, confidence: Column, label: Column, description: Column) -> Column:
    return F.struct(kind.alias("semantic_type"), confidence.alias("confidence"), label.alias("semantic_label"), description.alias("description"))


def fallback(name: Column, data_type: Column, unique_ratio: Column) -> Column:
    """Struct of semantic_type, confidence, semantic_label, description: substrings of the name, then the distinct ratio."""
    # Kinds, confidences, labels and descriptions below.
    n = F.lower(name)
    numeric = data_type.isin("integer", "float")
    say = lambda kind, conf, label, text: _label(F.lit(kind), F.lit(conf), F.lit(label), F.concat(F.lit(text + ": "), name))
    rest = _label(F.when(data_type == "string", "text").otherwise("unknown"), F.lit(0.3), titled(F.translate(name, "_", " ")), F.concat(F.lit("Field: "), name))
    return (
        F.when(_holds(n, FALLBACK_ID), say("identifier", 0.7, "Identifier", "Unique identifier field"))
        .when(_holds(n, FALLBACK_TIME), say("timestamp", 0.7, "Timestamp", "Date/time field"))
        .when(numeric & _holds(n, FALLBACK_METRIC), say("metric", 0.6, "Numeric Metric", "Numeric measurement"))
        .when(unique_ratio < 0.1, say("category", 0.5, "Category", "Categorical field"))
        .otherwise(rest)
    )


class Rule(NamedTuple):
    kind: str
    words: tuple[str, ...]
    confidence: float
    text: str
    whole: bool = False  # the words are whole parts between underscores, else substrings
    more: str = ""  # added to the label


# Kinds in the order they are tried, their confidences and texts.
RULES = (
    Rule("identifier", ID, 0.85, "Unique identifier", True, " Identifier"),
    Rule("timestamp", TIME, 0.80, "Date/time field"),
    Rule("metric", METRIC, 0.75, "Numeric measurement"),
    Rule("category", CATEGORY, 0.70, "Categorical field"),
    Rule("text", TEXT, 0.70, "Text field"),
    Rule("unknown", ("",), 0.40, "Field"),
)


def provider_rules(name: Column) -> Column:
    """What RULES say of a name: the first one that it meets; the last one takes any."""
    parts, chain = F.split(F.lower(name), "_"), []
    for r in RULES:
        met = F.arrays_overlap(parts, F.array(*map(F.lit, r.words))) if r.whole else _holds(F.lower(name), r.words)
        chain.append(F.when(met, _label(F.lit(r.kind), F.lit(r.confidence), F.concat(humanize(name), F.lit(r.more)), F.concat(F.lit(r.text + ": "), name))))
    return F.coalesce(*chain)


def domain_tags(text: Column) -> Column:
    """The first three domains one of whose words the text holds, else `general`."""
    t = F.lower(text)
    hits = F.filter(F.array(*[F.when(_holds(t, words), d) for d, words in DOMAINS.items()]), lambda x: x.isNotNull())
    return F.when(F.size(hits) == 0, F.array(F.lit("general"))).otherwise(F.slice(hits, 1, 3))


def dataset_tags(fields: DataFrame) -> DataFrame:
    """(dataset_id, tags) from the names and labels of each dataset's fields."""
    text = fields.groupBy("dataset_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "field_name", "semantic_label"))), " ").alias("t"))
    return text.select("dataset_id", domain_tags(F.col("t")).alias("tags"))
