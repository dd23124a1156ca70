"""Benchmark decontamination as a prefix-filtered set join, with built-in DataFrame functions only.

A benchmark window is ten consecutive words of an item (all of them, if it has fewer). Containing a window means
containing all of its words, so the necessary prefix at this threshold is one token: the word of the window that is
rarest in the documents. The join is on that word; the window's length and the word's offset in it then bound where the
window can lie, and the words at that place are compared exactly. One pass over the documents' words serves the join,
the check and the word counts: Generate, BroadcastHashJoin and Filter stay in one code-generated stage, so the word
array of a document is never copied for the words that match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import checkpoint

WINDOW = 10
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The window table is broadcast up to this many windows (about 0.2 KB each); beyond it both sides are shuffled.
BROADCAST_WINDOWS = 200_000
#: A word no text can hold; where windows are broadcast, it matches once in each document and carries its length.
_END = "\x00"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    """Lower-cased words of letters, digits and characters beyond ASCII; none for null."""
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), APART), ""), F.array().cast("array<string>"))


def windows(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """(__window, __w, __len, __items): every distinct window with the ids of its items, as sorted strings."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("__b") - size + 1, F.lit(1)))
    each = (
        benchmark.select(F.col(item_col).cast("string").alias("__item"), words(F.col(text_col)).alias("__b"))
        .where(F.size("__b") > 0)
        .select("__item", F.explode(F.transform(starts, lambda i: F.slice("__b", i, size))).alias("__w"))
    )
    return each.groupBy("__w").agg(F.array_sort(F.collect_set("__item")).alias("__items")).select(F.array_join("__w", " ").alias("__window"), "__w", F.size("__w").alias("__len"), "__items")


def _words_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__h"), words(F.col(text_col)).alias("__d"))


def _prefixes(d: DataFrame, w: DataFrame, bounded: bool) -> DataFrame:
    """w with __token, its word that is rarest in the documents (ties: the first in order), and that word's __offset."""
    vocabulary = w.select(F.explode("__w").alias("__token")).distinct()
    found = d.select(F.explode_outer("__d").alias("__token")).join(F.broadcast(vocabulary) if bounded else vocabulary, "__token")
    counts = found.groupBy("__token").agg(F.count("*").alias("__n"))
    ranked = w.select("__window", F.posexplode("__w").alias("__offset", "__token")).join(counts, "__token", "left")
    best = ranked.groupBy("__window").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__token", "__offset")).alias("__p"))
    return w.join(best, "__window").select("__window", "__len", "__items", F.col("__p.__token").alias("__token"), F.col("__p.__offset").alias("__offset"))


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, size: int, broadcast_windows: int) -> DataFrame:
    """(__id, __h, __n, __start, __len, __items): occurrences of windows; and per document a row with __len 0."""
    w = checkpoint(windows(benchmark, item_col, item_text_col, size))
    bounded = w.count() <= broadcast_windows
    d = _words_of(docs, id_col, text_col)
    p = _prefixes(d, w, bounded)
    at = F.col("__pos") - F.col("__offset")
    fits = (at >= 0) & (at + F.col("__len") <= F.col("__n"))
    same = F.array_join(F.slice("__d", at + 1, F.col("__len")), " ") == F.col("__window")
    out = ["__id", "__h", "__n", at.cast("int").alias("__start"), "__len", "__items"]
    size_of = F.size("__d").alias("__n")
    if bounded:
        end = F.struct(F.lit("").alias("w"), F.lit(0).alias("l"), F.array().cast("array<string>").alias("i"), F.lit(_END).alias("t"), F.lit(0).alias("o"))
        p = p.unionByName(docs.sparkSession.range(1).select(end.alias("e")).selectExpr("e.w AS __window", "e.l AS __len", "e.i AS __items", "e.t AS __token", "e.o AS __offset"))
        each = F.posexplode_outer(F.concat("__d", F.array(F.lit(_END)))).alias("__pos", "__token")
        return d.select("__id", "__h", "__d", size_of, each).join(F.broadcast(checkpoint(p)), "__token").where((F.col("__token") == _END) | (fits & same)).select(*out)
    # here ends stay out of the join: on its one key they would all meet in one task
    ends = d.select("__id", "__h", size_of, F.lit(0).alias("__start"), F.lit(0).alias("__len"), F.array().cast("array<string>").alias("__items"))
    near = d.select("__id", "__h", size_of, F.posexplode("__d").alias("__pos", "__token")).join(checkpoint(p), "__token").where(fits)
    texts = d.dropDuplicates(["__id", "__h"]).select(F.col("__id").alias("__i"), F.col("__h").alias("__g"), "__d")
    rest = near.join(texts, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__h") == F.col("__g"))).where(same)
    return ends.unionByName(rest.select(*out))


def _judged(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS
) -> DataFrame:
    """contamination() with __h, the hash of the text."""
    found = hits(docs, benchmark, id_col, text_col, item_col, item_text_col, size, broadcast_windows)
    covered = F.array_distinct(F.flatten(F.transform("__at", lambda x: F.sequence(x.s, x.s + x.l - 1))))
    items = F.array_sort(F.array_distinct(F.flatten("__all")))
    per = found.groupBy("__id", "__h").agg(
        F.max("__n").alias("__n"),
        F.sum((F.col("__len") == 0).cast("int")).alias("__rows"),
        F.collect_set(F.when(F.col("__len") > 0, F.struct(F.col("__start").alias("s"), F.col("__len").alias("l")))).alias("__at"),
        F.collect_set(F.when(F.col("__len") > 0, F.col("__items"))).alias("__all"),
    )
    out = per.select(F.col("__id").alias(id_col), "__h", F.col("__n").cast("long").alias("n_words"), F.size(covered).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "__rows")
    return out.select(id_col, "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), F.explode(F.sequence(F.lit(1), F.col("__rows").cast("int"))).alias("__copy"), "__h").drop("__copy")


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS
) -> DataFrame:
    """Per row of docs: id, n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256, contaminated.

    A null or empty text has no words; a null item id counts as no id but its windows still hit. Rows with equal id and
    text are judged alike, each giving a row. An empty benchmark hits nothing; an empty table gives no rows.
    """
    return _judged(docs, benchmark, id_col, text_col, item_col, item_text_col, size, broadcast_windows).drop("__h")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_hit: int = 1) -> DataFrame:
    """The rows of docs with fewer than min_hit words inside benchmark windows; all columns stay."""
    bad = _judged(docs, benchmark, id_col, text_col).where(F.col("n_hit") >= min_hit).select(F.col(id_col).alias("__id"), "__h").distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__h")), "left_anti")
