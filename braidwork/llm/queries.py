"""Driver queries of the subpackage: opN_<name> over whole tables, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, flac, linededup, lm, pii, runs, search, simhash, spm, substring, toxicity, warc
from ._text import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(_table(spark, sf_dir, "documents"))


def op8_pii_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.digests(_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(_table(spark, sf_dir, "documents"))


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(_table(spark, sf_dir, "pages")))


def op4_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.stored_features(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(_table(spark, sf_dir, "documents"))


def op6_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op11_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations and one that says control strings, formatted into the shared folder and read back from there."""
    said = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))]))
    extra = spark.range(1).select(F.lit(-1).cast("bigint").alias("conv_id"), said.alias("x")).select("conv_id", "x.turn", "x.role", F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    path = f"{shared_dir(spark)}/chat-{uuid.uuid4().hex}"
    chat.conversations(chat.chains(rows), best=1).write.parquet(path)
    return chat.digests(spark.read.parquet(path))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(_table(spark, sf_dir, "documents"), tails=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_pivots, op2_substring_dedup, op3_warc_index, op4_flac_media, op5_line_dedup, op6_toxicity_fm, op7_attention_lm, op8_pii_weak, op9_sentencepiece, op10_decontaminate, op11_chat_trees, op12_ranked_search, op13_periodic_runs)}


_SPLIT = r"regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')"

_SUBSTRING = f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM d WHERE len(w) >= 20),
named AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS x FROM win),
late AS (SELECT doc_id, s FROM named QUALIFY ROW_NUMBER() OVER (PARTITION BY x ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM late),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, COUNT(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - COALESCE(n, 0))::BIGINT AS n_removed, sha256(COALESCE(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

_WARC = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS t, strlen(COALESCE(html, '')) AS n FROM pages),
k AS (SELECT *, CASE WHEN n >= 1000 THEN MAX(page_id) OVER (PARTITION BY t) ELSE page_id END AS keep FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(t) AS payload_digest, CASE WHEN keep = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN keep <> page_id THEN keep END AS refers_to FROM k"""

_TOKENS = r"regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_LEAKS = f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
b AS (SELECT item_id, {_TOKENS} AS w FROM benchmark),
i AS (SELECT item_id, LEAST(len(w), 10) AS l, unnest(range(1, len(w) - LEAST(len(w), 10) + 2)) AS s, w FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, l, array_to_string(w[s:s + l - 1], ' ') AS x FROM i),
dw AS (SELECT doc_id, l, s, array_to_string(w[s:s + l - 1], ' ') AS x FROM (SELECT doc_id, l, unnest(range(1, len(w) - l + 2)) AS s, w FROM d, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)),
h AS (SELECT doc_id, s, l, item_id FROM dw JOIN iw USING (l, x)),
n AS (SELECT doc_id, COUNT(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM h) GROUP BY doc_id),
c AS (SELECT doc_id, COUNT(*) AS m, string_agg(t, ',' ORDER BY t) AS t FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS t FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(n, 0)::BIGINT AS n_hit, COALESCE(m, 0)::BIGINT AS n_items, sha256(COALESCE(t, '')) AS items_sha256, COALESCE(n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""


_CONTROL = r"<\\*(?:/?s>|</?SYS>>)|\[\\*/?(?:INST|ROLE)\]"

_CHAT = f"""
WITH c AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, len(regexp_extract_all(text, '{_CONTROL}')) AS more, len(regexp_extract_all(role, '{_CONTROL}')) AS named FROM c)
SELECT conv_id, COUNT(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  COALESCE(SUM(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(COALESCE(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  (3 + SUM(length(text) + more + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE 20 + length(role) + named END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

_SEARCH = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT COUNT(*)::BIGINT AS docs, SUM(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
t AS (SELECT doc_id, n, term, COUNT(*)::BIGINT AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * COUNT(*) + 1)))::BIGINT AS wt FROM t, s GROUP BY term, docs),
r AS (SELECT item_id, doc_id, SUM(wt * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score FROM b JOIN f USING (term) JOIN t USING (term), s GROUP BY item_id, doc_id),
k AS (SELECT item_id, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM k WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    """Those that SQL can express; the others are held against brute force in tests."""
    return {"op2_substring_dedup": _SUBSTRING, "op3_warc_index": _WARC, "op10_decontaminate": _LEAKS, "op11_chat_trees": _CHAT, "op12_ranked_search": _SEARCH}
