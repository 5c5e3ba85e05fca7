"""Registered queries of the operators in this folder, over whole tables with
production parameters, and the DuckDB text of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load
from .bpe_stream import token_digests
from .exact_dedup import exact_dedup
from .fingerprints import fingerprint_edits
from .hard_negatives import hard_negatives
from .language_id import identify
from .mixing import mix
from .near_dedup import near_dedup
from .packing import pack_documents
from .preferences import pairs_from_conversations, preference_turns
from .prefix_trie import prefix_trie
from .private_data import private_report
from .secrets import secret_report
from .token_output import token_matrix


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(load(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(load(spark, sf_dir, "documents"), percent=85)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(load(spark, sf_dir, "documents"))


def op5_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_turns(pairs_from_conversations(load(spark, sf_dir, "conversations")))


def op6_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_report(load(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(load(spark, sf_dir, "documents"))


def op8_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_matrix(load(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents"), keep="largest")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(load(spark, sf_dir, "conversations"))


def op12_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(load(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_language_id": op2_language_id,
    "op3_mix_sources": op3_mix_sources,
    "op4_near_dedup": op4_near_dedup,
    "op5_preference_chat": op5_preference_chat,
    "op6_private_data": op6_private_data,
    "op7_secret_scan": op7_secret_scan,
    "op8_token_matrix": op8_token_matrix,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_fingerprints": op10_fingerprints,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_bpe_stream": op12_bpe_stream,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES = {
    "op5_preference_chat": """
WITH c AS (
  SELECT conv_id AS pair, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS nth
  FROM conversations),
last AS (
  SELECT pair, max(turn) AS turn FROM c WHERE role = 'assistant' GROUP BY pair),
answer AS (
  SELECT c.pair, max(c.text) AS text FROM c JOIN last USING (pair, turn) WHERE role = 'assistant' GROUP BY c.pair),
following AS (
  SELECT pair, lead(pair) OVER (ORDER BY pair) AS next FROM (SELECT DISTINCT pair FROM c WHERE pair IS NOT NULL)),
t AS (
  SELECT c.pair, c.turn, c.role, c.text, c.nth,
         CASE WHEN c.turn = last.turn AND c.role = 'assistant' THEN coalesce(o.text, '') ELSE c.text END AS other
  FROM c JOIN last ON c.pair = last.pair AND c.turn <= last.turn LEFT JOIN following f ON f.pair = c.pair LEFT JOIN answer o ON o.pair = f.next),
first AS (
  SELECT pair, min(turn) AS first FROM t WHERE text <> other GROUP BY pair),
parts AS (
  SELECT t.pair, 'prompt' AS part, turn, nth, role, text FROM t LEFT JOIN first USING (pair)
  WHERE first IS NULL OR turn < first
  UNION ALL SELECT t.pair, 'chosen', turn, nth, role, text FROM t JOIN first USING (pair) WHERE turn >= first
  UNION ALL SELECT t.pair, 'rejected', turn, nth, role, other FROM t JOIN first USING (pair) WHERE turn >= first)
SELECT pair, part, turn, nth, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered,
       part <> 'prompt' AND role = 'assistant' AS train
FROM parts
""",
    "op9_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
    "op11_prefix_trie": """
WITH o AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, ''))
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT conv_id, t, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
    lambda c, d: list_reduce(list_concat([xor(c, d)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 4 AS h
  FROM o),
r AS (
  SELECT h.conv_id, list_concat(list_slice(coalesce(o.t, []), 1, h.h), list_slice(h.t, h.h + 1, len(h.t))) AS t
  FROM h LEFT JOIN o ON o.conv_id = h.base),
p AS (
  SELECT r.conv_id, u.depth, list_slice(t, 1, u.depth) AS key, u.depth = len(t) AS last FROM r, unnest(range(0, len(t) + 1)) AS u(depth)),
n AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '') AS ends
  FROM p GROUP BY key, depth),
c AS (
  SELECT list_slice(key, 1, depth - 1) AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE
         (n_convs - 1) * len(regexp_extract_all(n.key[n.depth].text, '[^\x20\x09-\x0D]+')) END AS saves
  FROM n LEFT JOIN c ON c.key = n.key),
s AS (
  SELECT list_slice(key, 1, u.d) AS key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saves) AS saved_tokens
  FROM m, unnest(range(0, m.depth + 1)) AS u(d) GROUP BY 1)
SELECT m.conv_id, m.depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s ON s.key = m.key LEFT JOIN n up ON m.depth > 0 AND up.key = list_slice(m.key, 1, m.depth - 1)
""",
    "op13_hard_negatives": """
WITH e AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.row, a.vec_id AS anchor_id, r.row AS other, r.vec_id, r.label = a.label AS same,
         CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
  FROM e a JOIN e r ON a.vec_id % 50 = 0 AND a.row <> r.row),
p AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST, other) AS nth
  FROM s WHERE same QUALIFY nth <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.row, p.nth ORDER BY s.score DESC, s.vec_id NULLS LAST, s.other) AS INTEGER) AS rank
  FROM p JOIN s ON s.row = p.row AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
""",
}
