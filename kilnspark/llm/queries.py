"""The registered queries ``opN_<name>`` and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dart_minhash, fill_middle, line_dedup, lm_scoring, packing, prefix_trie, repeats, secrets, simhash, token_counts, topk, toxicity
from .common import documents


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", "held_out", "score", "predicted", F.array_join(spans, ",").alias("spans"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digest(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k_every(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(documents(spark, sf_dir))


def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicate_classes(documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_documents(documents(spark, sf_dir))


def op11_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return repeats.without_repeats(documents(spark, sf_dir)).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = fill_middle.restored(F.col("output"), F.col("form"))
    return fill_middle.fill_in_middle(documents(spark, sf_dir)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_best_fit_packing,
        op2_token_counts,
        op3_toxicity,
        op4_lm_scoring,
        op5_line_dedup,
        op6_byte_bpe,
        op7_exact_topk,
        op8_secret_scans,
        op9_dart_minhash,
        op10_simhash,
        op11_repeated_bytes,
        op12_prefix_trie,
        op13_fill_in_middle,
    ]
    return {f.__name__: f for f in found}


OP5_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM docs),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
repeated AS (
  SELECT k, min(doc_id) AS keep FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT keyed.doc_id, pos, line, (keep IS NOT NULL AND keep <> keyed.doc_id) AS gone
  FROM keyed LEFT JOIN repeated ON keyed.k = repeated.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


OP7_SQL = """
WITH raw AS (
  SELECT r, vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i
  FROM (SELECT row_number() OVER () AS r, * FROM embeddings) WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
bad AS (SELECT DISTINCT r FROM raw WHERE x IS NULL OR NOT isfinite(x)),
cells AS (
  SELECT r, vec_id, i, CAST(floor(256 * x) AS BIGINT) AS x FROM raw
  WHERE r NOT IN (SELECT r FROM bad)),
scored AS (
  SELECT q.r AS qr, q.vec_id AS query_id, c.r AS cr, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM cells q JOIN cells c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY q.r, q.vec_id, c.r, c.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
-- pieces of 400 bytes every 200, since the place of a substring is counted from the start
blocks AS (SELECT r, 200 * b AS base, substr(x, CAST(400 * b + 1 AS BIGINT), 800) AS y
           FROM d, range(0, CAST(greatest(length(x) // 2, 0) AS BIGINT) // 200 + 1) t(b)),
w AS (SELECT r, base + i AS pos, md5(substr(y, CAST(2 * i + 1 AS BIGINT), 400)) AS k
      FROM blocks, range(0, 200) t(i) WHERE 2 * i + 400 <= length(y)),
often AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, pos FROM w SEMI JOIN often USING (k)),
-- runs of removed bytes: a window that starts at most 200 bytes after the last one goes on with its run
begun AS (SELECT r, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY r ORDER BY pos) <= 200 THEN 0 ELSE 1 END AS b FROM hit),
numbered AS (SELECT r, pos, sum(b) OVER (PARTITION BY r ORDER BY pos) AS run FROM begun),
spans AS (SELECT r, run, min(pos) AS a, max(pos) + 200 AS z FROM numbered GROUP BY r, run),
gaps AS (SELECT r, z AS a, lead(a) OVER (PARTITION BY r ORDER BY a) AS z FROM spans
         UNION ALL SELECT r, 0, min(a) FROM spans GROUP BY r),
kept AS (SELECT d.r, string_agg(substr(x, CAST(2 * a + 1 AS BIGINT), CAST(2 * (coalesce(z, length(x) // 2) - a) AS BIGINT)), '' ORDER BY a) AS x
         FROM gaps JOIN d ON d.r = gaps.r GROUP BY d.r),
total AS (SELECT r, count(*) AS n, CAST(sum(z - a) AS BIGINT) AS removed FROM spans GROUP BY r)
SELECT doc_id, CAST(length(d.x) // 2 AS BIGINT) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
FROM d LEFT JOIN total USING (r) LEFT JOIN kept USING (r)
"""


OP12_SQL = r"""
WITH tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
             FROM range(256) r(i)),
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
          FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 5 AS base,
               xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                                           lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1]))) % 9 AS h
        FROM (SELECT DISTINCT conv_id FROM turns), tab),
whole AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY src, pos) AS depth, role, text FROM (
    SELECT ids.conv_id, 0 AS src, t.pos, t.role, t.text FROM ids JOIN turns t ON t.conv_id = ids.base AND t.pos <= h
    UNION ALL
    SELECT ids.conv_id, 1 AS src, t.pos, t.role, t.text FROM ids JOIN turns t ON t.conv_id = ids.conv_id AND t.pos > h)),
paths AS (
  SELECT conv_id, depth, list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY depth) AS path, strlen(text) AS bytes,
         count(*) OVER (PARTITION BY conv_id) AS len FROM whole
  UNION ALL
  SELECT conv_id, 0, [], 0, (SELECT count(*) FROM whole w WHERE w.conv_id = ids.conv_id) FROM ids),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len = depth), '')) AS ends_sha256
  FROM paths GROUP BY path, depth),
kids AS (SELECT path[:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.path = nodes.path),
up AS (SELECT n.path[:k] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
       FROM full_nodes n, range(0, n.depth + 1) r(k) GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN up ON up.path = n.path LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[:n.depth - 1]
"""


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t,
             CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2,
             CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, text, t, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, len(t) AS n, form, array_to_string(t[1:a], '') AS prefix, array_to_string(t[a + 1:b], '') AS middle, array_to_string(t[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_line_dedup": OP5_SQL,
        "op7_exact_topk": OP7_SQL,
        "op11_repeated_bytes": OP11_SQL,
        "op12_prefix_trie": OP12_SQL,
        "op13_fill_in_middle": OP13_SQL,
    }
