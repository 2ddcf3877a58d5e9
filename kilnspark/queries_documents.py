"""Registered queries of the relational, text-quality, chunking and status operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import jsontext, quality, tables, text
from .operators import chunking, models, relational, table_functions
from .operators.embedding_cache import cached_embeddings
from .queries_retrieval import WORDS_SQL
from .registry import SQL, query, table
from .sources import files, json_documents, sinks
from .stored import shared_path
from .streaming import ingest, state

LATIN = "a-z"
SPLIT_SQL = r"list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')"
_TOKENS = rf"tok AS (SELECT doc_id, t FROM (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '[\s]+')) AS t FROM documents) WHERE t <> '')"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# --- filters, pages, projections -------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars >= 500 AND n_chars < 2000 AND source IN ('src1', 'src2', 'src3')")
def metadata_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"lang": "en", "n_chars__gte": 500, "n_chars__lt": 2000, "source__in": ["src1", "src2", "src3"], "unknown": 1}
    return relational.metadata_filter(docs(spark, sf_dir), wanted, allowed=("lang", "n_chars", "source")).select("doc_id")


@query("SELECT page_id FROM pages WHERE contains(lower(url), '/en/')")
def title_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.metadata_filter(table(spark, sf_dir, "pages"), {"url__icontains": "/EN/"}, allowed=("url",)).select("page_id")


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND user_id = 7")
def equality_and_in_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"event_type__in": ["click", "view"], "user_id": 7}
    return relational.metadata_filter(table(spark, sf_dir, "events"), wanted, allowed=("event_type", "user_id")).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1998-01-01 00:00:00'")
def expiry_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    expires = F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")
    return table(spark, sf_dir, "orders").where(relational.still_valid(expires, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))).select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE lang IS NULL OR lang = '' OR source = 'src3'")
def queryset_or_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where(F.col("lang").isNull() | (F.col("lang") == "") | (F.col("source") == "src3")).select("doc_id")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 25")
def pagination_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.page(docs(spark, sf_dir), [F.desc("n_chars"), F.asc("doc_id")], 2, 25).select("doc_id", "n_chars")


@query("""WITH s AS (SELECT count(*) AS n FROM documents)
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
WHERE i >= ((SELECT n FROM s) - 1) // 100 * 100""")
def pagination_past_the_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.page(docs(spark, sf_dir), [F.asc("doc_id")], 10**6, 1000).select("doc_id")


@query("SELECT doc_id FROM documents WHERE false")
def chunk_pagination_past_the_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.page(docs(spark, sf_dir), [F.asc("doc_id")], 10**6, 1000, clamp=False).select("doc_id")


@query("""SELECT doc_id, substring(coalesce(text, ''), 1, 200) AS preview, md5(lang || chr(31) || source) AS cache_key,
  concat_ws(' | ', lang, nullif(source, 'src0')) AS legal_context FROM documents""")
def result_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    metadata = F.create_map(F.lit("law_name"), F.col("lang"), F.lit("fasl"), F.nullif("source", F.lit("src0")))
    return docs(spark, sf_dir).select(
        "doc_id", relational.preview(F.coalesce("text", F.lit(""))).alias("preview"),
        relational.cache_key(F.col("lang"), F.col("source")).alias("cache_key"), relational.legal_context(metadata).alias("legal_context"),
    )


@query("SELECT doc_id, 'b' AS law_name, 'z' AS fasl, lang AS kitab FROM documents")
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.create_map(F.lit("law_name"), F.lit("a"), F.lit("kitab"), F.col("lang"))
    right = F.create_map(F.lit("law_name"), F.lit("b"), F.lit("fasl"), F.lit("z"))
    merged = relational.merged_metadata(left, right)
    return docs(spark, sf_dir).select("doc_id", *(F.element_at(merged, k).alias(k) for k in ("law_name", "fasl", "kitab")))


@query("""WITH s AS (SELECT o_orderkey, CAST(year(o_orderdate) - 600 AS VARCHAR) || '/' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '/' || lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0') AS s FROM orders)
SELECT o_orderkey, strftime(try_strptime(s, '%Y/%m/%d'), '%Y-%m-%d') AS d FROM s""")
def approval_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat_ws("-", (F.year("o_orderdate") - 600).cast("string"), F.lpad(F.month("o_orderdate").cast("string"), 2, "0"), F.lpad(F.dayofmonth("o_orderdate").cast("string"), 2, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", relational.approval_date(said).cast("string").alias("d"))


# --- joins -----------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def inner_join_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
    return table(spark, sf_dir, "orders").join(owners, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_nationkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def semi_join_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "P")
    return table(spark, sf_dir, "lineitem").join(scope, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber")


@query("""SELECT doc_id FROM documents WHERE source || lang NOT IN (
  SELECT d.source || d.lang FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1)""")
def anti_join_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).withColumn("title", F.concat("source", "lang"))
    existing = table(spark, sf_dir, "labels").where("toxic = 1")
    return relational.not_yet_imported(rows, existing, "title", "doc_id").select("doc_id")


@query("""SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations
  WHERE length(coalesce(text, '')) = 0 OR role = 'system')""")
def reject_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("role") == "system", F.lit(" ")).otherwise(F.col("text")))
    kept, _ = relational.reject_groups_with_empty(rows, "conv_id", "text")
    return kept.select("conv_id", "turn")


@query("""WITH c AS (SELECT doc_id AS chunk_id, doc_id % 50 AS document_id, n_chars % 40 + 1 AS page_start,
  n_chars % 40 + 1 + n_chars % 7 AS page_end FROM documents),
t AS (SELECT page_id AS table_id, page_id % 50 AS document_id, page_id % 41 + 1 AS page FROM pages)
SELECT chunk_id, table_id FROM c JOIN t ON c.document_id = t.document_id AND page BETWEEN page_start AND page_end""")
def range_join_tables_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = docs(spark, sf_dir).select(
        F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 50).alias("document_id"), (F.col("n_chars") % 40 + 1).alias("page_start"),
        (F.col("n_chars") % 40 + 1 + F.col("n_chars") % 7).alias("page_end"),
    )
    t = table(spark, sf_dir, "pages").select(F.col("page_id").alias("table_id"), (F.col("page_id") % 50).alias("document_id"), (F.col("page_id") % 41 + 1).alias("page"))
    return relational.tables_of_chunks(c, t).select("chunk_id", "table_id")


@query("""WITH m AS (SELECT user_id, event_id AS pos, event_id % 97 AS page FROM events WHERE event_type = 'purchase'),
p AS (SELECT user_id, event_id AS pos FROM events WHERE event_type <> 'purchase')
SELECT p.user_id, p.pos, coalesce(m.page, 1) AS page FROM p ASOF LEFT JOIN m ON p.user_id = m.user_id AND p.pos >= m.pos""")
def asof_page_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), "event_type")
    markers = e.where(F.col("event_type") == "purchase").withColumn("page", F.col("pos") % 97)
    return relational.page_as_of(e.where(F.col("event_type") != "purchase").select("user_id", "pos"), markers, "user_id")


@query("SELECT doc_id, v.vec_id IS NOT NULL AS updated FROM documents LEFT JOIN (SELECT vec_id FROM embeddings WHERE label = 2) v ON v.vec_id = doc_id")
def vector_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id")).withColumn("embedding", F.lit(None).cast("array<float>"))
    new = table(spark, sf_dir, "embeddings").where("label = 2").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return sinks.with_vectors(held, new).select(F.col("chunk_id").alias("doc_id"), F.col("embedding").isNotNull().alias("updated"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("l_orderkey"))
    return sinks.without_documents(table(spark, sf_dir, "lineitem"), removed, "l_orderkey").select("l_orderkey", "l_linenumber")


# --- aggregates and windows ------------------------------------------------------------


@query("""SELECT lang AS hub_type, count(*) AS total, count(*) FILTER (WHERE toxic IS NULL) AS unlabelled,
  count(*) FILTER (WHERE toxic = 1) AS toxic, count(DISTINCT source) AS sources FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def hub_counts_filter_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return docs(spark, sf_dir).join(labels, "doc_id", "left").groupBy(F.col("lang").alias("hub_type")).agg(
        F.count("*").alias("total"), F.count_if(F.col("toxic").isNull()).alias("unlabelled"), F.count_if(F.col("toxic") == 1).alias("toxic"),
        F.count_distinct("source").alias("sources"),
    )


@query("SELECT conv_id, md5(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def group_concat_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return relational.ordered_text(rows, ["conv_id"], ["turn"], "text").select("conv_id", F.md5("content").alias("digest"))


@query("SELECT c_custkey, count(DISTINCT o_orderkey) AS messages FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def conversation_message_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return table(spark, sf_dir, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count_distinct("o_orderkey").alias("messages"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6")
def history_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.last_per_group(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn")], 6).select("conv_id", "turn")


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n
  FROM events WHERE event_type = 'signup') WHERE n = 1""")
def latest_pending_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = table(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    return relational.last_per_group(pending, ["user_id"], [F.desc("ts"), F.desc("event_id")], 1).select("user_id", "event_id")


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) WHERE n <= 3")
def sample_per_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.last_per_group(docs(spark, sf_dir), ["lang"], [F.asc("doc_id")], 3).select("lang", "doc_id")


@query("SELECT o_custkey, o_orderkey AS pos, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 10000000) AS stop FROM orders")
def section_spans_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("pos"), F.lit(10_000_000).cast("long").alias("length"))
    return chunking.section_spans(anchors, "o_custkey").select("o_custkey", "pos", F.col("end").alias("stop"))


@query("""WITH g AS (SELECT o_custkey, year(o_orderdate) AS y, lead(year(o_orderdate)) OVER (PARTITION BY o_custkey
  ORDER BY o_orderkey) - year(o_orderdate) AS step FROM orders)
SELECT o_custkey, count(*) FILTER (WHERE step > 2) AS gaps, count(*) FILTER (WHERE step < 0) AS descents FROM g GROUP BY o_custkey""")
def article_gap_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("o_orderkey", F.year("o_orderdate").cast("long").alias("y"))))
    jumps = quality.number_jumps(F.transform(listed, lambda s: s["y"]))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(jumps.alias("jumps"))
    return rows.select("o_custkey", F.size(F.filter("jumps", lambda j: j > 2)).cast("long").alias("gaps"), F.size(F.filter("jumps", lambda j: j < 0)).cast("long").alias("descents"))


@query("""SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'failed' WHEN bool_or(event_type = 'signup') THEN 'cancelled'
  WHEN bool_or(event_type IN ('click', 'view')) THEN 'processing' ELSE 'completed' END AS status,
  CAST(floor(sum(CASE WHEN event_type IN ('error', 'signup', 'view') THEN 0 ELSE CAST(floor(value) AS BIGINT) % 101 END) / count(*)) AS BIGINT) AS progress FROM events GROUP BY user_id""")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for x in ("error", "failed", "signup", "cancelled", "click", "running", "view", "pending", "purchase", "completed")))
    tasks = table(spark, sf_dir, "events").select("user_id", F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("completed")).alias("status"), (F.floor("value") % 101).alias("progress"))
    return tasks.groupBy("user_id").agg(relational.display_status(F.col("status")).alias("status"), relational.overall_progress(F.col("status"), F.col("progress")).alias("progress"))


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'view') AND user_id % 3 = 0 THEN 'failed' WHEN event_type IN ('click', 'view')
  AND user_id % 3 = 1 THEN 'cancelled' ELSE event_type END AS status FROM events""")
def task_healing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "pending").otherwise(F.col("event_type"))
    state = F.when(F.col("user_id") % 3 == 0, "FAILURE").when(F.col("user_id") % 3 == 1, "REVOKED").otherwise("STARTED")
    healed = relational.healed_status(status, F.col("event_id"), state)
    back = F.when(healed == "running", "click").when(healed == "pending", "view").otherwise(healed)
    return e.select("event_id", back.alias("status"))


@query("SELECT event_id FROM events WHERE event_type = 'error' AND user_id % 5 < 3")
def task_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "failed").alias("status"), (F.col("user_id") % 5).alias("retry_count"))
    return relational.retryable(tasks).select("event_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('O', 'P'))")
def duplicate_run_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "pending").otherwise("failed").alias("status"))
    return relational.not_running(table(spark, sf_dir, "customer").select("c_custkey"), tasks, "c_custkey")


@query("SELECT event_id, CAST(CASE WHEN user_id % 10 = 0 THEN 100 ELSE floor(100 * (event_id % 7) / (user_id % 10)) END AS INTEGER) AS progress FROM events")
def task_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", relational.task_progress(F.col("event_id") % 7, F.col("user_id") % 10).alias("progress"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def upsert_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return relational.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], "event_id")


@query("""SELECT conv_id, CAST(coalesce(sum(length(coalesce(text, ''))) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS completion,
  CAST(coalesce(sum(length(coalesce(text, ''))) FILTER (WHERE role <> 'assistant'), 0) AS BIGINT) AS prompt FROM conversations GROUP BY conv_id""")
def token_usage_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).alias("completion"), F.sum(F.when(F.col("role") != "assistant", n).otherwise(0)).alias("prompt")
    )


@query("SELECT count(*) AS total, count(*) FILTER (WHERE n_chars < 200) AS short, count(*) FILTER (WHERE text IS NULL OR text = '') AS empty FROM documents")
def import_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("n_chars") < 200).alias("short"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("empty"))


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source
  ORDER BY coalesce(toxic, doc_id % 3, 0), doc_id) AS n FROM documents LEFT JOIN labels USING (doc_id)) WHERE n <= 5""")
def nullable_sort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return relational.last_per_group(rows, ["source"], [F.coalesce("toxic", F.col("doc_id") % 3, F.lit(0)), F.asc("doc_id")], 5).select("source", "doc_id")


@query("""SELECT lang AS v FROM documents UNION SELECT role FROM conversations""")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(F.col("lang").alias("v")).union(table(spark, sf_dir, "conversations").select("role")).distinct()


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


# --- text quality ----------------------------------------------------------------------

_STOPS = ("the", "of", "and", "de", "la", "der")
_IN = "(" + ", ".join(f"'{w}'" for w in _STOPS) + ")"
_PAIRS = ("th", "he", "er", "on", "an", "re", "in", "en", "de", "la")
_PAIRS_IN = "(" + ", ".join(f"'{w}'" for w in _PAIRS) + ")"
_LETTERS = "regexp_replace(coalesce(text, ''), '[^a-z]', '', 'g')"


@query(f"""WITH {_TOKENS}
SELECT d.doc_id, round(coalesce(count(t) FILTER (WHERE t IN {_IN})::DOUBLE / nullif(count(t), 0), 0), 6) AS ratio FROM documents d LEFT
  JOIN tok USING (doc_id) GROUP BY d.doc_id""")
def stopword_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.round(quality.stopword_ratio(F.col("text"), _STOPS), 6).alias("ratio"))


@query(rf"""WITH {_TOKENS}, l AS (SELECT doc_id, trim(t, '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~،؛؟«»') AS b FROM tok WHERE regexp_matches(t, '[a-z]'))
SELECT d.doc_id, round(coalesce(count(b) FILTER (WHERE b IN {_IN})::DOUBLE / nullif(count(b), 0), 0), 6) AS validity FROM documents d LEFT
  JOIN l USING (doc_id) GROUP BY d.doc_id""")
def lexicon_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.round(quality.lexicon_validity(F.col("text"), _STOPS, LATIN), 6).alias("validity"))


@query(f"""WITH s AS (SELECT doc_id, {_LETTERS} AS s FROM documents), p AS (SELECT doc_id, substring(s, i, 2) AS p
  FROM (SELECT doc_id, s, unnest(generate_series(1, length(s) - 1)) AS i FROM s))
SELECT d.doc_id, round(coalesce(count(p) FILTER (WHERE p IN {_PAIRS_IN})::DOUBLE / nullif(count(p), 0), 1), 6) AS plausibility
  FROM documents d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id""")
def bigram_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.round(quality.pair_plausibility(F.col("text"), _PAIRS, LATIN), 6).alias("plausibility"))


@query("""WITH s AS (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^a-z]', '', 'g')) AS n,
  length(regexp_replace(regexp_replace(coalesce(text, ''), '[a-z]{2,}', ' ', 'g'), '[^a-z]', '', 'g')) AS alone FROM documents)
SELECT doc_id, round(CASE WHEN n = 0 THEN 1 ELSE (n - alone)::DOUBLE / n END, 6) AS connected, round(CASE
  WHEN n = 0 THEN 0 ELSE 1 - (n - alone)::DOUBLE / n END, 6) AS isolated FROM s""")
def rtl_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.round(quality.connected_share(c, LATIN), 6).alias("connected"), F.round(quality.isolated_share(c, LATIN), 6).alias("isolated"))


@query(f"""WITH s AS (SELECT doc_id, {_LETTERS} AS s FROM documents), c AS (SELECT doc_id, ch, count(*) AS n
  FROM (SELECT doc_id, unnest(string_split(s, '')) AS ch FROM s) WHERE ch <> '' GROUP BY doc_id, ch),
e AS (SELECT doc_id, -sum(n::DOUBLE / t * log2(n::DOUBLE / t)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS t FROM c) GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(h, 0), 6) + 0.0 AS entropy FROM documents d LEFT JOIN e USING (doc_id)""")
def char_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", (F.round(quality.letter_entropy(F.col("text"), LATIN), 6) + F.lit(0.0)).alias("entropy"))


@query(rf"""WITH {_TOKENS}, l AS (SELECT doc_id, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n FROM tok WHERE regexp_matches(t, '[a-z]'))
SELECT d.doc_id, round(coalesce(count(n) FILTER (WHERE n = 1)::DOUBLE / nullif(count(n), 0), 0), 6) AS ratio,
  coalesce(count(n) FILTER (WHERE n = 1)::DOUBLE / nullif(count(n), 0), 0) > 0.01 AS shattered FROM documents d LEFT
  JOIN l USING (doc_id) GROUP BY d.doc_id""")
def shattered_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.round(quality.shattered_ratio(c, LATIN), 6).alias("ratio"), quality.is_shattered(c, LATIN, 0.01).alias("shattered"))


@query(r"""WITH l AS (SELECT doc_id, x FROM (SELECT doc_id, trim(unnest(string_split(coalesce(text, ''), chr(10)))) AS x FROM documents) WHERE x <> ''),
n AS (SELECT doc_id, sum(c) AS lines, count(*) FILTER (WHERE c >= 3) AS rep FROM (SELECT doc_id, x, count(*) AS c FROM l GROUP BY doc_id, x) GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN lines >= 4 THEN rep ELSE 0 END AS INTEGER) AS repeated FROM documents d LEFT JOIN n USING (doc_id)""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", quality.repeated_lines(F.col("text")).cast("int").alias("repeated"))


@query(r"""WITH c AS (SELECT doc_id, count(DISTINCT ch) AS u FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents)
  WHERE ch <> '' GROUP BY doc_id)
SELECT d.doc_id, round(CASE WHEN NOT regexp_matches(coalesce(text, ''), '\S') THEN 0 ELSE 0.4::DOUBLE * least(length(regexp_replace(text, '[^a-z]', '', 'g')) / 100.0::DOUBLE, 1)
  + 0.3::DOUBLE * least(length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) / 500.0::DOUBLE, 1) + 0.3::DOUBLE * least(coalesce(u, 0) / 50.0::DOUBLE, 1) END, 6) AS quality
FROM documents d LEFT JOIN c USING (doc_id)""")
def output_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.round(quality.output_quality(F.col("text"), LATIN), 6).alias("quality"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '\n$', ''), chr(10))) AS x FROM documents),
n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(x, '[.…]{3,}') OR regexp_matches(x, '[0-9]\s*$')) AS s FROM l GROUP BY doc_id)
SELECT doc_id, regexp_matches(substring(coalesce(text, ''), 1, 300), 'the|Der|La') AND s >= 1 AND s / n::DOUBLE >= 0.05 AS toc FROM documents
  JOIN n USING (doc_id)""")
def toc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = quality.is_table_of_contents(F.col("text"), titles=("the", "Der", "La"), min_lines=1, min_ratio=0.05)
    return docs(spark, sf_dir).select("doc_id", flag.alias("toc"))


def _unrounded(name: str) -> str:
    """The SQL of a signal, its value as it is."""
    return re.sub(r"round\((.*?), 6\)( \+ 0\.0)? AS", r"\1 AS", SQL[name], flags=re.S)


_SIGNALS = {
    "ratio": ("stopword_ratio", "0.30 * ratio"),
    "validity": ("lexicon_validity", "0.25 * validity"),
    "plausibility": ("bigram_plausibility", "0.15 * plausibility"),
    "connected": ("rtl_consistency", "0.20 * connected"),
    "entropy": ("char_entropy", "0.10 * (1 - least(entropy / 5, 1))"),
}


@query(f"""WITH b AS (SELECT doc_id, regexp_matches(coalesce(text, ''), '\\S') AS filled FROM documents),
s AS (SELECT doc_id, filled, CASE WHEN filled THEN {' + '.join(w for _, w in _SIGNALS.values())} ELSE 0 END::DOUBLE AS score
  FROM b {' '.join(f"JOIN ({_unrounded(name)}) USING (doc_id)" for name, _ in _SIGNALS.values())})
SELECT doc_id, round(score, 6) AS score, filled AND score < 0.3 AS garbled FROM s""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted sum of five signals, and whether it is so low that the text counts as garbled."""
    c, how = F.col("text"), {"letters": LATIN, "stop_words": _STOPS}
    score = quality.quality_score(c, _STOPS, _PAIRS, **how)
    return docs(spark, sf_dir).select("doc_id", F.round(score, 6).alias("score"), quality.is_garbled(c, _STOPS, _PAIRS, **how).alias("garbled"))


@query(r"""WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS word FROM benchmark)),
s AS (SELECT regexp_replace(word, '[^\p{L}]', '', 'g') AS s FROM w)
SELECT pair, count(*) AS n FROM (SELECT substring(s, i, 2) AS pair FROM (SELECT s, unnest(generate_series(1, length(s) - 1)) AS i FROM s)) GROUP BY pair""")
def letter_pair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "benchmark").select(F.explode(text.words(F.col("text"))).alias("word")).distinct()
    return quality.pairs_of(found)


# --- chunks ----------------------------------------------------------------------------


#: Anchors, hints, words of a verdict and references in the languages of the given texts.
KINDS = ((r"The\s+th[a-z]*", "verdict"), (r"In\s+th[a-z]*", "article"), (r"Der\s+[a-z]+", "chapter"), (r"(?:La|Les)\s+[a-z]+", "section"))
HINTS = (r"and\s+the", r"und\s+die", r"of\s+th")
VERDICTS, REFERENCES = (r"(?:thing|zeit)[a-z]*",), "the?re[a-z]*"

_TOKEN_SQL = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x{85}\p{Z}]"
_BLANK_SQL = r"[\s\x0b\x{85}\p{Z}]"
_C, _H = "chr(64976)", "chr(64977)"


def paged(text: Column) -> Column:
    """The text with a page marker before every thousand characters."""
    page = lambda i: F.concat(F.lit("[PAGE "), (i + 1).cast("string"), F.lit("]\n"), F.substr(text, i * 1000 + 1, F.lit(1000)))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / 1000).cast("int")), page), "")


def _split_sql(marked: str) -> str:
    return f"string_split({marked}, {_C})"


#: Documents with page marks, and what is left without them: doc_id, text, pages, where they begin.
_PAGED_SQL = rf"""raw AS (SELECT doc_id, array_to_string(list_transform(range(0, length(text) // 1000 + 1),
    lambda i: '[PAGE ' || (i + 1) || ']' || chr(10) || substr(text, CAST(i * 1000 + 1 AS BIGINT), 1000)), '') AS t FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, t, string_split_regex(t, '\[PAGE{_BLANK_SQL}*\d+\]{_BLANK_SQL}*\n?') AS parts,
    list_transform(regexp_extract_all(t, '\[PAGE{_BLANK_SQL}*(\d+)\]', 1), lambda x: CAST(x AS INTEGER)) AS pages FROM raw),
d AS (SELECT doc_id, array_to_string(parts, '') AS text, pages,
    list_transform(range(1, len(pages) + 1), lambda i: CAST(list_sum(list_transform(parts[:i], lambda p: length(p))) AS INTEGER)) AS starts FROM cut
  WHERE regexp_matches(array_to_string(parts, ''), '[^\s\x0b\x{{85}}\p{{Z}}]'))"""

_PAGES_SQL = """array_to_string(list_sort(list_distinct([coalesce(pages[len(list_filter(starts, lambda p: p <= start))], 1)]
    || pages[len(list_filter(starts, lambda p: p <= start)) + 1:len(list_filter(starts, lambda p: p < stop))])), ',')"""


def _guarded(text: str, back: bool = False) -> str:
    """Marks beside digits become other characters, or those become marks again."""
    for n, mark in enumerate(".؟!"):
        other = f"chr({64980 + n})"
        if back:
            text = f"replace({text}, {other}, '{mark}')"
        else:
            text = rf"regexp_replace(regexp_replace({text}, '(\p{{Nd}})[{mark}]', '\1' || {other}, 'g'), '[{mark}](\p{{Nd}})', {other} || '\1', 'g')"
    return text


def _kind_sql(title: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({title}, '{p}') THEN '{k}'" for p, k in KINDS) + " ELSE 'text' END"


def _n_tokens(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{_TOKEN_SQL}'))"


#: Section by section, then piece by piece, as recursions over their numbers.
_STRUCTURAL_SQL = rf"""WITH RECURSIVE {_PAGED_SQL},
split AS (SELECT doc_id, unnest(x) AS part, generate_subscripts(x, 1) AS i FROM (SELECT doc_id,
    {_split_sql(f"regexp_replace(text, '({'|'.join(p for p, _ in KINDS)})', {_C} || '{chr(92)}1' || {_H}, 'g')")} AS x FROM d)),
titled AS (SELECT doc_id, i, CASE WHEN contains(part, {_H}) THEN split_part(part, {_H}, 1) ELSE '' END AS title, replace(part, {_H}, '') AS body,
    count(*) OVER (PARTITION BY doc_id) AS parts FROM split),
lead_in AS (SELECT doc_id, body FROM titled WHERE i = 1 AND parts > 1 AND NOT regexp_matches(body, '[^\s\x0b\x{{85}}\p{{Z}}]')),
sec0 AS (SELECT t.doc_id, row_number() OVER (PARTITION BY t.doc_id ORDER BY i) AS i, title, CASE WHEN i = 2 THEN coalesce(l.body, '') ELSE '' END || t.body AS body
  FROM titled t LEFT JOIN lead_in l ON l.doc_id = t.doc_id WHERE NOT (i = 1 AND l.doc_id IS NOT NULL)),
merged AS (
  SELECT doc_id, i, 0 AS sec, title, body, 0::BIGINT AS base FROM sec0 WHERE i = 1
  UNION ALL
  SELECT doc_id, i, CASE WHEN more THEN sec ELSE sec + 1 END, CASE WHEN more THEN old_title ELSE title END, CASE WHEN more THEN old || body ELSE body END,
    CASE WHEN more THEN base ELSE base + length(old) END
  FROM (SELECT s.doc_id, s.i, m.sec, m.title AS old_title, m.body AS old, s.title, s.body, m.base,
      {_n_tokens('m.body')} < 150 AND {_n_tokens('m.body || s.body')} <= 400 AS more
    FROM merged m JOIN sec0 s ON s.doc_id = m.doc_id AND s.i = m.i + 1)),
secs AS (SELECT doc_id, sec, max(title) AS title, arg_max(body, i) AS body, max(base) AS base FROM merged GROUP BY doc_id, sec),
p0 AS (SELECT doc_id, sec, unnest(x) AS part, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, sec,
    list_filter({_split_sql(f"regexp_replace({_guarded(f'regexp_replace(body, {chr(39)}({chr(124).join(HINTS)}){chr(39)}, {_C} || {_H} || {chr(39)}{chr(92)}1{chr(39)}, {chr(39)}g{chr(39)})')}, '([.؟!]|:{_BLANK_SQL}|{chr(92)}n{{2,}})', '{chr(92)}1' || {_C}, 'g')")},
      lambda x: x <> '') AS x FROM secs)),
p1 AS (SELECT doc_id, sec, i, starts_with(part, {_H}) AS hinted, {_guarded(f"replace(part, {_H}, '')", True)} AS t FROM p0),
p2 AS (SELECT doc_id, sec, i, hinted, t, regexp_extract_all(t, '^{_BLANK_SQL}*(?:{_TOKEN_SQL}){_BLANK_SQL}*|(?:{_TOKEN_SQL}){_BLANK_SQL}*') AS w, {_n_tokens('t')} AS n FROM p1),
p3 AS (SELECT doc_id, sec, i, g, hinted AND g = 0 AS hinted, CASE WHEN n > 400 THEN array_to_string(w[g * 400 + 1:g * 400 + 400], '') ELSE t END AS t
  FROM p2, range(0, CASE WHEN n > 400 THEN (len(w) + 399) // 400 ELSE 1 END) r(g)),
p AS (SELECT doc_id, sec, row_number() OVER (PARTITION BY doc_id, sec ORDER BY i, g) AS k, hinted, t, {_n_tokens('t')} AS n,
    coalesce(sum(length(t)) OVER (PARTITION BY doc_id, sec ORDER BY i, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM p3),
run AS (
  SELECT doc_id, sec, k, 1::BIGINT AS first, n AS size, n AS last_n, 0::BIGINT AS closed FROM p WHERE k = 1
  UNION ALL
  SELECT doc_id, sec, k, CASE WHEN NOT fits THEN k - along ELSE first END, CASE WHEN NOT fits THEN n + along * last_n ELSE size + n END, n, CASE WHEN NOT fits THEN first ELSE 0 END
  FROM (SELECT p.doc_id, p.sec, p.k, r.first, r.size, r.last_n, p.n, r.size + p.n <= 400 AND NOT (p.hinted AND r.size >= 150) AS fits,
      CASE WHEN p.k - r.first > 1 AND r.last_n + p.n <= 400 THEN 1 ELSE 0 END AS along
    FROM run r JOIN p ON p.doc_id = r.doc_id AND p.sec = r.sec AND p.k = r.k + 1)),
ends AS (SELECT doc_id, sec, closed AS first, k - 1 AS last FROM run WHERE closed > 0
  UNION ALL SELECT doc_id, sec, arg_max(first, k), max(k) FROM run GROUP BY doc_id, sec),
c AS (SELECT e.doc_id, e.sec, e.first, string_agg(p.t, '' ORDER BY p.k) AS content, min(p.off) AS off FROM ends e
  JOIN p ON p.doc_id = e.doc_id AND p.sec = e.sec AND p.k BETWEEN e.first AND e.last GROUP BY e.doc_id, e.sec, e.first),
placed AS (SELECT c.doc_id, c.sec, content, title, base + off AS start, base + off + length(content) AS stop, d.pages, d.starts
  FROM c JOIN secs USING (doc_id, sec) JOIN d ON d.doc_id = c.doc_id WHERE regexp_matches(content, '[^\s\x0b\x{{85}}\p{{Z}}]')),
found AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec, start, stop) - 1 AS INTEGER) AS chunk_index, content,
  CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, {_PAGES_SQL} AS pages,
  CAST({_n_tokens('content')} AS INTEGER) AS token_count, title AS section_title, {_kind_sql('title')} AS section_type FROM placed)"""


def structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents; those of over 20,000 characters are packed as rows."""
    rows = docs(spark, sf_dir).select("doc_id", paged(F.col("text")).alias("text"))
    return chunking.structural_chunks(rows, kinds=KINDS, hints=HINTS, verdict=VERDICTS, reference=REFERENCES, long=20_000, id_col="doc_id").withColumnsRenamed({"document_id": "doc_id", "end": "stop"})


@query(_STRUCTURAL_SQL + " SELECT doc_id, chunk_index, md5(content) AS digest, start, stop, pages, token_count, section_title, section_type FROM found")
def chunk_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages")
    return structural(spark, sf_dir).select("doc_id", "chunk_index", F.md5("content").alias("digest"), "start", "stop", pages, "token_count", "section_title", "section_type")


@query(_STRUCTURAL_SQL + rf""" SELECT doc_id, chunk_index, section_type, nullif(section_title, '') AS anchor_text,
  CAST(len(list_filter(string_split_regex({_guarded('content')}, '[.؟!]|:{_BLANK_SQL}|\n{{2,}}'), lambda x: regexp_matches(x, '[^\s\x0b\x{{85}}\p{{Z}}]'))) AS INTEGER) AS sentence_count,
  regexp_matches(content, '{VERDICTS[0]}') AS has_verdict, len(regexp_extract_all(content, '{REFERENCES}')) > 0 AS has_legislation_ref,
  CAST(len(list_distinct(regexp_extract_all(content, '{REFERENCES}'))) AS INTEGER) AS refs,
  CAST(string_split(pages, ',')[1] AS INTEGER) AS start_page, CAST(string_split(pages, ',')[-1] AS INTEGER) AS end_page FROM found""")
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every chunk carries along."""
    kept = ("section_type", "anchor_text", "sentence_count", "has_verdict", "has_legislation_ref")
    rows = structural(spark, sf_dir)
    return rows.select("doc_id", "chunk_index", *(f"metadata.{c}" for c in kept), F.size("metadata.legislation_refs").alias("refs"), "metadata.start_page", "metadata.end_page")


@query(rf"""WITH {_PAGED_SQL},
split AS (SELECT doc_id, unnest(x) AS part, generate_subscripts(x, 1) AS sec FROM (SELECT doc_id,
    {_split_sql(f"regexp_replace(text, '({'|'.join(p for p, _ in KINDS)})', {_C} || '{chr(92)}1' || {_H}, 'g')")} AS x FROM d)),
body AS (SELECT doc_id, sec, CASE WHEN sec = 1 THEN '{chunking.PREAMBLE}' ELSE split_part(part, {_H}, 1) END AS title,
    CASE WHEN sec = 1 THEN part ELSE split_part(part, {_H}, 2) END AS t,
    coalesce(sum(length(replace(part, {_H}, ''))) OVER (PARTITION BY doc_id ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      + CASE WHEN sec = 1 THEN 0 ELSE length(split_part(part, {_H}, 1)) END AS base FROM split),
words AS (SELECT doc_id, sec, title, base + length(regexp_extract(t, '^{_BLANK_SQL}*')) AS base, regexp_extract_all(t, '(?:{_TOKEN_SQL}){_BLANK_SQL}*') AS w FROM body),
win AS (SELECT doc_id, sec, title, base + length(array_to_string(w[:i], '')) AS start, regexp_replace(array_to_string(w[i + 1:i + 400], ''), '{_BLANK_SQL}+$', '') AS content
  FROM words, range(0, greatest(1, len(w) - 50), 350) r(i) WHERE len(w) > 0),
placed AS (SELECT *, start + length(content) AS stop FROM win JOIN d USING (doc_id))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec, start, stop) - 1 AS INTEGER) AS chunk_index, md5(content) AS digest, CAST(start AS INTEGER) AS start,
  {_PAGES_SQL} AS pages, CAST({_n_tokens('content')} AS INTEGER) AS token_count, title AS section_title FROM placed""")
def chunk_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", paged(F.col("text")).alias("text"))
    found = chunking.simple_chunks(rows, anchors=[p for p, _ in KINDS], id_col="doc_id").withColumnRenamed("document_id", "doc_id")
    pages = F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages")
    return found.select("doc_id", "chunk_index", F.md5("content").alias("digest"), "start", pages, "token_count", "section_title")


@query(f"""WITH t AS (SELECT doc_id, {WORDS_SQL.format(c='text')} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(generate_series(0, greatest(0, len(w) - 51), 350)) AS s FROM t WHERE len(w) > 0)
SELECT doc_id, s // 350 AS window, CAST(least(400, len(w) - s) AS BIGINT) AS tokens, w[s + 1] AS first FROM s""")
def chunk_token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = chunking.token_windows(text.words(F.col("text")), 400, 50)
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(windows).alias("window", "tokens"))
    return rows.select("doc_id", F.col("window").cast("long").alias("window"), F.size("tokens").cast("long").alias("tokens"), F.element_at("tokens", 1).alias("first"))


@query(f"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents),
l AS (SELECT doc_id, page, {WORDS_SQL.format(c='line')} AS w FROM p),
e AS (SELECT doc_id, page, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM l),
n AS (SELECT doc_id, page, t, row_number() OVER (PARTITION BY doc_id ORDER BY page, i) - 1 AS pos FROM e),
c AS (SELECT doc_id, count(*) AS n FROM n GROUP BY doc_id),
s AS (SELECT doc_id, unnest(generate_series(0, greatest(0, n - 21), 80)) AS s FROM c)
SELECT s.doc_id AS document_id, s // 80 AS window, count(*) AS n_tokens, min(page) AS first_page, max(page) AS last_page, md5(string_agg(t, ' ' ORDER BY pos)) AS digest
FROM s JOIN n ON n.doc_id = s.doc_id AND pos >= s AND pos < s + 100 GROUP BY ALL""")
def chunk_page_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 100 words over the lines of each document, by the table function in SQL."""
    table_functions.register(spark)
    lines = docs(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    pages = lines.select("document_id", (F.col("at") + 1).alias("page"), text.words(F.col("line")).alias("tokens"))
    return spark.sql(
        "SELECT document_id, window, n_tokens, first_page, last_page, md5(content) AS digest FROM page_windows(TABLE(SELECT * FROM {pages}), 100, 20)", pages=pages
    )


@query(r"""SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(coalesce(text, ''), 'th[a-z]+'))) AS INTEGER) AS n FROM documents""")
def article_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.size(chunking.article_references(F.coalesce("text", F.lit("")), "th[a-z]+")).cast("int").alias("n"))


_CELLS = "p_name AS a, p_type AS b, nullif(p_brand, 'Brand#17') AS c"


@query("""WITH r AS (SELECT p_partkey, p_name AS a, coalesce(nullif(p_type, 'ECONOMY'), '') AS b
  FROM part), w AS (SELECT *, greatest(length(a), 4) AS wa, greatest(length(b), 4) AS wb FROM r)
SELECT p_partkey, '| ' || rpad('name', CAST(wa AS INTEGER), ' ') || ' | ' || rpad('kind',
  CAST(wb AS INTEGER), ' ') || ' |' || chr(10) || '| ' || repeat('-', CAST(wa AS INTEGER)) || ' | ' || repeat('-', CAST(wb AS INTEGER)) || ' |'
  || chr(10) || '| ' || rpad(a, CAST(wa AS INTEGER), ' ') || ' | ' || rpad(b, CAST(wb AS INTEGER), ' ') || ' |' AS markdown FROM w""")
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(F.array(F.lit("name"), F.lit("kind")), F.array(F.col("p_name"), F.nullif("p_type", F.lit("ECONOMY"))))
    return table(spark, sf_dir, "part").select("p_partkey", tables.table_markdown(cells).alias("markdown"))


@query("SELECT p_partkey, concat_ws(' | ', 'name: ' || p_name, 'kind: ' || nullif(p_type, 'ECONOMY')) AS said FROM part")
def table_semantic_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(F.array(F.lit("name"), F.lit("kind")), F.array(F.col("p_name"), F.nullif("p_type", F.lit("ECONOMY"))))
    return table(spark, sf_dir, "part").select("p_partkey", tables.table_semantic_text(cells).alias("said"))


# --- JSON, hubs, HTML ------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def json_path_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where(F.col("k") >= 50)


@query("SELECT event_id, CAST(event_id % 3 + 1 AS INTEGER) AS tier, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def try_parse_json_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 3
    said = F.when(n == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(n == 1, F.concat(F.expr("left(props, length(props) - 1)"), F.lit(', "t": "a\tb"}'))).otherwise(
        F.concat(F.lit("Here it is: "), "props", F.lit(" I hope it helps."))
    )
    rows = table(spark, sf_dir, "events").withColumn("said", said)
    return rows.select("event_id", jsontext.parse_tier(F.col("said")).alias("tier"), jsontext.field(jsontext.parse_json(F.col("said")), "$.k", "long").alias("k"))


@query("SELECT event_id, least(1.0, CASE WHEN n > 1 THEN n / 100.0 ELSE n END)::DOUBLE AS p FROM (SELECT event_id, (event_id % 150)::DOUBLE AS n FROM events)")
def probability_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("about "), (F.col("event_id") % 150).cast("string"), F.lit(" per cent, not 7"))
    return table(spark, sf_dir, "events").select("event_id", jsontext.probability(said).alias("p"))


@query("""WITH s AS (SELECT doc_id, contains(lower(text), 'the')::INT + contains(lower(text), 'and')::INT AS a,
  contains(lower(text), 'der')::INT + contains(lower(text), 'zu')::INT AS b, contains(lower(text), 'que')::INT AS c FROM documents)
SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN NULL WHEN a = greatest(a, b, c) THEN 'x' WHEN b = greatest(a, b, c) THEN 'y' ELSE 'z' END AS hub FROM s""")
def hub_inference_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", json_documents.hub_by_words(F.col("text"), {"x": ("the", "and"), "y": ("der", "zu"), "z": ("que",)}).alias("hub"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'legislation' WHEN 'fr' THEN 'advisory_opinion' END AS hub FROM documents")
def hub_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = {"en": "legislation", "fr": "advisory_opinion"}
    return docs(spark, sf_dir).select("doc_id", json_documents.hub_alias(F.col("lang"), aliases).alias("hub"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(files.strip_tags(F.col("html"))).alias("digest"))


@query("SELECT doc_id, CASE WHEN lower(regexp_extract(source || '.PDF', '\\.([^./]+)$', 1)) <> 'pdf' THEN 'type' WHEN n_chars > 5000 THEN 'size' END AS error FROM documents".replace("\\\\", "\\"))
def upload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", files.upload_error(F.concat("source", F.lit(".PDF")), F.col("n_chars"), max_bytes=5000).alias("error"))


@query("""SELECT doc_id AS chunk_id, length(text)::BIGINT AS first, (length(text) - length(replace(text, 'e', '')))::BIGINT AS second
FROM documents WHERE regexp_matches(coalesce(text, ''), '\\S')""".replace("\\\\", "\\"))
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batched model calls with an injected (here: counting) embedder."""
    held = docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    made = models.embed_chunks(held, lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts]).where("embedding IS NOT NULL")
    return made.select("chunk_id", F.get("embedding", 0).cast("long").alias("first"), F.get("embedding", 1).cast("long").alias("second"))


# --- events ----------------------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.event_windows(table(spark, sf_dir, "events"))
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))


@query("""SELECT conv_id, count(*) AS messages, arg_max(text, turn) FILTER (WHERE role = 'user') AS last_user FROM conversations GROUP BY conv_id""")
def conversation_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.latest_state(table(spark, sf_dir, "conversations"))


@query("""WITH f AS (SELECT conv_id, coalesce(turn, -1)::BIGINT AS turn, role AS name, md5(coalesce(text, '')) AS value FROM conversations WHERE role IS NOT NULL
  UNION ALL SELECT conv_id, coalesce(turn, -1)::BIGINT, 'starts ' || substring(text, 1, 1), role FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL)
SELECT conv_id, name, turn, value FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, name ORDER BY turn DESC, value DESC) AS n FROM f) WHERE n = 1""")
def conversation_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each conversation knows at its end: facts of all turns, the latest telling of each."""
    return state.merged_facts(with_facts(table(spark, sf_dir, "conversations")))


def with_facts(messages: DataFrame) -> DataFrame:
    """Messages with two facts: the digest of a role's text, and who used a first letter."""
    told = F.array(
        F.struct(F.col("role").alias("k"), F.md5(F.coalesce("text", F.lit(""))).alias("v")),
        F.struct(F.concat(F.lit("starts "), F.substring("text", 1, 1)).alias("k"), F.col("role").alias("v")),
    )
    return messages.withColumn("facts", F.map_from_entries(F.filter(told, lambda s: s["k"].isNotNull() & s["v"].isNotNull())))


@query("""WITH l AS (SELECT user_id AS task_id, max(ts) AS seen FROM events GROUP BY user_id),
s AS (SELECT task_id, seen, max(event_type) AS status FROM l JOIN events ON user_id = task_id AND ts = seen GROUP BY ALL)
SELECT task_id, epoch_us(seen::TIMESTAMP) AS last_us, CASE WHEN status NOT IN ('purchase', 'error') AND seen::TIMESTAMP + INTERVAL 30 MINUTE < (SELECT max(ts) FROM events)::TIMESTAMP
  THEN 'failed' ELSE status END AS status FROM s""")
def stalled_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every task at the end of the events; those long silent have failed."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"))
    return state.stalled(e, "30 minutes", final=("purchase", "error"))


@query("""SELECT doc_id AS chunk_id, CASE WHEN regexp_matches(text, '[^\\s]') THEN length(text) END::BIGINT AS first,
  CASE WHEN NOT regexp_matches(text, '[^\\s]') OR text IS NULL THEN NULL WHEN text IN (SELECT text FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL) THEN 1 ELSE 2 END::BIGINT AS run FROM documents""")
def embedding_cache_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the chunks embedded in a first run, all in a second, which sends only texts not seen before."""
    chunks, path = docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), shared_path(spark)
    embedder = lambda said: [[float(len(t))] for t in said]
    cached_embeddings(chunks.where("chunk_id % 2 = 0"), embedder, path, now=1)
    made = cached_embeddings(chunks, embedder, path, now=2)
    return made.select("chunk_id", F.get("embedding", 0).cast("long").alias("first"), F.col("made_at").alias("run"))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE regexp_matches(coalesce(text, ''), '[^\\s]')) AS imported,
  count(*) FILTER (WHERE NOT regexp_matches(coalesce(text, ''), '[^\\s]')) AS skipped,
  count(*) FILTER (WHERE lang IS NULL AND regexp_matches(coalesce(text, ''), '[^\\s]')) AS without_hub FROM documents""")
def counted_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks written by hub, and the counters of that same pass."""
    chunks = docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("lang").alias("hub_type"))
    found = sinks.append_counted(chunks, shared_path(spark))
    return spark.createDataFrame([tuple(found[c] for c in ("total", "imported", "skipped", "without_hub"))], "total long, imported long, skipped long, without_hub long")
