"""Registered queries of the retrieval operators, over the supplied tables.

``documents`` stand in for chunks, ``lang`` for the hub and ``source`` for the document.
No key links ``embeddings`` to ``documents``; ``chunk_id = vec_id`` is a declared pairing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import DIGITS, PERSIAN_DIGITS, remove_stop_words, set_similarity, trigrams, words
from .operators import context, relational, retrieval, text_index
from .registry import query, table
from .stored import shared_path

STOPS = ("the", "of", "and", "de", "la")
_STOPS_SQL = "(" + ", ".join(f"'{w}'" for w in STOPS) + ")"

# words, trigrams and similarity in SQL
WORDS_SQL = r"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}_]+')"


def _grams(relation: str, key: str, text: str) -> str:
    """A subquery (key, g) of the trigram set of each row's text."""
    return f"""SELECT DISTINCT {key}, substring('  ' || w || ' ', CAST(i AS BIGINT), 3) AS g FROM (
      SELECT {key}, w, unnest(generate_series(1, length(w) + 1)) AS i FROM (
        SELECT {key}, unnest({WORDS_SQL.format(c=text)}) AS w FROM {relation}))"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.col("lang").alias("hub_type"), F.col("text").alias("content"), "n_chars"
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).join(vectors(spark, sf_dir).drop("label"), "chunk_id")


def first_vector(spark: SparkSession, sf_dir: str, n: int = 0) -> list[float]:
    """One stored vector as the question's vector (a single row)."""
    return vectors(spark, sf_dir).where(F.col("chunk_id") == n).first()["embedding"]


def rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) for c in columns})


_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_SCORED = "SELECT e.vec_id AS chunk_id, e.label, " + _COS.format(a="e.embedding", b="q.embedding") + " AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


@query(f"SELECT chunk_id, round(score, 6) AS score FROM ({_SCORED}) WHERE score >= 0 ORDER BY score DESC, chunk_id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.vector_search(vectors(spark, sf_dir), first_vector(spark, sf_dir), 10, width=64)
    return rounded(found.select("chunk_id", "score"), "score")


@query(f"SELECT chunk_id, round(score, 6) AS score FROM ({_SCORED}) WHERE label = 3 AND score >= 0 ORDER BY score DESC, chunk_id LIMIT 10")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = relational.metadata_filter(vectors(spark, sf_dir), {"label": 3, "other": 1}, allowed=("label",))
    return rounded(retrieval.vector_search(scoped, first_vector(spark, sf_dir), 10).select("chunk_id", "score"), "score")


@query(f"SELECT chunk_id, round(score, 6) AS score FROM ({_SCORED}) WHERE score >= 0.25 ORDER BY score DESC, chunk_id LIMIT 50")
def vector_minscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.vector_search(vectors(spark, sf_dir), first_vector(spark, sf_dir), 50, min_score=0.25)
    return rounded(found.select("chunk_id", "score"), "score")


@query("""WITH q AS (SELECT label, min(vec_id) AS query_id FROM embeddings GROUP BY label),
s AS (SELECT q.query_id, c.vec_id AS chunk_id, """ + _COS.format(a="c.embedding", b="e.embedding") + """ AS score
  FROM q JOIN embeddings e ON e.vec_id = q.query_id JOIN embeddings c ON c.label = q.label),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score >= 0)
SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 5""")
def vector_topk_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = vectors(spark, sf_dir)
    asked = held.groupBy("label").agg(F.min_by(F.struct("chunk_id", "embedding"), "chunk_id").alias("q"))
    asked = asked.select(F.col("q.chunk_id").alias("query_id"), F.col("q.embedding").alias("vector"), F.col("label").alias("asked"))
    found = retrieval.vector_search_many(held, asked, 5, F.col("label") == F.col("asked"))
    return rounded(found.select("query_id", "chunk_id", "rank", "score"), "score")


# --- keywords --------------------------------------------------------------------------


def benchmark_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each benchmark item as a query."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.array_distinct(words(F.col("text"))).alias("terms")
    )


_POSTINGS = f"""asked0 AS (SELECT item_id AS query_id, {WORDS_SQL.format(c='text')} AS l FROM benchmark),
asked AS (SELECT DISTINCT query_id, unnest(l) AS term FROM asked0),
sizes AS (SELECT query_id, count(*) AS n_terms FROM asked GROUP BY query_id),
post AS (SELECT chunk_id, term, count(*) AS tf FROM (
  SELECT doc_id AS chunk_id, unnest({WORDS_SQL.format(c='text')}) AS term FROM documents) GROUP BY chunk_id, term),
hits AS (SELECT a.query_id, p.chunk_id, count(*) AS found, sum(tf / (tf + 1.0::DOUBLE)) AS weight
  FROM asked a JOIN post p ON p.term = a.term GROUP BY a.query_id, p.chunk_id),
allof AS (SELECT h.query_id, chunk_id, round(weight / n_terms, 6) AS score FROM hits h JOIN sizes s USING (query_id) WHERE found = n_terms),
anyof AS (SELECT h.query_id, chunk_id, round(weight / n_terms, 6) AS score FROM hits h JOIN sizes s USING (query_id))"""


@query(f"""WITH {_POSTINGS},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM allof)
SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def keyword_and_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = benchmark_terms(spark, sf_dir)
    found = rounded(retrieval.keyword_matches(retrieval.postings(chunks(spark, sf_dir), asked=asked), asked), "score")
    return retrieval.top_per_query(found, 10).select("query_id", "chunk_id", "rank", "score")


@query(f"""WITH t AS (SELECT doc_id AS chunk_id, ' ' || array_to_string({WORDS_SQL.format(c='text')}, ' ') || ' ' AS s FROM documents)
SELECT chunk_id FROM t WHERE (contains(s, ' of the ') AND contains(s, ' and ') AND NOT contains(s, ' idiot ')) OR contains(s, ' der ')""")
def keyword_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = words(F.col("content"))
    return chunks(spark, sf_dir).where(retrieval.matches_websearch(tokens, '"of the" and -idiot or der')).select("chunk_id")


@query(f"""WITH {_POSTINGS},
staged AS (SELECT *, 0 AS stage FROM allof UNION ALL SELECT *, 1 AS stage FROM anyof),
first AS (SELECT *, min(stage) OVER (PARTITION BY query_id) AS f FROM staged),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM first WHERE stage = f)
SELECT query_id, chunk_id, CAST(stage AS INTEGER) AS stage, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 5""")
def keyword_stage_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = benchmark_terms(spark, sf_dir)
    index = retrieval.postings(chunks(spark, sf_dir), asked=asked)
    stages = [rounded(retrieval.keyword_matches(index, asked, any_term=some), "score") for some in (False, True)]
    stages = [retrieval.top_per_query(stage, 5).drop("rank") for stage in stages]  # so that no other rows are shuffled
    found = retrieval.top_per_query(retrieval.first_stage_that_finds(stages), 5)
    return found.select("query_id", "chunk_id", "stage", "rank", "score")


def word_index(rows: DataFrame) -> DataFrame:
    path = shared_path(rows.sparkSession)
    text_index.write_word_index(rows, path)
    return text_index.read_word_index(rows.sparkSession, path)


@query(f"""WITH {_POSTINGS},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM allof)
SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def index_and_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that hold all words of a question, from an index with positions."""
    index = word_index(chunks(spark, sf_dir))
    found = text_index.WordSearch(index, benchmark_terms(spark, sf_dir), 10).top()
    return found.select("query_id", "chunk_id", "rank", "score")


@query(f"""WITH {_POSTINGS},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM anyof)
SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 5""")
def index_any_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = word_index(chunks(spark, sf_dir))
    found = text_index.WordSearch(index, benchmark_terms(spark, sf_dir), 5, all_terms=False).top()
    return found.select("query_id", "chunk_id", "rank", "score")


_PHRASES = f"""q AS (SELECT DISTINCT l[i] AS a, l[i + 1] AS b, l[i + 2] AS c FROM (
  SELECT l, unnest(generate_series(1, len(l) - 2)) AS i FROM (SELECT {WORDS_SQL.format(c='text')} AS l FROM benchmark))),
d AS (SELECT doc_id, l, unnest(generate_series(1, len(l) - 2)) AS i FROM (SELECT doc_id, {WORDS_SQL.format(c='text')} AS l FROM documents)),
t AS (SELECT doc_id, l[i] AS a, l[i + 1] AS b, l[i + 2] AS c FROM d)"""


@query(f"""WITH {_PHRASES}
SELECT a || ' ' || b || ' ' || c AS query_id, doc_id AS chunk_id, count(*) AS n_times FROM q JOIN t USING (a, b, c) GROUP BY ALL""")
def index_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All phrases of three words of the benchmark, and how often each document holds them."""
    index = word_index(chunks(spark, sf_dir))
    three = F.transform(F.sequence(F.lit(1), F.size("l") - 2), lambda i: F.slice("l", i, 3))
    asked = table(spark, sf_dir, "benchmark").select(words(F.col("text")).alias("l")).where(F.size("l") > 2).select(F.explode(three).alias("terms")).distinct()
    return text_index.phrase_search(index, asked.withColumn("query_id", F.array_join("terms", " ")))


@query(f"""WITH {_POSTINGS.replace('FROM documents)', "FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN replace(text, 'the', 'der') ELSE text END AS text FROM documents))")},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM allof)
SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def index_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after the texts of one hub were changed and merged into the index."""
    held, path, new_path = chunks(spark, sf_dir), shared_path(spark), shared_path(spark)
    text_index.write_word_index(held, path)
    changed = held.where(F.col("hub_type") == "en").withColumn("content", F.replace("content", F.lit("the"), F.lit("der")))
    text_index.merge_word_index(spark, path, changed, new_path, batch="1")
    found = text_index.WordSearch(text_index.read_word_index(spark, new_path), benchmark_terms(spark, sf_dir), 10).top()
    return found.select("query_id", "chunk_id", "rank", "score")


def part_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as short chunks; sizes are written in Persian digits."""
    size = F.translate(F.col("p_size").cast("string"), DIGITS, PERSIAN_DIGITS)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.concat_ws(" ", "p_name", "p_type", size).alias("content"))


def _keyword_sql(where: str, terms: tuple[str, ...]) -> str:
    """Chunks of parts that match, ranked; the query's digits meet the chunks' as Latin ones."""
    tf = " + ".join(f"(len(list_filter(w, lambda x: x = '{t}')) / (len(list_filter(w, lambda x: x = '{t}')) + 1.0::DOUBLE))" for t in terms)
    return f"""WITH c AS (SELECT p_partkey AS chunk_id, regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_size), '[\\p{{L}}\\p{{N}}_]+') AS w FROM part)
SELECT chunk_id, round(({tf}) / {len(terms)}, 6) AS score FROM c WHERE {where} ORDER BY round(({tf}) / {len(terms)}, 6) DESC, chunk_id LIMIT 50"""


def _has(word: str) -> str:
    return f"list_contains(w, '{word}')"


@query(_keyword_sql(f"({_has('ring')} AND {_has('12')} AND NOT {_has('red')}) OR contains(' ' || array_to_string(w, ' ') || ' ', ' hot gear ')", ("ring", "12", "hot", "gear")))
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop words go, digits of either script meet, phrases, ``or`` and ``-word`` count."""
    found = retrieval.keyword_search(part_chunks(spark, sf_dir), 'the ring of 12 -red or "hot gear"', 50, stop_words=STOPS)
    return rounded(found.select("chunk_id", "score"), "score")


@query(_keyword_sql(f"{_has('red')} AND {_has('bolt')}", ("bolt", "red")))
def keyword_search_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No chunk has the phrase, so all of its words are asked for."""
    found = retrieval.keyword_search(part_chunks(spark, sf_dir), '"bolt red"', 50, stop_words=STOPS)
    return rounded(found.select("chunk_id", "score"), "score")


@query(f"""WITH c AS (SELECT p_partkey AS chunk_id, p_name || ' ' || p_type || ' ' || translate(p_size::VARCHAR, '0123456789', '۰۱۲۳۴۵۶۷۸۹') AS content FROM part),
a AS (SELECT g FROM ({_grams("(SELECT 0 AS k, 'widgit goldd' AS text)", 'k', 'text')})), g AS ({_grams('c', 'chunk_id', 'content')}),
n AS (SELECT chunk_id, count(*) AS n, count(*) FILTER (WHERE g IN (SELECT g FROM a)) AS b FROM g GROUP BY chunk_id),
s AS (SELECT chunk_id, round(b::DOUBLE / (n + (SELECT count(*) FROM a) - b), 6) AS score FROM n)
SELECT chunk_id, score FROM s WHERE score >= 0.1 ORDER BY score DESC, chunk_id LIMIT 50""")
def keyword_search_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No word is found, so trigrams from 0.1 on stand in."""
    found = retrieval.keyword_search(part_chunks(spark, sf_dir), "the widgit goldd", 50, stop_words=STOPS)
    return rounded(found.select("chunk_id", "score"), "score")


@query("SELECT 0 AS chunk_id, 0.0::DOUBLE AS score WHERE false")
def keyword_search_stop_words_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop words alone find nothing and fall back on nothing."""
    found = retrieval.keyword_search(part_chunks(spark, sf_dir), "the of", 50, stop_words=STOPS)
    return found.select("chunk_id", "score")


@query(f"""WITH w AS (SELECT doc_id, unnest({WORDS_SQL.format(c='text')}) AS t, generate_subscripts({WORDS_SQL.format(c='text')}, 1) AS i FROM documents),
k AS (SELECT doc_id, count(*) AS n, md5(string_agg(t, ' ' ORDER BY i)) AS digest FROM w WHERE t NOT IN {_STOPS_SQL} GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_kept, coalesce(digest, md5('')) AS digest FROM documents d LEFT JOIN k USING (doc_id)""")
def stopword_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_stop_words(words(F.col("text")), STOPS)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(kept).cast("long").alias("n_kept"), F.md5(F.array_join(kept, " ")).alias("digest")
    )


# --- trigrams --------------------------------------------------------------------------

_QUESTION = "the thation of thing and"


def _trigram_sql(where: str, limit: str) -> str:
    return f"""WITH asked AS (SELECT g FROM ({_grams(f"(SELECT 0 AS k, '{_QUESTION}' AS text)", 'k', 'text')})),
grams AS ({_grams('documents', 'doc_id', 'text')}),
n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE g IN (SELECT g FROM asked)) AS b FROM grams GROUP BY doc_id),
s AS (SELECT doc_id AS chunk_id, b::DOUBLE / (n + (SELECT count(*) FROM asked) - b) AS score FROM n)
SELECT chunk_id, round(score, 6) AS score FROM s {where} {limit}"""


_MINSIM_SQL = f"""WITH q AS (SELECT DISTINCT p_type AS text FROM part), p AS (SELECT DISTINCT p_brand || ' ' || p_name AS name, p_type AS t FROM part),
qg AS ({_grams('q', 'text', 'text')}), pn AS (SELECT DISTINCT name FROM p), pg AS ({_grams('(SELECT DISTINCT p_name AS name FROM part)', 'name', 'name')}),
qn AS (SELECT text, count(*) AS n FROM qg GROUP BY text), pc AS (SELECT name, count(*) AS n FROM pg GROUP BY name),
b AS (SELECT qg.text, pg.name, count(*) AS b FROM qg JOIN pg USING (g) GROUP BY qg.text, pg.name),
s AS (SELECT b.text AS query_id, b.name AS chunk_id, b::DOUBLE / (qn.n + pc.n - b) AS score FROM b JOIN qn USING (text) JOIN pc USING (name))
SELECT query_id, chunk_id, round(score, 6) AS score FROM s WHERE score >= @least"""


def named_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Names of parts as chunks, their types as queries."""
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_name").alias("chunk_id"), F.col("p_name").alias("content")).distinct()
    return names, part.select(F.col("p_type").alias("query_id"), F.col("p_type").alias("query")).distinct()


@query(_trigram_sql("WHERE score >= 0.02", "ORDER BY score DESC, chunk_id LIMIT 10"))
def trigram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.trigram_search(chunks(spark, sf_dir), _QUESTION, 10, min_similarity=0.02)
    return rounded(found.select("chunk_id", "score"), "score")


@query(_MINSIM_SQL.replace("@least", "0.05"))
def trigram_minsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, asked = named_parts(spark, sf_dir)
    return rounded(retrieval.trigram_search_many(names, asked, 0.05), "score")


@query(_trigram_sql("WHERE score >= 0.02", "ORDER BY score DESC, chunk_id LIMIT 10"))
def gram_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`trigram_topk` from stored lists: only candidates' sets are compared."""
    path = shared_path(spark)
    text_index.write_gram_index(chunks(spark, sf_dir), path)
    asked = spark.range(1).select(F.col("id").alias("query_id"), F.lit(_QUESTION).alias("query"))
    found = retrieval.top_per_query(text_index.GramSearch(path, asked, 0.02).found(), 10)
    return rounded(found.select("chunk_id", "score"), "score")


@query(_MINSIM_SQL.replace("@least", "0.3"))
def gram_index_minsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, asked, path = *named_parts(spark, sf_dir), shared_path(spark)
    text_index.write_gram_index(names, path)
    return rounded(text_index.GramSearch(path, asked, 0.3, id_type="string").found(), "score")


# --- fusion ----------------------------------------------------------------------------


def _list_sql(vec: int, depth: int) -> str:
    return f"""SELECT vec_id AS chunk_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM (
      SELECT e.vec_id, {_COS.format(a='e.embedding', b='q.embedding')} AS score
      FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {vec}) q) WHERE score >= 0 ORDER BY score DESC, vec_id LIMIT {depth}"""


def _fusion_sql(lists: dict[str, tuple[str, float]], top_k: int) -> str:
    """Fusion of named SQL lists (chunk_id, score, r)."""
    parts = [f"SELECT chunk_id, score, r, {n} AS src, {w}::DOUBLE AS w FROM l_{name}" for n, (name, (_, w)) in enumerate(lists.items())]
    own = ", ".join(f"coalesce(max(score) FILTER (WHERE src = {n}), 0) AS {name}_score" for n, name in enumerate(lists))
    shown = ", ".join(f"round({name}_score, 6) AS {name}_score" for name in lists)
    ctes = ", ".join(f"l_{name} AS ({sql})" for name, (sql, _) in lists.items())
    return f"""WITH {ctes},
u AS ({' UNION ALL '.join(parts)}),
f AS (SELECT chunk_id, sum(w / (60 + r)) AS total, min(src * 1000000 + r) AS seen, {own} FROM u GROUP BY chunk_id),
p AS (SELECT *, row_number() OVER (ORDER BY total DESC, seen, chunk_id) AS rank FROM f)
SELECT chunk_id, CAST(rank AS INTEGER) AS rank, round(total, 6) AS relevance_score, {shown} FROM p WHERE rank <= {top_k}"""


def _vector_list(spark: SparkSession, sf_dir: str, n: int, depth: int) -> DataFrame:
    found = retrieval.vector_search(vectors(spark, sf_dir), first_vector(spark, sf_dir, n), depth)
    return found.select(F.lit(0).alias("query_id"), "chunk_id", "score")


@query(_fusion_sql({"a": (_list_sql(0, 40), 3), "b": (_list_sql(1, 40), 1)}, 10))
def rrf_two_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = [_vector_list(spark, sf_dir, n, retrieval.candidate_depth(10)) for n in (0, 1)]
    return rounded(retrieval.rank_fusion(lists, [3, 1], 10, ["a", "b"]).drop("query_id"), "a_score", "b_score")


@query(_fusion_sql({"a": (_list_sql(0, 80), 3), "b": (_list_sql(1, 80), 1), "c": (_list_sql(2, 80), 1)}, 20))
def rrf_weighted_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = [_vector_list(spark, sf_dir, n, retrieval.candidate_depth(20)) for n in (0, 1, 2)]
    fused = retrieval.rank_fusion(lists, [3, 1, 1], 20, ["a", "b", "c"]).drop("query_id")
    return rounded(fused, "a_score", "b_score", "c_score")


def _hybrid_sql(scope: str, question: str, terms: tuple[str, ...], depth: int, top_k: int) -> str:
    docs = f"(SELECT d.* FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE {scope})"
    vector = f"""SELECT vec_id AS chunk_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM (
      SELECT e.vec_id, {_COS.format(a='e.embedding', b='q.embedding')} AS score FROM embeddings e JOIN {docs} d ON d.doc_id = e.vec_id,
      (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE score >= 0 ORDER BY score DESC, vec_id LIMIT {depth}"""
    tf = " + ".join(f"(sum((w = '{t}')::INT)::DOUBLE / (sum((w = '{t}')::INT) + 1))" for t in terms)
    has = " AND ".join(f"sum((w = '{t}')::INT) > 0" for t in terms)
    keyword = f"""SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM (
      SELECT doc_id AS chunk_id, ({tf}) / {len(terms)} AS score FROM (SELECT doc_id, unnest({WORDS_SQL.format(c='text')}) AS w FROM {docs})
      GROUP BY doc_id HAVING {has}) ORDER BY score DESC, chunk_id LIMIT {depth}"""
    trigram = f"""SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM (
      SELECT doc_id AS chunk_id, count(*) FILTER (WHERE g IN (SELECT g FROM asked))::DOUBLE / (count(*) + (SELECT count(*)
  FROM asked) - count(*) FILTER (WHERE g IN (SELECT g FROM asked))) AS score
      FROM ({_grams(docs, 'doc_id', 'text')}) GROUP BY doc_id) WHERE score >= 0.02 ORDER BY score DESC, chunk_id LIMIT {depth}"""
    asked = f"asked AS (SELECT g FROM ({_grams(f'''(SELECT 0 AS k, '{question}' AS text)''', 'k', 'text')})), "
    sql = _fusion_sql({"vector": (vector, 3), "keyword": (keyword, 1), "trigram": (trigram, 1)}, top_k)
    return sql.replace("WITH ", "WITH " + asked, 1)


def _hybrid(scoped: DataFrame, vector: list[float], question: str, top_k: int) -> DataFrame:
    found = retrieval.hybrid_search(scoped, vector, question, top_k, min_similarity=0.02, stop_words=())
    return rounded(found.select("chunk_id", "rank", "relevance_score", "vector_score", "keyword_score", "trigram_score"), "vector_score", "keyword_score", "trigram_score")


@query(_hybrid_sql("d.source = 'src1'", "the of", ("the", "of"), 20, 5))
def hybrid_in_doc_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = paired(spark, sf_dir).where(F.col("document_id") == "src1")
    return _hybrid(scoped, first_vector(spark, sf_dir), "the of", 5)


@query(_hybrid_sql("d.lang = 'en'", "the of", ("the", "of"), 40, 10))
def hybrid_by_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = paired(spark, sf_dir).where(F.col("hub_type") == "en")
    return _hybrid(scoped, first_vector(spark, sf_dir), "the of", 10)


_ASKED = (("en", 0, "the thing"), ("fr", 1, '"en la" or les'), ("de", 2, "zzdern zzdie"), ("es", 3, "de -zzq"))


def _hub_sql(hub: str, vec: int, match: str | None, terms: tuple[str, ...], question: str, depth: int) -> str:
    """(hub_type, chunk_id, rank, relevance_score) of one hub; without ``match`` trigrams are the keyword list."""
    docs = f"(SELECT d.*, e.embedding FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.lang = '{hub}')"
    vector = f"SELECT doc_id AS chunk_id, {_COS.format(a='d.embedding', b='q.embedding')} AS score FROM {docs} d, (SELECT embedding FROM embeddings WHERE vec_id = {vec}) q WHERE score >= 0"
    grams = f"""SELECT doc_id AS chunk_id, b::DOUBLE / (n + m - b) AS score FROM (
      SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE g IN (SELECT g FROM ({_grams(f"(SELECT 0 AS k, '{question}' AS text)", 'k', 'text')}))) AS b,
        (SELECT count(*) FROM ({_grams(f"(SELECT 0 AS k, '{question}' AS text)", 'k', 'text')})) AS m
      FROM ({_grams(docs, 'doc_id', 'text')}) GROUP BY doc_id)"""
    tf = " + ".join(f"(len(list_filter(w, lambda x: x = '{t}')) / (len(list_filter(w, lambda x: x = '{t}')) + 1.0::DOUBLE))" for t in terms)
    found = f"SELECT doc_id AS chunk_id, ({tf}) / {len(terms)} AS score FROM (SELECT doc_id, {WORDS_SQL.format(c='text')} AS w FROM {docs}) WHERE {match}"
    lists = [(vector, 3), (found if match else f"SELECT * FROM ({grams}) WHERE score >= 0.1", 1), (f"SELECT * FROM ({grams}) WHERE score >= 0.2", 1)]
    united = " UNION ALL ".join(
        f"SELECT * FROM (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r, {n} AS src, {w}::DOUBLE AS w FROM ({sql})) WHERE r <= {depth}"
        for n, (sql, w) in enumerate(lists)
    )
    return f"""SELECT '{hub}' AS hub_type, chunk_id, CAST(row_number() OVER (ORDER BY sum(w / (60 + r)) DESC, min(src * 1000000 + r), chunk_id) AS INTEGER) AS rank,
  round(sum(w / (60 + r)), 6) AS relevance_score FROM ({united}) GROUP BY chunk_id QUALIFY rank <= 5"""


def _line(phrase: str) -> str:
    return f"contains(' ' || array_to_string(w, ' ') || ' ', ' {phrase} ')"


@query(" UNION ALL ".join(f"SELECT * FROM ({sql})" for sql in (
    _hub_sql("en", 0, f"{_has('the')} AND {_has('thing')}", ("the", "thing"), "the thing", 20),
    _hub_sql("fr", 1, f"{_line('en la')} OR {_has('les')}", ("en", "la", "les"), '"en la" or les', 20),
    _hub_sql("de", 2, None, ("zzdern",), "zzdern zzdie", 20),
    _hub_sql("es", 3, f"{_has('de')} AND NOT {_has('zzq')}", ("de",), "de -zzq", 20),
)))
def multi_hub_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector, keyword (syntax and fallback) and trigram lists of every hub in one job."""
    asked = spark.createDataFrame(_ASKED, "hub_type string, v long, query string")
    asked = asked.join(vectors(spark, sf_dir), F.col("v") == F.col("chunk_id")).select(
        F.lit(0).alias("query_id"), "hub_type", F.col("embedding").alias("vector"), "query"
    )
    found = retrieval.multi_hub_search(paired(spark, sf_dir), asked, 5, stop_words=())
    return found.select("hub_type", "chunk_id", "rank", "relevance_score")


@query("SELECT doc_id AS chunk_id FROM documents WHERE contains(text, 'thing') OR contains(text, 'zeit') OR n_chars / 40000.0 >= 0.5")
def relevance_post_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    keep = retrieval.relevant_to_case(F.col("n_chars") / 40000.0, F.col("content"), ["thing", "zeit"])
    return rows.where(keep).select("chunk_id")


# --- context and citations -------------------------------------------------------------


def ranked_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as the ranked sources of a question."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.coalesce("text", F.lit("")).alias("content"),
        F.col("turn").alias("page_start"), (F.col("turn") + 1).alias("page_end"), F.col("role").alias("legal_context"),
    )


_PARTS = """parts AS (SELECT query_id, n, header, content, sum(length(header) + 1 + length(content)) OVER (PARTITION BY query_id ORDER BY n) AS stop,
  length(header) + 1 + length(content) AS cost FROM (
  SELECT conv_id AS query_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, coalesce(text, '') AS content,
    '[Source ' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || ' | Pages ' || turn || '-' || (turn + 1) || ' | ' || role || ']' AS header
  FROM conversations)),
kept AS (SELECT *, CASE WHEN stop <= 600 THEN content ELSE substring(content, 1, greatest(0, 600 - (stop - cost) - length(header) - 1)::BIGINT) END AS c
  FROM parts WHERE stop - cost < 600)"""


@query(f"""WITH {_PARTS}
SELECT query_id, md5(string_agg(header || chr(10) || c, chr(10) || chr(10) ORDER BY n)) AS digest,
  CAST(sum(length(header) + 1 + length(c)) + 2 * (count(*) - 1) AS BIGINT) AS chars
FROM kept WHERE stop <= 600 OR length(c) > 0 GROUP BY query_id""")
def context_budget_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = context.build_context(ranked_turns(spark, sf_dir), budget=600)
    return packed.select("query_id", F.md5("context").alias("digest"), F.length("context").cast("long").alias("chars"))


@query("""WITH n AS (SELECT conv_id AS query_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT query_id, CAST(n AS INTEGER) AS n, turn FROM n WHERE n IN (1, 3)""")
def citation_extract_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = ranked_turns(spark, sf_dir)
    answers = turns.select("query_id").distinct().withColumn("answer", F.lit("As [Source 3] says, after [Source 1] and [Source 3]; not [Source 99]."))
    return context.resolve_citations(answers, turns).select("query_id", "n", F.col("rank").alias("turn"))


_HUBS = ("en", "fr", "de", "es")


def _global_sql(budget: int) -> str:
    """Hub after hub, as chained subqueries: what fits, what it costs, where numbers go on."""
    ctes = [f"""s AS (SELECT d.doc_id, d.lang, d.text AS content, {_COS.format(a='e.embedding', b='q.embedding')} AS score
  FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rank FROM s WHERE score >= 0),
st0 AS (SELECT 0 AS used, 0 AS seen)"""]
    for i, hub in enumerate(_HUBS):
        title = f"=== [{hub}] ==="
        ctes.append(f"""
r{i} AS (SELECT rank, content, seen + row_number() OVER (ORDER BY rank) AS n, used + {len(title) + 2} AS start
  FROM k, st{i} WHERE lang = '{hub}' AND rank <= 8 AND used + {len(title) + 2} <= {budget}),
h{i} AS (SELECT *, '[Source ' || n || ' | Pages 1-2]' AS header, length('[Source ' || n || ' | Pages 1-2]') + 3 + length(content) AS cost FROM r{i}),
e{i} AS (SELECT *, start + sum(cost) OVER (ORDER BY n) AS stop FROM h{i}),
p{i} AS (SELECT *, least(length(content), {budget} - (stop - cost) - length(header) - 3) AS room FROM e{i} WHERE stop - cost < {budget}),
l{i} AS (SELECT * FROM p{i} WHERE room > 0 OR stop <= {budget}),
st{i + 1} AS (SELECT used + coalesce((SELECT {len(title) + 2} FROM p{i} LIMIT 1), 0) + coalesce((SELECT sum(length(header) + 3 + room) FROM l{i}), 0) AS used,
  coalesce((SELECT max(n) FROM l{i}), seen) AS seen FROM st{i}),
t{i} AS (SELECT {i} AS hub, '{title}' || coalesce((SELECT string_agg(chr(10) || header || chr(10) || substring(content, 1, room::BIGINT), ''
  ORDER BY n) FROM l{i}), '') AS text
  WHERE EXISTS (SELECT 1 FROM p{i}))""")
    union = " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(len(_HUBS)))
    return f"""WITH {', '.join(ctes)}
SELECT 0 AS query_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY hub)) AS digest,
  CAST(sum(length(text)) + 2 * (count(*) - 1) AS BIGINT) AS chars FROM ({union})"""


@query(_global_sql(16000))
def global_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight nearest documents of each language, packed into one context."""
    asked = spark.createDataFrame([(0, hub) for hub in _HUBS], "query_id int, hub string").crossJoin(
        F.broadcast(vectors(spark, sf_dir).where("chunk_id = 0").select(F.col("embedding").alias("vector")))
    )
    rows = paired(spark, sf_dir)
    found = retrieval.vector_search_many(rows, asked, 8, F.col("hub_type") == F.col("hub"), by=("query_id", "hub_type"))
    found = found.withColumns({"page_start": F.lit(1), "page_end": F.lit(2), "legal_context": F.lit(None).cast("string")})
    packed = context.build_global_context(found, _HUBS)
    return packed.select("query_id", F.md5("context").alias("digest"), F.length("context").cast("long").alias("chars"))


@query(f"""WITH d AS (SELECT DISTINCT p_name AS a, p_type AS b FROM part),
ag AS ({_grams('(SELECT DISTINCT a FROM d)', 'a', 'a')}), bg AS ({_grams('(SELECT DISTINCT b FROM d)', 'b', 'b')}),
an AS (SELECT a, count(*) AS n FROM ag GROUP BY a), bn AS (SELECT b, count(*) AS n FROM bg GROUP BY b)
SELECT d.a, d.b, round(coalesce((SELECT count(*) FROM ag JOIN bg ON ag.g = bg.g WHERE ag.a = d.a AND bg.b = d.b), 0)::DOUBLE
  / (an.n + bn.n - coalesce((SELECT count(*) FROM ag JOIN bg ON ag.g = bg.g WHERE ag.a = d.a AND bg.b = d.b), 0)), 6) AS similarity
FROM d JOIN an ON an.a = d.a JOIN bn ON bn.b = d.b""")
def trigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "part").select(F.col("p_name").alias("a"), F.col("p_type").alias("b")).distinct()
    return pairs.select("a", "b", F.round(set_similarity(trigrams(F.col("a")), trigrams(F.col("b"))), 6).alias("similarity"))
