"""Vector, keyword and trigram search, and their weighted rank fusion.

Every retriever takes a table of chunks and a table of queries and answers all queries in
one job. Chunks have ``chunk_id`` and whatever else the caller scopes by; results are
``query_id, chunk_id, score`` with ties broken by ``chunk_id``. Scope and metadata
predicates are plain filters on the chunk table, so they reach the scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, fts_normalize, fts_normalized, let, set_similarity, trigrams, words

RRF_K = 60
#: A table of queries beyond this many rows or bytes is not broadcast to the chunks.
BROADCAST_QUERIES, BROADCAST_BYTES = 10_000, 64 << 20
#: The similarity from which trigrams stand in for a keyword search that finds nothing.
FALLBACK_SIMILARITY = 0.1


def candidate_depth(top_k: int) -> int:
    """How far each retriever looks before fusion."""
    return max(4 * top_k, 20)


def top_per_query(scored: DataFrame, k: int, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """The k best rows of each query; Spark prunes to k per partition before the shuffle."""
    best = W.partitionBy(*by).orderBy(F.desc("score"), F.asc("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def small(queries: DataFrame) -> DataFrame:
    """Broadcast the queries if they are few and small (measured over a limited number)."""
    width = F.sum(F.octet_length(F.to_json(F.struct(*queries.columns))))
    rows, size = queries.limit(BROADCAST_QUERIES + 1).agg(F.count("*"), F.coalesce(width, F.lit(0))).first()
    return F.broadcast(queries) if rows <= BROADCAST_QUERIES and size <= BROADCAST_BYTES else queries


# --- vectors ---------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a null or zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def checked_width(vector: Sequence[float], width: int) -> list[float]:
    if len(vector) != width:
        raise ValueError(f"the query vector has {len(vector)} components, not {width}")
    return [float(x) for x in vector]


def same_width(a: Column, b: Column, value: Column) -> Column:
    """``value``, or an error where two vectors that meet have different numbers of components."""
    message = F.concat(F.lit("vectors of "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"), F.lit(" components"))
    return F.when(F.size(a) != F.size(b), F.raise_error(message).cast("double")).otherwise(value)


def vector_search(chunks: DataFrame, vector: Sequence[float], top_k: int, min_score: float = 0.0, width: int | None = None) -> DataFrame:
    """One query vector: the top k by cosine similarity, nulls left out.

    The query is a literal, so the plan is scan, project, ``TakeOrderedAndProject``. A vector
    of another width than ``width``, by default that of one stored vector, is an error.
    """
    held = chunks.where(F.col("embedding").isNotNull())
    if width is None:
        one = held.select(F.size("embedding")).first()
        width = one[0] if one else len(vector)
    literal = F.array(*map(F.lit, checked_width(vector, width)))
    score = same_width(F.col("embedding"), literal, cosine(F.col("embedding"), literal))
    scored = held.withColumn("score", score).where(F.col("score") >= min_score)
    return scored.drop("embedding").orderBy(F.desc("score"), "chunk_id").limit(top_k)


def vector_search_many(chunks: DataFrame, queries: DataFrame, top_k: int, on: Column, min_score: float = 0.0, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Many queries (``query_id, vector``): the top k of each ``by`` group.

    ``on`` scopes queries to chunks by an equality, such as that of the hub; for queries over
    all chunks there is no such plan.
    """
    held = chunks.where(F.col("embedding").isNotNull())
    score = same_width(F.col("embedding"), F.col("vector"), cosine(F.col("embedding"), F.col("vector")))
    scored = held.join(small(queries), on).withColumn("score", score).drop("embedding", "vector")
    return top_per_query(scored.where(F.col("score") >= min_score), top_k, by)


# --- keywords --------------------------------------------------------------------------


def parse_websearch(query: str) -> list[dict]:
    """Alternatives (``or``) of required words, phrases and excluded words.

    ``a "b c" -d or e`` becomes two alternatives. Words are what :func:`words` would find.
    """
    found, at = [], {"words": [], "phrases": [], "not": []}
    for minus, phrase, word in re.findall(r'(-?)"([^"]*)"|(?<!\S)(-?\S+)', query):
        if phrase:
            parts = re.findall(r"\w+", phrase.lower())
            at["not" if minus else "phrases"].append(parts if not minus else " ".join(parts))
        elif word.lower() == "or" and any(at.values()):
            found.append(at)
            at = {"words": [], "phrases": [], "not": []}
        else:
            target = "not" if word.startswith("-") else "words"
            at[target] += re.findall(r"\w+", word.lower())
    return [*found, at] if any(at.values()) else found


def holds_phrase(tokens: Column, phrase: Sequence[str]) -> Column:
    """Whether the words of ``phrase`` stand next to each other in ``tokens``."""
    want = F.array(*map(F.lit, phrase))
    n = len(phrase)

    def found(ts: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(ts) - n + 1, F.lit(1)))
        return (F.size(ts) >= n) & F.exists(starts, lambda i: F.slice(ts, i, n) == want)

    return let(tokens, found)


def matches_websearch(tokens: Column, query: str) -> Column:
    alternatives = []
    for alt in parse_websearch(query):
        here = F.lit(True)
        for w in alt["words"]:
            here = here & F.array_contains(tokens, w)
        for p in alt["phrases"]:
            here = here & holds_phrase(tokens, p)
        for w in alt["not"]:
            here = here & ~(holds_phrase(tokens, w.split()) if " " in w else F.array_contains(tokens, w))
        alternatives.append(here)
    out = F.lit(False)
    for a in alternatives:
        out = out | a
    return out


def term_rank(tokens: Column, terms: Sequence[str]) -> Column:
    """Sum of tf / (tf + 1) over the query's terms, divided by their number."""
    part = lambda t: F.size(F.filter(tokens, lambda x: x == F.lit(t)))
    total = F.lit(0.0)
    for t in terms:
        total = total + part(t) / (part(t) + 1)
    return total / len(terms) if terms else F.lit(0.0)


def searched_text(chunks: DataFrame, content: str) -> Column:
    """What keyword search reads: the column that :func:`~..sources.sinks.with_search_text`
    stores, or the content with letters and digits made alike."""
    return F.col("search_text") if "search_text" in chunks.columns else fts_normalize(F.col(content), unicode_forms=False)


def without_stop_words(query: str, stop_words: Sequence[str]) -> str:
    """The normalised query without its stop words; signs of the syntax stay."""
    stops = {fts_normalized(w).lower() for w in stop_words}
    return " ".join(w for w in fts_normalized(query).split() if w.lower() not in stops)


def query_terms(query: str) -> list[str]:
    """All words that a web-search query asks for, each once."""
    asked = [w for alt in parse_websearch(query) for w in [*alt["words"], *(x for p in alt["phrases"] for x in p)]]
    return list(dict.fromkeys(asked))


def keyword_search(chunks: DataFrame, query: str, top_k: int, content: str = "content", stop_words: Sequence[str] = STOP_WORDS, fallback: bool = True) -> DataFrame:
    """One query: web-search syntax, else all its words, else (``fallback``) trigrams from 0.1 on.

    The query is normalised and loses its stop words first; one that has nothing else finds
    nothing. A later stage is tried when the one before has no row, which a job with a limit
    of one row tells. ``score`` is that of the stage.
    """
    asked = without_stop_words(query, stop_words)
    tokens = words(searched_text(chunks, content))
    plain = re.findall(r"\w+", asked.lower())
    best = lambda rows: rows.orderBy(F.desc("score"), "chunk_id").limit(top_k)
    if not plain:
        return chunks.where(F.lit(False)).withColumn("score", F.lit(0.0))
    stages = [
        chunks.where(matches_websearch(tokens, asked)).withColumn("score", term_rank(tokens, query_terms(asked))),
        chunks.where(matches_websearch(tokens, " ".join(plain))).withColumn("score", term_rank(tokens, list(dict.fromkeys(plain)))),
    ]
    for found in stages:
        if not found.isEmpty():
            return best(found)
    if fallback:
        return trigram_search(chunks, asked, top_k, FALLBACK_SIMILARITY, content)
    return best(stages[0])


def postings(chunks: DataFrame, content: str = "content", keep: Sequence[str] = (), asked: DataFrame | None = None) -> DataFrame:
    """``chunk_id, term, tf`` (and ``keep``): the inverted index as a table.

    Written bucketed by ``term`` it serves any number of keyword jobs without a shuffle.
    With ``asked`` (queries with ``terms``) only their terms are listed: all others go before
    anything is shuffled.
    """
    exploded = chunks.select("chunk_id", *keep, F.explode(words(searched_text(chunks, content))).alias("term"))
    if asked is not None:
        wanted = asked.select(F.explode("terms").alias("term")).distinct()
        exploded = exploded.join(small(wanted), "term", "left_semi")
        exploded = exploded.repartition("chunk_id")  # so that the hits of a chunk need not be shuffled again
    return exploded.groupBy("chunk_id", *keep, "term").agg(F.count("*").alias("tf"))


def keyword_matches(index: DataFrame, queries: DataFrame, any_term: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Chunks that hold all (or any) terms of each query (``query_id, terms``), with their rank.

    Query terms are joined to the postings by equality, so only postings of asked terms
    survive the first join, whatever the size of the index.
    """
    asked = queries.select("query_id", F.array_distinct("terms").alias("terms")).select(
        "query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term")
    )
    hits = index.join(small(asked), "term").groupBy("query_id", "n_terms", "chunk_id", *keep).agg(
        F.count("*").alias("found"), F.sum(F.col("tf") / (F.col("tf") + 1)).alias("weight")
    )
    hits = hits if any_term else hits.where(F.col("found") == F.col("n_terms"))
    return hits.select("query_id", "chunk_id", *keep, (F.col("weight") / F.col("n_terms")).alias("score"))


def first_stage_that_finds(stages: Sequence[DataFrame]) -> DataFrame:
    """Per query, the rows of the first stage that has any: fallback without driver control."""
    united = None
    for n, stage in enumerate(stages):
        one = stage.withColumn("stage", F.lit(n))
        united = one if united is None else united.unionByName(one)
    first = F.min("stage").over(W.partitionBy("query_id"))
    return united.withColumn("_first", first).where(F.col("stage") == F.col("_first")).drop("_first")


# --- trigrams --------------------------------------------------------------------------


def trigram_search(chunks: DataFrame, query: str, top_k: int, min_similarity: float = 0.2, content: str = "content") -> DataFrame:
    """One query: the top k by the similarity of trigram sets, from ``min_similarity`` on."""
    score = set_similarity(trigrams(F.col(content)), trigrams(F.lit(query)))
    return chunks.withColumn("score", score).where(F.col("score") >= min_similarity).orderBy(F.desc("score"), "chunk_id").limit(top_k)


def trigram_search_many(chunks: DataFrame, queries: DataFrame, min_similarity: float, content: str = "content", keep: Sequence[str] = (), on: Column | None = None) -> DataFrame:
    """Many queries (``query_id, query``): all pairs that reach ``min_similarity`` (above 0).

    With ``on``, queries meet the chunks of their scope. Without, chunks and queries meet in
    the trigrams they share, which are counted, so pairs without a common one never arise.
    """
    if min_similarity <= 0:
        raise ValueError("min_similarity must be above 0")
    held = chunks.select("chunk_id", *keep, trigrams(F.col(content)).alias("_grams"))
    asked = queries.withColumn("_asked", trigrams(F.col("query"))).drop("query")
    if on is not None:
        score = set_similarity(F.col("_grams"), F.col("_asked"))
        scored = held.join(small(asked), on).select("query_id", "chunk_id", *keep, score.alias("score"))
        return scored.where(F.col("score") >= min_similarity)
    one = held.select("chunk_id", *keep, F.size("_grams").alias("_n"), F.explode("_grams").alias("_g"))
    other = asked.select("query_id", F.size("_asked").alias("_m"), F.explode("_asked").alias("_g"))
    met = one.join(small(other), "_g").groupBy("query_id", "_m", "chunk_id", *keep, "_n").agg(F.count("*").alias("_both"))
    scored = met.select("query_id", "chunk_id", *keep, (F.col("_both") / (F.col("_n") + F.col("_m") - F.col("_both"))).alias("score"))
    return scored.where(F.col("score") >= min_similarity)


# --- fusion ----------------------------------------------------------------------------


def rank_fusion(lists: Sequence[DataFrame], weights: Sequence[float], top_k: int, names: Sequence[str], by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked lists (``query_id, chunk_id, score``).

    One union and one aggregation instead of outer joins. Each list's own score is kept
    under ``<name>_score`` (0 where the chunk is absent); ties keep first-seen order: the
    first list that has the chunk, then the rank in it.
    """
    by = list(by)
    united = None
    for n, (rows, weight) in enumerate(zip(lists, weights)):
        rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "chunk_id"))
        one = rows.select(*by, "chunk_id", "score", rank.alias("r"), F.lit(n).alias("src"), F.lit(float(weight)).alias("w"))
        united = one if united is None else united.unionByName(one)
    return _fused(united, top_k, names, by)


def _fused(ranked: DataFrame, top_k: int, names: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Fusion of ranked rows: ``by``, ``chunk_id, score``, rank ``r`` in list ``src`` of weight ``w``."""
    own = [F.coalesce(F.max(F.when(F.col("src") == n, F.col("score"))), F.lit(0.0)).alias(f"{name}_score") for n, name in enumerate(names)]
    fused = ranked.groupBy(*by, "chunk_id").agg(
        F.sum(F.col("w") / (RRF_K + F.col("r"))).alias("_sum"), F.min(F.struct("src", "r")).alias("_seen"), *own
    )
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("_sum"), "_seen", "chunk_id"))
    return fused.withColumn("rank", place).where(F.col("rank") <= top_k).select(
        *by, "rank", "chunk_id", F.round("_sum", 6).alias("relevance_score"), *(f"{n}_score" for n in names)
    )


def hybrid_search(chunks: DataFrame, query_vector: Sequence[float], query_text: str, top_k: int, min_score: float = 0.0,
                  trigram: bool = True, weights: Sequence[float] | None = None, min_similarity: float = 0.2,
                  content: str = "content", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """One question over ``chunks`` (already scoped): vector, keyword and trigram lists, fused.

    ``min_score`` gates the vector list only.
    """
    depth = candidate_depth(top_k)
    one = lambda rows: rows.select(F.lit(0).alias("query_id"), "chunk_id", "score")
    lists = [one(vector_search(chunks, query_vector, depth, min_score)), one(keyword_search(chunks, query_text, depth, content, stop_words))]
    if trigram:
        lists.append(one(trigram_search(chunks, query_text, depth, min_similarity, content)))
    names = ["vector", "keyword", "trigram"][: len(lists)]
    fused = rank_fusion(lists, weights or [3, 1, 1][: len(lists)], top_k, names).drop("query_id")
    kept = chunks.drop("embedding")
    return kept.join(F.broadcast(fused), "chunk_id")  # at most top_k rows


def asked_for(query: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """The parsed web-search syntax of each query, as a struct of ``alternatives`` (arrays of
    words, of phrases, of words and phrases that must be absent), ``plain`` words and ``terms``
    of the rank. Runs over the table of queries only."""

    @F.pandas_udf("alternatives array<struct<words:array<string>,phrases:array<string>,no:array<string>>>, plain array<string>, terms array<string>")
    def parsed(queries: pd.Series) -> pd.DataFrame:
        rows = []
        for q in queries:
            asked = without_stop_words(q or "", stop_words)
            found = [{"words": a["words"], "phrases": [" ".join(p) for p in a["phrases"]], "no": a["not"]} for a in parse_websearch(asked)]
            plain = list(dict.fromkeys(re.findall(r"\w+", asked.lower())))
            rows.append((found if plain else [], plain, query_terms(asked)))
        return pd.DataFrame(rows, columns=["alternatives", "plain", "terms"])

    return parsed(query)


def holds_all(text: Column, wanted: Column) -> Column:
    """Whether words or phrases of ``wanted`` all stand in ``text``, words between blanks."""
    return F.forall(wanted, lambda w: F.contains(text, F.concat(F.lit(" "), w, F.lit(" "))))


def _stage_of(line: Column, asked: Column) -> Column:
    """0 where the syntax of ``asked`` matches, 1 where all of its plain words stand, else null."""
    absent = lambda a: ~F.exists(a["no"], lambda w: F.contains(line, F.concat(F.lit(" "), w, F.lit(" "))))
    hit = F.exists(asked["alternatives"], lambda a: holds_all(line, a["words"]) & holds_all(line, a["phrases"]) & absent(a))
    every = (F.size(asked["plain"]) > 0) & holds_all(line, asked["plain"])
    return F.when(hit, 0).when(every, 1)


def _rank_of(tokens: Column, terms: Column) -> Column:
    """Sum of tf / (tf + 1) over the terms, divided by their number."""
    tf = lambda t: F.size(F.filter(tokens, lambda x: x == t))
    parts = F.transform(terms, lambda t: tf(t) / (tf(t) + 1))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.lit(1), F.size(terms))


def keyword_search_many(chunks: DataFrame, queries: DataFrame, top_k: int, on: Column, content: str = "content", keep: Sequence[str] = (), stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """:func:`keyword_search` without its trigrams for many queries (``query_id, query``) at
    once, each over the chunks that ``on`` gives it; ranked per query and ``keep``."""
    asked = queries.withColumn("_asked", asked_for(F.col("query"), stop_words)).drop("query", "vector")
    tokens = chunks.select("chunk_id", *keep, words(searched_text(chunks, content)).alias("_tokens"))
    met = tokens.withColumn("_line", F.concat(F.lit(" "), F.array_join("_tokens", " "), F.lit(" "))).join(small(asked), on)
    met = met.withColumn("stage", _stage_of(F.col("_line"), F.col("_asked"))).where(F.col("stage").isNotNull())
    score = F.when(F.col("stage") == 0, _rank_of(F.col("_tokens"), F.col("_asked.terms"))).otherwise(_rank_of(F.col("_tokens"), F.col("_asked.plain")))
    group = ["query_id", *keep]
    ranked = top_per_query(met.withColumn("score", score).select(*group, "chunk_id", "stage", "score"), top_k, (*group, "stage"))
    return ranked.drop("rank").withColumn("_first", F.min("stage").over(W.partitionBy(*group))).where("stage = _first").drop("_first", "stage")


def multi_hub_search(chunks: DataFrame, questions: DataFrame, top_k: int, hub: str = "hub_type", stop_words: Sequence[str] = STOP_WORDS,
                     weights: Sequence[float] = (3, 1, 1), min_similarity: float = 0.2, content: str = "content") -> DataFrame:
    """All sub-queries of all hubs in one job: vector, keyword and trigram lists, fused.

    ``questions`` has ``query_id``, the hub, ``vector`` and ``query``; each meets only the
    chunks of its hub (an equi join), lists are ranked and fused per (query, hub). A hub in
    which a query's words find nothing gets its trigram list from 0.1 on as keyword list,
    unless the query is stop words only.

    Chunks are scanned once: a chunk that meets a question gets all of its scores, each a row
    of a list, and one window ranks all lists; Spark keeps the best of each list in every
    partition before it shuffles them.
    """
    depth = candidate_depth(top_k)
    parsed = questions.withColumn("_asked", asked_for(F.col("query"), stop_words)).withColumn("_grams", trigrams(F.col("query")))
    asked = small(parsed.select("query_id", F.col(hub).alias("_hub"), F.col("vector").alias("_vector"), "_asked", "_grams"))
    held = chunks.select("chunk_id", hub, "embedding", words(searched_text(chunks, content)).alias("_tokens"), trigrams(F.col(content)).alias("_held"))
    held = held.withColumn("_line", F.concat(F.lit(" "), F.array_join("_tokens", " "), F.lit(" ")))
    met = held.join(asked, F.col(hub) == F.col("_hub"))
    there = F.col("embedding").isNotNull() & F.col("_vector").isNotNull()
    near = F.when(there, same_width(F.col("embedding"), F.col("_vector"), cosine(F.col("embedding"), F.col("_vector"))))
    met = met.withColumn("stage", _stage_of(F.col("_line"), F.col("_asked")))
    stage = F.col("stage")
    score = F.when(stage == 0, _rank_of(F.col("_tokens"), F.col("_asked.terms"))).when(stage == 1, _rank_of(F.col("_tokens"), F.col("_asked.plain")))
    scored = met.select("query_id", hub, "chunk_id", near.alias("near"), "stage", score.alias("score"),
                        set_similarity(F.col("_held"), F.col("_grams")).alias("alike"), (F.size("_asked.plain") > 0).alias("real"))
    entry = lambda which, stage, score, there: F.when(there, F.struct(F.lit(which).alias("src"), stage.alias("stage"), score.alias("score")))
    none, alike = F.lit(0), F.col("alike")
    entries = F.array(
        entry(0, none, F.col("near"), F.col("near") >= 0),
        entry(1, F.col("stage"), F.col("score"), F.col("stage").isNotNull()),
        entry(1, F.lit(2), alike, F.col("real") & (alike >= FALLBACK_SIMILARITY)),
        entry(2, none, alike, alike >= min_similarity),
    )
    listed = scored.select("query_id", hub, "chunk_id", F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select("query_id", hub, "chunk_id", "e.*")
    group = ["query_id", hub]
    ranked = top_per_query(listed, depth, (*group, "src", "stage")).withColumnRenamed("rank", "r")
    # of the keyword list, the first stage that finds anything
    first = F.min("stage").over(W.partitionBy(*group, "src"))
    ranked = ranked.withColumn("_first", first).where("stage = _first")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("src") + 1)
    return _fused(ranked.withColumn("w", weight), top_k, ["vector", "keyword", "trigram"], group)


def relevant_to_case(score: Column, content: Column, keywords: Sequence[str], min_score: float = 0.5) -> Column:
    """Keep a chunk that holds any keyword or scores high; no keywords: keep all."""
    if not keywords:
        return F.lit(True)
    held = F.lit(False)
    for k in keywords:
        held = held | content.contains(k)
    return held | (score >= min_score)
