"""Question answering as composed DataFrame plans."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cases import case_description, case_keywords
from ..functions.jsontext import probability, salvaged
from ..operators.context import HUB_ORDER, build_context, build_global_context, resolve_citations
from ..operators.models import Embedder, Routed, SubQuery, bullets, embed_query, fallback_report, formulate_query, hub_answers, merged_answers, route_question
from ..operators.retrieval import hybrid_search, multi_hub_search, relevant_to_case
from .prompts import case_prompt, document_prompt, hub_prompt, synthesis_prompt


def within_validity(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks that a question may use: of reference laws only the valid ones, of others all.

    ``documents`` has ``document_id, document_type``; a chunk whose document is not there stays.
    """
    laws = documents.where(F.col("document_type") == "reference_law").select("document_id").distinct().withColumn("_law", F.lit(True))
    joined = chunks.join(laws, "document_id", "left")
    return joined.where(F.col("_law").isNull() | (F.col("legal_status") == "valid")).drop("_law")


def answer_from_chunks(spark: SparkSession, chunks: DataFrame, question: str, embedder: Embedder, chat: Callable[[str], str],
                       formulate: Callable[[str], str] | None = None, top_k: int = 15, documents: DataFrame | None = None) -> tuple[str, DataFrame]:
    """(answer, cited chunks): formulate, embed, search, pack, ask, cite.

    ``documents``, if given, says which chunks are laws (see :func:`within_validity`).
    """
    scoped = chunks if documents is None else within_validity(chunks, documents)
    query, hypothetical = formulate_query(question, formulate)
    found = hybrid_search(scoped, embed_query(embedder, hypothetical), query, top_k).withColumn("query_id", F.lit(0))
    ranked = stored(spark, found)
    context = build_context(ranked).first()
    answer = chat(document_prompt(context["context"] if context else "", question))
    said = spark.createDataFrame([(0, answer)], "query_id int, answer string")
    return answer, resolve_citations(said, ranked)


def stored(spark: SparkSession, found: DataFrame) -> DataFrame:
    """At most top-k rows, searched once for all that follows; nothing stays cached."""
    return spark.createDataFrame(found.collect(), found.schema)


def sub_queries(spark: SparkSession, routed: Routed, embedder: Embedder, query_id: int = 0) -> DataFrame:
    """One row per relevant hub; equal hypothetical answers are embedded once."""
    asked = [q for q in routed.queries if q.relevant]
    vectors = {t: embed_query(embedder, t) for t in dict.fromkeys(q.hypothetical for q in asked)}
    rows = [(query_id, q.hub_type, q.query, [float(x) for x in vectors[q.hypothetical]]) for q in asked]
    return spark.createDataFrame(rows, "query_id int, hub_type string, query string, vector array<double>")


def searched_hubs(spark: SparkSession, chunks: DataFrame, routed: Routed, embedder: Embedder, top_k: int) -> DataFrame:
    """The chunks that each hub gives, with their ranks and scores."""
    found = multi_hub_search(chunks, sub_queries(spark, routed, embedder), top_k)
    return stored(spark, found.join(chunks.drop("embedding"), ["chunk_id", "hub_type"]))


def answer_from_hubs(spark: SparkSession, chunks: DataFrame, question: str, embedder: Embedder, chat: Callable[[str], str],
                     router: Callable[[str], str] | None = None, hubs: Sequence[str] = HUB_ORDER, top_k: int = 5) -> tuple[str, DataFrame]:
    """(answer, cited chunks) over several hubs: one search job, partial answers, synthesis.

    Sources have one numbering over all hubs, in hub order, assigned before packing, so a
    citation cannot resolve to another hub's chunk.
    """
    rows = searched_hubs(spark, chunks, route_question(question, hubs, router), embedder, top_k)
    per_hub = build_context(rows, ("query_id", "hub_type"))
    asked = rows.select("query_id", "hub_type").distinct().join(per_hub, ["query_id", "hub_type"], "left")
    prompts = F.create_map(*(F.lit(x) for hub in hubs for x in (hub, hub_prompt(hub, "\0", question))))
    asked = asked.withColumn("context", F.replace(F.element_at(prompts, F.col("hub_type")), F.lit("\0"), F.col("context")))
    merged = merged_answers(hub_answers(asked, chat), hubs).first()
    whole = build_global_context(rows, hubs).first()
    answer = chat(synthesis_prompt(merged["prompt"] if merged else "", whole["context"] if whole else "", question))
    place = F.array_position(F.array(*map(F.lit, hubs)), F.col("hub_type"))
    numbered = rows.withColumn("_order", F.struct(place.alias("p"), "rank"))
    return answer, resolve_citations(spark.createDataFrame([(0, answer)], "query_id int, answer string"), numbered, order="_order")


#: Lists of an analysis, and all its fields.
_LISTS = ("strengths", "weaknesses", "risks", "recommendations")
_FIELDS = ("summary", "success_probability", *_LISTS)


def analyze_case(spark: SparkSession, chunks: DataFrame, case_type: str, facts: Mapping[str, str], embedder: Embedder, chat: Callable[[str], str],
                 base_words: str = "", case_words: Sequence[str] = (), hubs: Sequence[str] = HUB_ORDER, top_k: int = 5) -> DataFrame:
    """One row: what a model makes of a case and of the sources found for it.

    The description is embedded, the keywords are searched, in every hub; chunks that hold
    none of ``case_words`` and score low go; the rest is packed and shown with the case. The
    answer is read tolerantly: ``strategy`` says how, ``probability`` is within 0..1, and
    ``report`` puts together whatever could be read.
    """
    case = spark.createDataFrame([(case_type, dict(facts))], "case_type string, facts map<string,string>")
    fact = lambda k: F.coalesce(F.element_at("facts", F.lit(k)), F.lit(""))
    said = case.select(
        case_description(F.col("case_type"), F.col("facts")).alias("description"),
        case_keywords(F.lit(base_words), fact("claims"), fact("evidence"), F.array().cast("array<string>")).alias("words"),
    ).first()
    query = said["words"] or said["description"]
    rows = searched_hubs(spark, chunks, Routed([SubQuery(h, query, said["description"]) for h in hubs]), embedder, top_k)
    kept = rows.where(relevant_to_case(F.col("relevance_score"), F.col("content"), case_words))
    context = build_global_context(kept, hubs).first()
    answer = chat(case_prompt(said["description"], context["context"] if context else ""))
    read = spark.createDataFrame([(answer,)], "answer string").withColumn("_read", salvaged(F.col("answer"), _FIELDS))
    lists = ", ".join(f"{f} array<string>" for f in _LISTS)
    read = read.withColumn("_fields", F.from_json("_read.json", f"summary string, success_probability string, {lists}"))
    found = read.select(
        "_read.strategy", F.coalesce("_fields.summary", F.lit("")).alias("summary"),
        probability(F.col("_fields.success_probability")).alias("probability"),
        *(F.coalesce(f"_fields.{f}", F.array().cast("array<string>")).alias(f) for f in _LISTS),
    )
    sections = {"summary": F.col("summary")} | {f: bullets(F.col(f)) for f in _LISTS}
    return found.withColumn("report", fallback_report(F.lit(said["description"]), sections))
