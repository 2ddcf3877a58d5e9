"""Model calls as injected functions: embedding, batching with retries, routing, answers.

No provider is built in: an embedder is a callable from a list of texts to a list of
vectors (or None), a chat model a callable from a prompt to a text.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float] | None]]

_REGISTRY: dict[str, Callable] = {}


def register(name: str, provider: Callable) -> None:
    _REGISTRY[name] = provider


def provider(name: str) -> Callable:
    if name not in _REGISTRY:
        raise KeyError(f"no provider {name!r}; known: {sorted(_REGISTRY)}")
    return _REGISTRY[name]


def with_retries(call: Callable, tries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call``, tried again after 1, 2, 4, ... times ``wait`` seconds; the last error goes up."""

    def run(*args, **kwargs):
        for n in range(tries):
            try:
                return call(*args, **kwargs)
            except Exception:  # noqa: BLE001
                if n == tries - 1:
                    raise
                sleep(wait * 2**n)

    return run


def embed_texts(embedder: Embedder, texts: Sequence[str | None], batch: int = 8) -> list[list[float] | None]:
    """Vectors in the order of the texts; None for blank texts, which are not sent."""
    out: list[list[float] | None] = [None] * len(texts)
    asked = [i for i, t in enumerate(texts) if t and t.strip()]
    for at in range(0, len(asked), batch):
        part = asked[at : at + batch]
        found = embedder([texts[i] for i in part])
        if len(found) != len(part):
            raise ValueError("the embedder returned another number of vectors")
        for i, v in zip(part, found):
            out[i] = v
    return out


def embed_query(embedder: Embedder, text: str) -> list[float]:
    if not text or not text.strip():
        raise ValueError("a query must not be blank")
    return embedder([text])[0]


def embed_chunks(chunks: DataFrame, embedder: Embedder, text: str = "content", key: str = "chunk_id", batch: int = 8) -> DataFrame:
    """``key, embedding`` of chunks without a vector; a failing call fails the task, which Spark retries."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "embedding": embed_texts(embedder, frame[text].tolist(), batch)})

    todo = chunks.where(F.col("embedding").isNull()) if "embedding" in chunks.columns else chunks
    kind = chunks.schema[key].dataType.simpleString()
    return todo.select(key, text).mapInPandas(run, f"`{key}` {kind}, embedding array<float>")


def embed_summary(result: DataFrame) -> DataFrame:
    """Counts of processed, skipped (blank) and failed chunks (``content``, ``embedding``)."""
    blank = ~F.coalesce(F.col("content"), F.lit("")).rlike(r"\S")
    return result.agg(
        F.count_if(F.col("embedding").isNotNull()).alias("processed"),
        F.count_if(F.col("embedding").isNull() & blank).alias("skipped"),
        F.count_if(F.col("embedding").isNull() & ~blank).alias("failed"),
    )


@dataclass
class SubQuery:
    hub_type: str
    query: str
    hypothetical: str
    relevant: bool = True


@dataclass
class Routed:
    queries: list[SubQuery] = field(default_factory=list)
    fallback: bool = False


def route_question(question: str, hubs: Sequence[str], model: Callable[[str], str] | None = None) -> Routed:
    """A sub-query for each hub from the model's JSON; the raw question everywhere if that fails.

    Hubs the model calls irrelevant are not searched.
    """
    from ..functions.jsontext import salvage

    everywhere = Routed([SubQuery(h, question, question) for h in hubs], True)
    if model is None or len(question.strip()) < 10:
        return everywhere
    try:
        import json

        found = json.loads(salvage(model(question))[1])
        queries = [
            SubQuery(h, str(found[h].get("query") or question), str(found[h].get("hypothetical") or question), found[h].get("relevant", True) is not False)
            for h in hubs
            if isinstance(found.get(h), dict)
        ]
    except Exception:  # noqa: BLE001  any failure of a model falls back
        return everywhere
    return Routed(queries) if queries else everywhere


def formulate_query(question: str, model: Callable[[str], str] | None = None) -> tuple[str, str]:
    """(keyword query, hypothetical answer); the question itself for both if short or failing."""
    routed = route_question(question, ["query"], model)
    first = routed.queries[0]
    return first.query, first.hypothetical


def merge_facts(known: dict, found: dict) -> dict:
    """Known facts with non-empty new ones put over them."""
    return {**known, **{k: v for k, v in found.items() if v not in (None, "", [], {})}}


def extract_facts(model: Callable[[str], str], message: str, known: dict) -> tuple[dict, float]:
    """(facts, completeness 0..1); a failing model keeps the known facts with 0."""
    import json

    from ..functions.jsontext import salvage

    try:
        strategy, text = salvage(model(message))
        found = json.loads(text)
        score = found.pop("completeness_score", 0)
        return merge_facts(known, found.get("facts", found)), max(0.0, min(1.0, float(score or 0)))
    except Exception:  # noqa: BLE001
        return known, 0.0


def is_complete(score: float, threshold: float = 0.7) -> bool:
    return score >= threshold


def hub_answers(contexts: DataFrame, model: Callable[[str], str], empty: str = "No sources were found.") -> DataFrame:
    """``query_id, hub_type, answer, tokens``: one model call per hub with a context; canned text else."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            answers = [model(c) if c else empty for c in f["context"]]
            tokens = [len(re.findall(r"\w+", a)) if c else 0 for a, c in zip(answers, f["context"])]
            yield pd.DataFrame({"query_id": f["query_id"], "hub_type": f["hub_type"], "answer": answers, "tokens": tokens})

    kind = contexts.schema["query_id"].dataType.simpleString()
    return contexts.select("query_id", "hub_type", "context").mapInPandas(run, f"query_id {kind}, hub_type string, answer string, tokens int")


def merged_answers(answers: DataFrame, hub_order: Sequence[str]) -> DataFrame:
    """``query_id, prompt, tokens``: partial answers in hub order, ready for synthesis."""
    place = F.array_position(F.array(*map(F.lit, hub_order)), F.col("hub_type"))
    listed = F.array_sort(F.collect_list(F.struct(place.alias("p"), F.concat("hub_type", F.lit(": "), "answer").alias("t"))))
    return answers.groupBy("query_id").agg(
        F.array_join(F.transform(listed, lambda s: s["t"]), "\n\n").alias("prompt"), F.sum("tokens").alias("tokens")
    )


def bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def fallback_report(title: Column, sections: dict[str, Column]) -> Column:
    """A Markdown report from whatever texts of an analysis could be read, by heading; those
    that are null or empty are left out. Lists go through :func:`bullets`."""
    parts = [F.when(body != "", F.concat(F.lit(f"## {name}\n"), body)) for name, body in sections.items()]
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), *parts)


def streamed(chat: Callable[[str], str]) -> Callable[[str], Iterator[str]]:
    """A chat model that gives whole answers, as one that gives pieces: one piece."""
    return lambda prompt: iter((chat(prompt),))


def re_embedded(chunks: DataFrame, embedder: Embedder, text: str = "content", key: str = "chunk_id", batch: int = 8) -> DataFrame:
    """All chunks with new vectors; those with blank text lose theirs."""
    new = embed_chunks(chunks.drop("embedding"), embedder, text, key, batch)
    return chunks.drop("embedding").join(new, key, "left")
