"""The texts around a question: what a model is told, and the sources it may cite."""

from __future__ import annotations

# fixed values: hubs and what each holds
HUBS = {
    "legislation": "قوانین مصوب",
    "judicial_precedent": "رویه‌های قضایی",
    "advisory_opinion": "نظریات مشورتی",
}
_CITED = {
    "legislation": "article numbers, names of laws, and dates of approval",
    "judicial_precedent": "numbers of judgments, courts, and dates of issue",
    "advisory_opinion": "numbers of opinions, issuing offices, and dates",
}
_RULES = (
    "Use nothing but the sources below. Mark every statement with its source as [Source N]. "
    "If the sources do not answer the question, say so. Write formal Persian unless asked otherwise."
)


def document_prompt(context: str, question: str) -> str:
    """One document's sources and the question about it."""
    return f"Answer a question about a document. {_RULES}\n\n{context}\n\n{question}"


def hub_prompt(hub: str, context: str, question: str) -> str:
    """One hub's sources and the question; the answer is a part of the whole."""
    if hub not in HUBS:
        raise ValueError(f"unknown hub {hub!r}")
    task = f"Give the part of an answer that {hub} ({HUBS[hub]}) can give. Name {_CITED[hub]} where the sources have them."
    return f"{task} {_RULES}\n\n{context}\n\n{question}"


def synthesis_prompt(parts: str, context: str, question: str) -> str:
    """Partial answers to be made one; earlier hubs prevail over later ones."""
    order = ", then ".join(HUBS)
    task = f"Make one answer of the partial answers. Where they contradict each other, start the paragraph with [Conflict] and follow {order}."
    return "\n\n".join(x for x in (f"{task} {_RULES}", context, parts, question) if x)


def case_prompt(description: str, context: str) -> str:
    """A case and its sources; the answer is a JSON object."""
    fields = "summary (text), success_probability (0 to 100), strengths, weaknesses, risks, recommendations (lists of texts)"
    return f"Assess the case. Answer with a JSON object of {fields}. {_RULES}\n\n{description}\n\n{context}"
