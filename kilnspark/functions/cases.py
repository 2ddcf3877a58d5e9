"""Cases as columns: the description that is embedded, the words that are searched, and what
a model's answer says about the facts.

Facts are a map from name to text; a value may itself be a JSON object, as for the parties.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsontext import parse_json

# fixed values: kinds of cases and their names
CASE_NAMES = {
    "contract_dispute": "اختلافات قراردادی",
    "family_law": "دعاوی خانواده",
    "criminal": "دعاوی کیفری",
    "civil": "دعاوی حقوقی",
    "labour": "دعاوی کار و کارگری",
    "inheritance": "دعاوی ارث",
    "property": "دعاوی ملکی",
    "other": "سایر",
}
# fixed values: facts in the order of the description, and their captions
FACT_CAPTIONS = {
    "parties": "طرفین دعوا",
    "claims": "خواسته",
    "amount": "مبلغ",
    "timeline": "زمان‌بندی",
    "jurisdiction": "مرجع قضایی",
    "evidence": "ادله و مدارک",
    "current_status": "وضعیت فعلی",
}
CURRENCY = "تومان"
#: From this score on the facts of a case suffice.
COMPLETE = 0.7


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def case_description(case_type: Column, facts: Column) -> Column:
    """One line about a case, its parts set apart by bars; facts that are missing are left out."""
    value = lambda k: _filled(F.element_at(facts, F.lit(k)))
    parties = F.from_json(value("parties"), "map<string,string>")
    listed = F.transform(F.map_entries(parties), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    amount = value("amount").try_cast("double")
    shown = {
        "parties": F.coalesce(_filled(F.array_join(listed, " و ")), value("parties")),
        "amount": F.when(amount.isNull(), value("amount")).otherwise(
            F.concat(F.when(amount == F.floor(amount), F.format_number(amount, 0)).otherwise(value("amount")), F.lit(f" {CURRENCY}"))
        ),
    }
    names = F.create_map(*(F.lit(x) for pair in CASE_NAMES.items() for x in pair))
    head = F.concat(F.lit("پرونده "), F.coalesce(F.element_at(names, case_type), case_type))
    known = [F.concat(F.lit(f"{caption}: "), shown.get(k, value(k))) for k, caption in FACT_CAPTIONS.items()]
    other = F.filter(F.map_entries(facts), lambda e: ~e["key"].isin(list(FACT_CAPTIONS)) & (e["value"] != ""))
    rest = F.transform(other, lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat_ws(" | ", head, *known, rest)


def case_keywords(base: Column, claims: Column, evidence: Column, roles: Column, known_roles: Sequence[str] = ()) -> Column:
    """Search words of a case: its kind's words, 20 of the claims, 15 of the evidence, known roles."""
    first = lambda c, n: _filled(F.array_join(F.slice(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""), 1, n), " "))
    known = F.filter(roles, lambda r: r.isin(list(known_roles)))
    return F.concat_ws(" ", _filled(base), first(claims, 20), first(evidence, 15), _filled(F.array_join(known, " ")))


def facts_of(answer: Column, threshold: float = COMPLETE) -> Column:
    """What an answer says about a case, each field of its own type or else empty.

    ``struct(case_type, facts, completeness, missing, next_question, ready)``; null where the
    answer holds no JSON object. The score is brought into 0..1; without a truth value in
    ``is_ready`` it decides.
    """
    parsed = parse_json(answer)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
    text = lambda path: F.coalesce(F.when(kind(path) == "STRING", F.try_variant_get(parsed, path, "string")), F.lit(""))
    number = F.when(kind("$.completeness_score").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(parsed, "$.completeness_score", "double"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.0))))
    facts = F.when(kind("$.facts").startswith("OBJECT"), F.to_json(F.try_variant_get(parsed, "$.facts", "variant")))
    missing = F.when(kind("$.missing_facts").startswith("ARRAY"), F.try_variant_get(parsed, "$.missing_facts", "array<string>"))
    ready = F.when(kind("$.is_ready") == "BOOLEAN", F.try_variant_get(parsed, "$.is_ready", "boolean"))
    found = F.struct(
        text("$.case_type").alias("case_type"),
        F.coalesce(facts, F.lit("{}")).alias("facts"),
        score.alias("completeness"),
        F.coalesce(missing, F.array().cast("array<string>")).alias("missing"),
        text("$.next_question").alias("next_question"),
        F.coalesce(ready, score >= threshold).alias("ready"),
    )
    return F.when(parsed.isNotNull() & F.schema_of_variant(parsed).startswith("OBJECT"), found)


def routed(cached: Column) -> Column:
    """A routing result read back from its JSON: ``struct(sub_queries, reasoning,
    hypothetical_answer)``; entries that are no objects are left out, missing texts are empty."""
    read = F.from_json(cached, "sub_queries map<string,string>, reasoning string, hypothetical_answer string")
    one = lambda v: F.from_json(v, "fts_query string, vector_query string")
    blank = lambda c: F.coalesce(c, F.lit(""))
    objects = F.map_filter(F.coalesce(read["sub_queries"], F.create_map().cast("map<string,string>")), lambda _, v: v.startswith("{"))
    queries = F.transform_values(
        objects, lambda _, v: F.struct(blank(one(v)["fts_query"]).alias("fts_query"), blank(one(v)["vector_query"]).alias("vector_query"))
    )
    return F.struct(queries.alias("sub_queries"), blank(read["reasoning"]).alias("reasoning"), blank(read["hypothetical_answer"]).alias("hypothetical_answer"))
