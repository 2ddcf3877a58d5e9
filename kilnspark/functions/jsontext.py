"""Reading the JSON that models write, from strict to salvage.

The strict and the control-character tiers are Variant expressions in the JVM. Repairing
cut-off or malformed answers needs a scanner, which runs as an Arrow function over short
answers only.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def without_fences(c: Column) -> Column:
    """The text without Markdown code fences around it."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)^\s*```[A-Za-z]*\s*\n?|\s*```\s*$", "")


def braces(c: Column) -> Column:
    """From the first opening to the last closing brace; null without both."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def escaped_controls(c: Column) -> Column:
    """Raw line breaks and tabs made spaces: valid between tokens and inside strings alike."""
    return F.regexp_replace(c, r"[\x00-\x1f]", " ")


def parse_json(c: Column) -> Column:
    """Variant of the answer: as it stands, with controls escaped, or of what stands in braces."""
    bare = without_fences(c)
    tiers = (bare, escaped_controls(bare), escaped_controls(braces(bare)))
    return F.coalesce(*(F.try_parse_json(t) for t in tiers))


def parse_tier(c: Column) -> Column:
    """Which tier of :func:`parse_json` succeeds: 1, 2 or 3; null for none."""
    bare = without_fences(c)
    return (
        F.when(F.try_parse_json(bare).isNotNull(), 1)
        .when(F.try_parse_json(escaped_controls(bare)).isNotNull(), 2)
        .when(F.try_parse_json(escaped_controls(braces(bare))).isNotNull(), 3)
    )


def field(parsed: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(parsed, path, kind)


def _closed(text: str) -> str:
    """``text`` from its first brace, cut-off strings, lists and objects closed."""
    text = text[text.find("{") :] if "{" in text else text
    stack, quoted, escaped, out = [], False, False, []
    for ch in text:
        out.append(ch)
        if quoted:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                quoted = False
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]" and stack:
            stack.pop()
            if not stack:
                break
    tail = ('"' if quoted else "") + "".join(reversed(stack))
    body = "".join(out)
    if stack and not quoted:
        body = re.sub(r'(,\s*"[^"]*"\s*:?|,|"[^"]*"\s*:)\s*$', lambda m: "" if m[0][0] == "," else m[0] + "null", body)
    return body + tail


def salvage(text: str | None, fields: tuple[str, ...] = ()) -> tuple[str, str]:
    """(strategy, JSON object) of an answer; ('none', '{}') if nothing can be read.

    Strategies in order: strict, fenced, controls, braces, commas, quotes, closed, fields.
    ``fields`` picks texts, numbers, truth values and lists of texts out of the wreck.
    """
    text = (text or "").strip()
    bare = re.sub(r"^```\w*\s*|\s*```$", "", text)
    inner = re.search(r"\{.*\}", bare, re.S)
    inner = inner[0] if inner else bare
    spaced = re.sub(r"[\x00-\x1f]", " ", inner)
    commas = re.sub(r",(\s*[}\]])", r"\1", spaced)
    closed = re.sub(r",(\s*[}\]])", r"\1", _closed(re.sub(r"[\x00-\x1f]", " ", bare)))
    tried = (("strict", text), ("fenced", bare), ("controls", re.sub(r"[\x00-\x1f]", " ", bare)), ("braces", spaced), ("commas", commas), ("quotes", _requoted(commas)), ("closed", closed))
    for name, candidate in tried:
        try:
            found = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(found, dict) and (found or name != "closed"):  # closing can make an empty one
            return name, json.dumps(found, ensure_ascii=False)
    text = r'"(?:[^"\\]|\\.)*"'
    picked = {}
    for f in fields:
        if m := re.search(rf'"{re.escape(f)}"\s*:\s*(?:({text}|-?\d+(?:\.\d+)?|true|false|null)|\[([^\]]*))', bare):
            listed = None if m[2] is None else re.findall(text, m[2])
            try:
                plain = re.sub(r"[\x00-\x1f]", " ", m[1] if listed is None else f"[{','.join(listed)}]")
                if listed != []:
                    picked[f] = json.loads(plain)
            except ValueError:
                pass
    return ("fields", json.dumps(picked, ensure_ascii=False)) if picked else ("none", "{}")


def _requoted(text: str) -> str:
    """Single quotes around names and texts made double ones; apostrophes within words stay."""
    return re.sub(r"(?<![\w\\])'|'(?!\w)", '"', text)


def salvaged(c: Column, fields: tuple[str, ...] = ()) -> Column:
    """``struct(strategy, json)`` by :func:`salvage`."""

    @F.pandas_udf("strategy string, json string")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([salvage(t, fields) for t in texts], columns=["strategy", "json"])

    return run(c)


def probability(c: Column) -> Column:
    """The first number of a text as a probability: above 1 it is per cent; clamped; else 0."""
    from .text import DIGITS, PERSIAN_DIGITS

    digits = F.translate(F.regexp_extract(F.coalesce(c, F.lit("")), "([0-9۰-۹]+)", 1), PERSIAN_DIGITS, DIGITS)
    return probability_number(F.nullif(digits, F.lit("")).cast("double"))


def probability_number(n: Column) -> Column:
    # least() and greatest() pass over nulls, so a missing number is dealt with first
    return F.when(n.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(n > 1, n / 100).otherwise(n))))
