"""Secret scans with multipart credential linking.

Each text is scanned once for parts: strong ones, which are always reported, and weak
ones (bare secret values, endpoints), which are reported only when a complementary part,
strong or weak, lies near enough. The linking is an interval join within scopes: a scope is a stretch of
``scope`` code points of one document, parts are put under the scopes they touch, and two
parts link if the gap between them is below ``scope``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, id_text, materialize, slices, spread_join, text_key

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "secret", "endpoint")
#: While linking, a secret within an endpoint, such as the path of a URL; then a secret.
INNER = len(KINDS)
SCOPE = 200

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Weak parts: a bare value of 40 or more characters, a host with a scheme or a port.
_SECRET = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{40,}={0,2}(?![A-Za-z0-9+/=_-])")
_ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+|(?<![\w.-])(?:[a-z0-9-]+\.)+[a-z]{2,}:\d{2,5}(?!\d)", re.A)

_PORT = re.compile(r":\d\d", re.A)
_CLASS = ("value", "access", "value", "value", "endpoint", "value")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all strong parts, sorted."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak parts that overlap no strong one; none where all parts of the text are alike.

    Parts are access identifiers, endpoints, or values (assigned, hex, bare).
    """
    endpoints = [m.span() for m in _ENDPOINT.finditer(text)] if "://" in text or _PORT.search(text) else []
    if not endpoints and all(k != 1 for _, k, _ in base):
        return []
    found, at = [(a, 4, b) for a, b in endpoints], 0
    for m in _SECRET.finditer(text):
        if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]):
            while at < len(endpoints) and endpoints[at][1] <= m.start():
                at += 1
            inner = at < len(endpoints) and endpoints[at][0] < m.end()
            found.append((m.start(), INNER if inner else 3, m.end()))
    if len({_CLASS[k] for _, k, _ in found + base}) < 2:
        return []
    ends, out, at = base, [], 0
    for span in sorted(found):
        while at < len(ends) and ends[at][2] <= span[0]:
            at += 1
        if at == len(ends) or ends[at][0] >= span[2]:
            out.append(span)
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_SPANS_SQL = "array<struct<start:long,kind:int,end:long>>"


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, _t1, _t2, base, weak``: strong and weak parts of each text, with code point
    offsets, and the text's key.

    Weak parts are kept only where the text holds two parts that complement each other,
    since without these they cannot link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            base, weak = [], []
            for text in b.column(3).to_pylist():
                strong = base_spans(text)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in strong])
                weak.append([{"start": s, "kind": k, "end": e} for s, k, e in weak_spans(text, strong)])
            yield pa.record_batch(
                [*b.columns[:3], pa.array(base, _SPANS), pa.array(weak, _SPANS)],
                names=["doc_id", "_t1", "_t2", "base", "weak"],
            )

    t1, t2 = text_key(F.col("text"))
    rows = id_text(docs).select("doc_id", t1.alias("_t1"), t2.alias("_t2"), "text")
    return rows.mapInArrow(run, f"doc_id long, _t1 long, _t2 long, base {_SPANS_SQL}, weak {_SPANS_SQL}")


def linked_weak(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``_t1, _t2, linked``: the weak parts of each text that a complementary part supports.

    A bare secret is supported by an access identifier or an endpoint, an endpoint by an
    access identifier or a value: assigned, hex or bare. So two weak parts can support each
    other; but what lies within an endpoint and an endpoint do not. Every part is listed
    once for each scope it touches after widening supporting ones by ``scope`` on both
    sides; parts meet in a shared scope. Copies of a text are linked once.
    """
    key = ["_t1", "_t2"]
    some = scanned.where(F.size("weak") > 0).groupBy(*key).agg(F.first("base").alias("base"), F.first("weak").alias("weak"))
    scopes = lambda low, high: F.explode(
        F.sequence(F.floor(F.greatest(F.lit(0), low) / scope).cast("long"), F.floor(high / scope).cast("long"))
    )
    weak = some.select(*key, F.explode("weak").alias("w")).select(
        *key, "w", scopes(F.col("w.start"), F.col("w.end") - 1).alias("_scope")
    )
    strong = (
        some.select(*key, F.explode(F.concat("base", "weak")).alias("s"))
        .where(F.col("s.kind") != INNER)
        .select(*key, "s", scopes(F.col("s.start") - scope, F.col("s.end") - 1 + scope).alias("_scope"))
    )
    gap = F.greatest(F.col("w.start") - F.col("s.end"), F.col("s.start") - F.col("w.end"))
    fits = (
        (F.col("s.kind") == 1)
        | ((F.col("w.kind") == 4) & F.col("s.kind").isin(0, 2, 3))
        | ((F.col("w.kind") == 3) & (F.col("s.kind") == 4))
    )
    # semi join: a weak part comes out once for each scope, however many parts support it
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (*key, "_scope")]
    near = weak.alias("l").join(strong.alias("r"), [*same, fits & (gap < scope)], "left_semi")
    kind = F.when(F.col("w.kind") == INNER, 3).otherwise(F.col("w.kind"))
    linked = F.struct(F.col("w.start").alias("start"), kind.alias("kind"), F.col("w.end").alias("end"))
    return near.groupBy(*key).agg(F.collect_set(linked).alias("linked"))


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id, _t1, _t2, base, spans``: strong parts, and all reported parts, of each row.

    Spans are structs (start, kind, end), sorted; offsets are in code points, ends
    exclusive, ``kind`` an index into ``KINDS``. Null or empty texts have none. Repeated
    rows are each returned; ``_t1`` and ``_t2`` are the key of the text (see
    :func:`.common.text_key`). Other columns of ``docs`` play no part.
    """
    table = materialize(scan(docs))
    links = linked_weak(table, scope)
    joined = spread_join(table, links, ["_t1", "_t2"], "left", by="doc_id", small=True)
    none = F.array().cast(_SPANS_SQL)
    return joined.select("doc_id", "_t1", "_t2", "base", F.array_sort(F.concat("base", F.coalesce("linked", none))).alias("spans"))


def listed(spans) -> object:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def secret_report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Counts of strong parts by kind, a digest of them, and all spans of each row."""
    found = find_secrets(docs, scope)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``[KIND]``.

    All columns stay; a null text stays null. Overlapping spans are replaced as one, named
    after the first.
    """
    found = find_secrets(docs, scope).where(F.size("spans") > 0)
    spans = found.groupBy("_t1", "_t2").agg(F.first("spans").alias("_kiln_spans"))
    spans = spans.select(F.col("_t1").alias("_kiln_t1"), F.col("_t2").alias("_kiln_t2"), "_kiln_spans")
    t1, t2 = text_key(docs["text"])
    keyed = docs.withColumns({"_kiln_t1": t1, "_kiln_t2": t2})

    @F.pandas_udf("string")
    def cut(text, found):
        give_back()
        out = []
        for t, spans in zip(text, found):
            if t is not None and spans is not None and len(spans):
                parts, at = [], 0
                for s in spans:
                    if s["start"] >= at:
                        parts += [t[at : s["start"]], f"[{KINDS[s['kind']].upper()}]"]
                    at = max(at, s["end"])
                t = "".join([*parts, t[at:]])
            out.append(t)
        import pandas as pd

        return pd.Series(out, dtype=object)

    joined = spread_join(keyed, spans, ["_kiln_t1", "_kiln_t2"], "left", by="doc_id", small=True)
    hit = F.col("_kiln_spans").isNotNull()  # only texts with spans go to Python
    return joined.select(
        *(
            F.when(F.col("_kiln_spans").isNull(), F.col("text")).otherwise(cut(F.when(hit, F.col("text")), "_kiln_spans")).alias("text")
            if c == "text"
            else F.col(f"`{c}`")
            for c in docs.columns
        )
    )
