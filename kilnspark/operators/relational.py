"""Filters, joins, pages and roll-ups over documents, chunks, messages and tasks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# --- filters ---------------------------------------------------------------------------

_LOOKUPS = {
    "exact": lambda c, v: c == F.lit(v),
    "iexact": lambda c, v: F.lower(c) == F.lit(str(v).lower()),
    "contains": lambda c, v: c.contains(v),
    "icontains": lambda c, v: F.lower(c).contains(str(v).lower()),
    "startswith": lambda c, v: c.startswith(v),
    "in": lambda c, v: c.isin(list(v)),
    "gt": lambda c, v: c > F.lit(v),
    "gte": lambda c, v: c >= F.lit(v),
    "lt": lambda c, v: c < F.lit(v),
    "lte": lambda c, v: c <= F.lit(v),
    "isnull": lambda c, v: c.isNull() if v else c.isNotNull(),
}
METADATA_FIELDS = ("law_name", "legal_status", "approval_date", "legal_type")


def metadata_filter(rows: DataFrame, filters: Mapping[str, Any], allowed: Sequence[str] = METADATA_FIELDS) -> DataFrame:
    """AND of ``field`` or ``field__lookup`` predicates; fields that are not allowed are ignored.

    Each becomes a column predicate, so the scan gets it.
    """
    for key, value in filters.items():
        field, _, lookup = key.partition("__")
        if field in allowed:
            if (lookup or "exact") not in _LOOKUPS:
                raise ValueError(f"unknown lookup {lookup!r}")
            rows = rows.where(_LOOKUPS[lookup or "exact"](F.col(field), value))
    return rows


def search_request(top_k: int = 10, min_score: float = 0.0, query: str = "", mode: str = "hybrid") -> dict:
    """A checked search request."""
    if not 1 <= top_k <= 50:
        raise ValueError("top_k must be from 1 to 50")
    if not 0 <= min_score <= 1:
        raise ValueError("min_score must be from 0 to 1")
    if not query.strip() or len(query) > 1000:
        raise ValueError("query must have from 1 to 1000 characters")
    if mode not in ("vector", "keyword", "hybrid"):
        raise ValueError("mode must be vector, keyword or hybrid")
    return {"top_k": top_k, "min_score": min_score, "query": query, "mode": mode}


def still_valid(expires: Column, now: Column) -> Column:
    return expires > now


# --- projections -----------------------------------------------------------------------

# fixed values: the columns of a search result
RESULT_FIELDS = (
    "chunk_id", "chunk_index", "page_start", "page_end", "content", "relevance_score", "token_count", "metadata", "legal_context",
)
#: fixed values: metadata keys shown with a source, and their captions
CONTEXT_KEYS = ("law_name", "kitab", "bakhsh", "fasl", "madde_raw")


def legal_context(metadata: Column, keys: Sequence[str] = CONTEXT_KEYS) -> Column:
    """Values of the metadata map that are there, joined by a bar."""
    present = F.filter(F.array(*(F.element_at(metadata, F.lit(k)) for k in keys)), lambda v: v.isNotNull() & (v != ""))
    return F.array_join(present, " | ")


def search_results(found: DataFrame) -> DataFrame:
    """The columns of a search result; those that ``found`` lacks are null, but for the context
    line, which comes from the metadata."""
    have = set(found.columns)
    made = {"legal_context": legal_context(F.col("metadata"))} if "metadata" in have else {}
    return found.select(*(F.col(c) if c in have else made.get(c, F.lit(None)).alias(c) for c in RESULT_FIELDS))


def preview(content: Column, n: int = 200) -> Column:
    return F.substring(content, 1, n)


def approval_date(text: Column) -> Column:
    """``yyyy/MM/dd`` or ``yyyy-MM-dd`` as a date; null where the calendar has no such day."""
    return F.try_to_date(F.regexp_replace(text, "-", "/"), "yyyy/MM/dd")


def embedding_input(content: Column, tables: Column) -> Column:
    """Content, then the semantic text of each table that has any."""
    texts = F.filter(F.transform(tables, lambda t: t["semantic_text"]), lambda t: t.isNotNull() & (t != ""))
    return F.concat_ws("\n\n", content, F.when(F.size(texts) > 0, F.array_join(texts, "\n\n")))


def merged_metadata(left: Column, right: Column) -> Column:
    """Map union in which the right side wins."""
    kept = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(kept, right)


def cache_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("\x1f", *parts))


# --- pages and top rows ----------------------------------------------------------------


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int, clamp: bool = True, total: int | None = None) -> DataFrame:
    """One page of an ordered table.

    With ``clamp`` a size is brought into 1..100 and a number past the end gives the last
    page; without, such a page is empty. ``total`` is the number of rows, counted here if the
    caller does not know it: a top-k plan sets aside room for all rows up to its offset, so
    an offset past the end must not reach it.
    """
    total = rows.count() if total is None else total
    if clamp:
        size = min(100, max(1, size))
        number = min(max(1, number), max(1, -(-total // size)))
    if (number - 1) * size >= total:
        return rows.limit(0)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def paginated(rows: DataFrame, order: Sequence[Column], number: int, size: int) -> dict:
    """A page with its surroundings: rows, total, pages, number, and whether others precede or follow."""
    total, size = rows.count(), min(100, max(1, size))
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    found = page(rows, order, number, size, total=total)
    return {"rows": found, "total": total, "pages": pages, "page": number, "size": size, "has_next": number < pages, "has_previous": number > 1}


def last_per_group(rows: DataFrame, by: Sequence[str], newest: Sequence[Column], n: int) -> DataFrame:
    """The n newest rows of each group, pruned in each partition before the shuffle."""
    w = W.partitionBy(*by).orderBy(*newest)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def upsert(existing: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Rows of both tables, for each key the one of the highest version (changes win ties).

    One union and one aggregation that keeps a struct, not a window over all versions.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rest = [c for c in existing.columns if c not in keys]
    newest = F.max(F.struct(F.col(version).alias("_v"), "_new", *rest)).alias("_row")
    return both.groupBy(*keys).agg(newest).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


# --- joins -----------------------------------------------------------------------------


def tables_of_chunks(chunks: DataFrame, tables: DataFrame, bucket: int = 16) -> DataFrame:
    """Range join: tables whose page lies in a chunk's page range, within a document.

    Chunks are listed under each bucket of pages they touch, so the join has equality keys
    (document, bucket) and a long document does not become one quadratic group.
    """
    touched = F.explode(F.sequence(F.expr(f"cast(page_start div {bucket} as bigint)"), F.expr(f"cast(page_end div {bucket} as bigint)")))
    wide = chunks.withColumn("_bucket", touched)
    narrow = tables.withColumn("_bucket", F.expr(f"cast(page div {bucket} as bigint)"))
    joined = wide.join(narrow, ["document_id", "_bucket"])
    return joined.where((F.col("page") >= F.col("page_start")) & (F.col("page") <= F.col("page_end"))).drop("_bucket")


def page_as_of(positions: DataFrame, markers: DataFrame, key: str = "document_id", bucket: int = 100_000) -> DataFrame:
    """As-of join: for each position the page of the last marker at or before it, else 1.

    Both sides fall into buckets of ``bucket`` positions, so a long document is many groups.
    Within one, the last marker seen is carried on; what a bucket ends with is carried to
    the next ones over a table of a row for each bucket that has markers.
    """
    at = F.expr(f"floor(pos / {bucket})").cast("long").alias("_bucket")
    left = positions.select(key, at, F.col("pos"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_page"), F.struct(*positions.columns).alias("_row"))
    right = markers.select(key, at, F.col("pos"), F.lit(0).alias("_side"), F.col("page").cast("long").alias("_page"))
    ends = right.groupBy(key, "_bucket").agg(F.max(F.struct("pos", "_page"))["_page"].alias("_page"))
    # a bucket starts with what the last one before it ended with
    wanted = left.select(key, "_bucket").distinct().withColumn("_page", F.lit(None).cast("long")).withColumn("_asks", F.lit(0))
    steps = wanted.unionByName(ends.withColumn("_asks", F.lit(1)))
    over = W.partitionBy(key).orderBy("_bucket", "_asks").rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = steps.withColumn("_page", F.last("_page", ignorenulls=True).over(over)).where("_asks = 0")
    lowest = F.lit(None).cast(positions.schema["pos"].dataType)
    first = starts.select(key, "_bucket", lowest.alias("pos"), F.lit(0).alias("_side"), "_page")
    none = F.lit(None).cast(left.schema["_row"].dataType).alias("_row")
    # nulls come first, so what a bucket starts with precedes its own markers
    w = W.partitionBy(key, "_bucket").orderBy("pos", "_side", "_page").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = left.unionByName(right.unionByName(first).select("*", none))
    seen = both.withColumn("page", F.coalesce(F.last("_page", ignorenulls=True).over(w), F.lit(1)))
    return seen.where("_side = 1").select("_row.*", "page")


def not_yet_imported(rows: DataFrame, existing: DataFrame, group: str, key: str) -> DataFrame:
    """Groups none of whose rows exist already (group-level anti join)."""
    known = rows.join(existing.select(key).distinct(), key, "left_semi").select(group).distinct()
    return rows.join(known, group, "left_anti")


def reject_groups_with_empty(rows: DataFrame, group: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows of groups without blank text, the rejected group keys)."""
    blank = ~F.coalesce(F.col(text), F.lit("")).rlike(r"\S")
    bad = rows.where(blank).select(group).distinct()
    return rows.join(bad, group, "left_anti"), bad


# --- aggregates ------------------------------------------------------------------------


def ordered_text(rows: DataFrame, by: Sequence[str], order: Sequence[str], text: str, sep: str = "\n\n") -> DataFrame:
    """Texts of each group joined in order."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(listed, lambda s: s["_t"]), sep).alias("content"))


def display_status(statuses: Column) -> Column:
    """Aggregate: failed, else cancelled, else processing, else completed; none: pending."""
    has = lambda s: F.bool_or(statuses == s)
    return (
        F.when(F.count(statuses) == 0, "pending")
        .when(has("failed"), "failed")
        .when(has("cancelled"), "cancelled")
        .when(has("running") | has("pending"), "processing")
        .when(F.bool_and(statuses == "completed"), "completed")
        .otherwise("processing")
    )


def progress_of(status: Column, progress: Column) -> Column:
    """What a task counts in the whole: its per cents while it runs or once it is completed,
    nothing when it failed, waits or was cancelled."""
    return F.when(status.isin("completed", "running"), F.coalesce(progress.cast("long"), F.lit(0))).otherwise(F.lit(0).cast("long"))


def overall_progress(status: Column, progress: Column) -> Column:
    """Aggregate: the mean of what tasks count (:func:`progress_of`), cut to a whole number; none: 0."""
    return F.coalesce(F.floor(F.sum(progress_of(status, progress)) / F.count("*")), F.lit(0)).cast("long")


def task_progress(processed: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(100)).otherwise(F.floor(100 * processed / total)).cast("int")


def healed_status(status: Column, task_key: Column, state: Column) -> Column:
    """What a running or pending task became, by the state its queue reports."""
    open_ = task_key.isNotNull() & status.isin("running", "pending")
    return F.when(open_ & (state == "FAILURE"), "failed").when(open_ & (state == "REVOKED"), "cancelled").otherwise(status)


def retryable(tasks: DataFrame, limit: int = 3) -> DataFrame:
    return tasks.where((F.col("status") == "failed") & (F.col("retry_count") < limit))


def not_running(requests: DataFrame, tasks: DataFrame, key: str = "document_id") -> DataFrame:
    """Requests for documents that are neither in work nor done."""
    busy = tasks.where(F.col("status").isin("running", "pending", "completed")).select(key).distinct()
    return requests.join(busy, key, "left_anti")


def with_failures(rows: DataFrame, failures: DataFrame, key: str, status: str = "status", error: str = "error") -> DataFrame:
    """Rows whose ``key`` is among ``failures`` (``key, message, at``) become failed.

    The latest message of a key counts. ``error`` and ``completed_at`` are set, other rows
    and columns stay.
    """
    last = failures.groupBy(key).agg(F.max(F.struct("at", "message")).alias("_f"))
    joined = rows.join(last, key, "left")
    hit = F.col("_f").isNotNull()
    new = {status: F.lit("failed"), error: F.col("_f.message"), "completed_at": F.col("_f.at")}
    names = [*rows.columns, *(c for c in new if c not in rows.columns)]
    old = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    return joined.select(*((F.when(hit, new[c]).otherwise(old(c)) if c in new else F.col(c)).alias(c) for c in names))


def milestone_line(document_id: Column, milestone: Column, extra: Column) -> Column:
    """``[id] milestone — key=value ...`` for the log of events; ``extra`` is a map, in its order."""
    pairs = F.transform(F.map_entries(extra), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None"))))
    said = F.when(F.size(extra) > 0, F.concat(F.lit(" — "), F.array_join(pairs, " "))).otherwise("")
    return F.concat(F.lit("["), document_id.cast("string"), F.lit("] "), milestone, said)
