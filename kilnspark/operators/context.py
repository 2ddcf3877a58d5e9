"""Packing sources into a bounded context, and resolving the citations of an answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..stored import stored

BUDGET_TOKENS = 4000
CHARS_PER_TOKEN = 4
HUB_ORDER = ("legislation", "judicial_precedent", "advisory_opinion")


def source_header(number: Column, page_start: Column, page_end: Column, legal: Column) -> Column:
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    pages = F.concat(F.lit("[Source "), number.cast("string"), F.lit(" | Pages "), shown(page_start), F.lit("-"), shown(page_end))
    return F.concat(pages, F.when(F.coalesce(legal, F.lit("")) != "", F.concat(F.lit(" | "), legal)).otherwise(""), F.lit("]"))


def packed_parts(chunks: DataFrame, by: Sequence[str] = ("query_id",), order: str = "rank", budget: int = BUDGET_TOKENS * CHARS_PER_TOKEN) -> DataFrame:
    """The parts that fit, in order: a running sum finds the first overflow, which is cut.

    ``chunks`` has the ``by`` columns, ``rank``, ``content``, ``page_start``, ``page_end`` and
    ``legal_context``. The cost of a part is its header, a line break and its content; the
    blank lines between parts are free. A cut that leaves no content drops the part.
    """
    ranked = W.partitionBy(*by).orderBy(order)
    rows = chunks.withColumn("n", F.row_number().over(ranked))
    rows = rows.withColumn("header", source_header(F.col("n"), F.col("page_start"), F.col("page_end"), F.col("legal_context")))
    rows = rows.withColumn("_cost", F.length("header") + 1 + F.length("content"))
    rows = rows.withColumn("_end", F.sum("_cost").over(ranked.rowsBetween(W.unboundedPreceding, W.currentRow)))
    # rows that start inside the budget are all those up to and with the first overflow
    rows = rows.where(F.col("_end") - F.col("_cost") < budget)
    left = F.greatest(F.lit(0), budget - (F.col("_end") - F.col("_cost")) - F.length("header") - 1)
    cut = F.when(F.col("_end") <= budget, F.col("content")).otherwise(F.substring(F.col("content"), F.lit(1), left.cast("int")))
    rows = rows.withColumn("content", cut).where((F.col("_end") <= budget) | (F.length("content") > 0))
    return rows.select(*by, "n", F.concat("header", F.lit("\n"), "content").alias("part"))


def build_context(chunks: DataFrame, by: Sequence[str] = ("query_id",), order: str = "rank", budget: int = BUDGET_TOKENS * CHARS_PER_TOKEN) -> DataFrame:
    """One context string for each query."""
    parts = packed_parts(chunks, by, order, budget)
    listed = F.array_sort(F.collect_list(F.struct("n", "part")))
    return parts.groupBy(*by).agg(F.array_join(F.transform(listed, lambda s: s["part"]), "\n\n").alias("context"))


def build_global_context(chunks: DataFrame, hub_order: Sequence[str] = HUB_ORDER, labels: dict[str, str] | None = None, budget: int = BUDGET_TOKENS * CHARS_PER_TOKEN) -> DataFrame:
    """One context for each ``query_id`` over several hubs, in fixed order with one numbering.

    A hub's title and each of its parts cost their length and 2. The parts of a hub are taken
    while they fit; the first that does not is cut to what is left and ends the hub. A title
    that does not fit leaves its hub out. What hubs before have used and numbered is carried
    from hub to hub as a small table, so every step is a running sum over one hub's rows.
    """
    by, carried = ["query_id"], ["_used", "_seen", "context"]
    chunks = stored(chunks.where(F.col("hub_type").isin(list(hub_order))))  # a few rows for each question and hub, which every hub reads
    state = chunks.select(*by).distinct()
    state = state.withColumns({"_used": F.lit(0).cast("long"), "_seen": F.lit(0).cast("long"), "context": F.lit("")})
    in_order = W.partitionBy(*by).orderBy("rank")
    for hub in hub_order:
        title = f"=== [{(labels or {}).get(hub, hub)}] ==="
        start = F.col("_used") + len(title) + 2
        rows = state.join(chunks.where(F.col("hub_type") == hub), by, "left")
        rows = rows.withColumns({"_fits": F.col("rank").isNotNull() & (start <= budget), "n": F.col("_seen") + F.row_number().over(in_order)})
        rows = rows.withColumn("_header", source_header(F.col("n"), F.col("page_start"), F.col("page_end"), F.col("legal_context")))
        rows = rows.withColumn("_cost", F.length("_header") + 3 + F.length("content"))
        rows = rows.withColumn("_end", start + F.sum("_cost").over(in_order.rowsBetween(W.unboundedPreceding, W.currentRow)))
        # all up to and with the first overflow; the room it leaves is what its text may fill
        room = F.least(F.length("content"), F.lit(budget) - (F.col("_end") - F.col("_cost")) - F.length("_header") - 3).cast("int")
        rows = rows.withColumn("_room", room)
        kept = F.col("_fits") & (F.col("_end") - F.col("_cost") < budget) & ((F.col("_room") > 0) | (F.col("_end") <= budget))
        line = F.concat(F.lit("\n"), "_header", F.lit("\n"), F.substring(F.col("content"), F.lit(1), F.col("_room")))
        lines = F.array_sort(F.collect_list(F.when(kept, F.struct("n", line.alias("line")))))  # no more than fits the budget
        told = rows.groupBy(*by, *carried).agg(
            F.bool_or("_fits").alias("_titled"),
            F.coalesce(F.sum(F.when(kept, F.length("_header") + 3 + F.col("_room"))), F.lit(0)).alias("_more"),
            F.coalesce(F.max(F.when(kept, F.col("n"))), F.col("_seen")).alias("_last"),
            lines.alias("_lines"),
        )
        apart = F.when(F.col("context") == "", "").otherwise("\n\n")
        section = F.concat("context", apart, F.lit(title), F.array_join(F.transform("_lines", lambda s: s["line"]), ""))
        state = told.select(
            *by,
            F.when(F.col("_titled"), start + F.col("_more")).otherwise(F.col("_used")).alias("_used"),
            F.col("_last").alias("_seen"),
            F.when(F.col("_titled"), section).otherwise(F.col("context")).alias("context"),
        )
    return state.select(*by, "context")


def cited_numbers(answer: Column) -> Column:
    """Distinct ``[Source N]`` numbers of an answer, ascending."""
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[Source (\d+)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: n.cast("int"))))


def resolve_citations(answers: DataFrame, chunks: DataFrame, by: Sequence[str] = ("query_id",), order: str = "rank") -> DataFrame:
    """Chunks that each answer cites by position; numbers out of range find nothing."""
    cited = answers.select(*by, F.explode(cited_numbers(F.col("answer"))).alias("n"))
    numbered = chunks.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy(order)))
    return cited.join(numbered, [*by, "n"])
