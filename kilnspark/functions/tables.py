"""Tables as arrays of rows of nullable cells: Markdown and semantic text, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def _clean(table: Column) -> Column:
    return F.transform(table, lambda row: F.transform(row, lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+\z", "")))


def table_markdown(table: Column) -> Column:
    """A Markdown table, cells padded to the widest of their column (three at least).

    Empty for a null or empty table or an empty first row.
    """
    return let(_clean(table), _markdown)


def _markdown(rows: Column) -> Column:
    columns = F.sequence(F.lit(1), F.size(F.element_at(rows, 1)))
    width = lambda i: F.greatest(F.array_max(F.transform(rows, lambda r: F.coalesce(F.length(F.try_element_at(r, i)), F.lit(0)))), F.lit(3))
    empty = F.coalesce(F.size(rows) <= 0, F.lit(True)) | F.coalesce(F.size(F.try_element_at(rows, F.lit(1))) <= 0, F.lit(True))
    return F.when(empty, F.lit("")).otherwise(let(F.transform(columns, width), lambda widths: _padded(rows, widths)))


def _padded(rows: Column, widths: Column) -> Column:
    pad = lambda c, w: F.concat(c, F.repeat(F.lit(" "), F.greatest(w - F.length(c), F.lit(0))))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    padded = lambda row: line(F.transform(row, lambda c, i: pad(c, F.coalesce(F.try_element_at(widths, i + 1), F.lit(3)))))
    rule = line(F.transform(widths, lambda w: F.repeat(F.lit("-"), w)))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), padded)
    return F.array_join(F.concat(F.array(padded(F.element_at(rows, 1)), rule), body), "\n")


def table_semantic_text(table: Column) -> Column:
    """``key: value`` pairs of each row after the header; a lone row lists its cells."""
    rows = _clean(table)
    head = F.element_at(rows, 1)
    pairs = lambda row: F.filter(
        F.transform(row, lambda c, i: F.when((c != "") & (F.coalesce(F.try_element_at(head, i + 1), F.lit("")) != ""), F.concat(F.try_element_at(head, i + 1), F.lit(": "), c))),
        lambda p: p.isNotNull(),
    )
    lines = F.filter(F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.array_join(pairs(r), " | ")), lambda x: x != "")
    alone = F.array_join(F.filter(head, lambda c: c != ""), " | ")
    empty = F.coalesce(F.size(table) <= 0, F.lit(True)) | F.coalesce(F.size(F.try_element_at(table, F.lit(1))) <= 0, F.lit(True))
    return F.when(empty, F.lit("")).when(F.size(table) == 1, alone).otherwise(F.array_join(lines, "\n"))
