"""Chunking as a table function, for SQL.

After :func:`register`, ``SELECT * FROM page_windows(TABLE(pages), 400, 50)`` cuts documents
that come as rows of pages into windows of tokens that cross the borders of pages.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegralType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class PageWindows:
    """``document_id, window, n_tokens, first_page, last_page, content`` of the table argument
    ``document_id, page, tokens`` (other columns play no part).

    A window starts every ``size - overlap`` tokens, unless all its tokens were in the one
    before. The pages of a document come to one task in order, which holds one window at a
    time, so neither the document nor a list of its tokens is put together. Null tokens are
    none; a document without tokens has no window; pages of one number keep any order.
    """

    def __init__(self) -> None:
        self.held: list[tuple[str, int]] = []
        self.key, self.window, self.overlap = None, 0, 0

    @staticmethod
    def analyze(pages: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        if not pages.isTable:
            raise ValueError("the first argument must be a table")
        given = {f.name: f.dataType for f in pages.dataType.fields}
        if missing := [c for c in ("document_id", "page", "tokens") if c not in given]:
            raise ValueError(f"the table has no column {', '.join(missing)}")
        if not isinstance(given["tokens"], ArrayType) or not isinstance(given["page"], IntegralType):
            raise ValueError("tokens must be an array and page an integer")
        if not (isinstance(size.value, int) and isinstance(overlap.value, int) and 0 <= overlap.value < size.value):
            raise ValueError("size and overlap must be constants with 0 <= overlap < size")
        schema = StructType().add("document_id", given["document_id"]).add("window", LongType()).add("n_tokens", LongType())
        schema = schema.add("first_page", LongType()).add("last_page", LongType()).add("content", StringType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("document_id")], orderBy=[OrderingColumn("page")])

    def _cut(self, n: int) -> tuple:
        taken = self.held[:n]
        made = (self.key, self.window, len(taken), taken[0][1], taken[-1][1], " ".join(t for t, _ in taken))
        self.window += 1
        return made

    def eval(self, pages: Row, size: int, overlap: int) -> Iterator[tuple]:
        self.key, self.overlap = pages["document_id"], overlap
        at = 0
        tokens = pages["tokens"] if pages["tokens"] is not None else ()
        while at < len(tokens):
            room = size - len(self.held)
            self.held += [(t, pages["page"]) for t in tokens[at : at + room]]
            at += room
            if len(self.held) == size:
                yield self._cut(size)
                self.held = self.held[size - overlap :]

    def terminate(self) -> Iterator[tuple]:
        if len(self.held) > (self.overlap if self.window else 0):
            yield self._cut(len(self.held))


def register(spark: SparkSession) -> None:
    spark.udtf.register("page_windows", udtf(PageWindows))
