"""Writing chunk tables: append, one-hub reload, and vectors put in later."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import fts_normalize, normalize


def with_search_text(chunks: DataFrame, content: str = "content") -> DataFrame:
    """Chunks with ``search_text``, the form that keyword search reads, worked out at write.

    Writers call this on every chunk they write or change, so the column follows the content.
    """
    return chunks.withColumn("search_text", fts_normalize(F.col(content)))


def backfilled(chunks: DataFrame, content: str = "content") -> DataFrame:
    """All chunks with normalised content and search text; one scan, so none is passed over."""
    return with_search_text(chunks.withColumn(content, normalize(F.col(content))), content)


def append_chunks(chunks: DataFrame, path: str, hub: str = "hub_type") -> None:
    """Append, partitioned by hub; the job commits as a whole."""
    chunks.write.mode("append").partitionBy(hub).parquet(path)


def append_counted(chunks: DataFrame, path: str, content: str = "content", hub: str = "hub_type") -> dict[str, int]:
    """:func:`append_chunks` of the chunks with text; ``total, imported, skipped, without_hub``.

    The counters come out of the pass that writes, so the chunks are read once. A chunk of
    null or blank text is skipped; one without hub is imported and counted apart.
    """
    blank = ~F.coalesce(F.col(content), F.lit("")).rlike(r"\S")
    seen = Observation()
    counted = chunks.observe(
        seen, F.count("*").alias("total"), F.count_if(~blank).alias("imported"), F.count_if(blank).alias("skipped"), F.count_if(~blank & F.col(hub).isNull()).alias("without_hub")
    )
    append_chunks(counted.where(~blank), path, hub)
    return seen.get


def reload_hubs(chunks: DataFrame, path: str, hub: str = "hub_type") -> None:
    """Replace the hubs that ``chunks`` holds and leave the other partitions alone."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(hub).parquet(path)


def with_vectors(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks with new vectors where there are any (joined by key, never by position)."""
    new = vectors.select(key, F.col("embedding").alias("_new"))
    return chunks.join(new, key, "left").withColumn("embedding", F.coalesce("_new", "embedding")).drop("_new")


def without_documents(rows: DataFrame, removed: DataFrame, key: str = "document_id") -> DataFrame:
    """What a cascading delete leaves."""
    return rows.join(removed.select(key).distinct(), key, "left_anti")
