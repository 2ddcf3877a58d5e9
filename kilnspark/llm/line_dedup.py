"""Line deduplication with DataFrame functions only.

Lines are exploded with their position, normalised and hashed; documents are counted per
hash; lines of hashes found in too many documents go everywhere but in the smallest
document that holds them; the rest is put together again by position. Only hashes and
positions are exploded and shuffled, never the lines: a document's text moves once, to
meet the list of its dropped positions.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, most_frequent

MIN_CHARS = 10
MIN_DOCS = 2
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased (no other letters)."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.length(bare) == F.octet_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(
        F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    )


def dropped_positions(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, _row, dropped``: for each document that loses lines, their positions.

    ``docs`` has ``doc_id``, ``_row`` (tells rows of one id apart) and ``text``.
    """
    lines = (
        docs.where(F.col("doc_id").isNotNull())
        .select("doc_id", "_row", F.posexplode(lines_of(F.col("text"))).alias("_pos", "_line"))
        .select("doc_id", "_row", "_pos", line_key(F.col("_line")).alias("_key"))
        .where(F.length("_key") >= min_chars)
        # 128 bits: two hashes of different seeds
        .select("doc_id", "_row", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"))
    )
    keys = ["_h1", "_h2"]
    if min_docs == 2:
        # two documents hold a key exactly if the smallest and largest ids differ; this
        # combines on the map side, so a line that all documents share is no hot key
        ends = F.min("doc_id").alias("_keep"), F.max("doc_id").alias("_last")
        counted = lines.groupBy(*keys).agg(*ends, F.count("*").alias("_n"))
        repeats = (F.col("_keep") < F.col("_last")) & (F.col("_n") > 1)
    else:
        once = lines.groupBy(*keys, "doc_id").agg(F.count("*").alias("_n"))
        counted = once.groupBy(*keys).agg(F.min("doc_id").alias("_keep"), F.count("*").alias("_last"), F.sum("_n").alias("_n"))
        repeats = (F.col("_last") >= min_docs) & (F.col("_n") > 0)
    # the most frequent keys are broadcast; their lines are spread evenly over the join that
    # finds the others, where they match nothing
    hot = most_frequent(counted.select(*keys, "_n", F.when(repeats, F.col("_keep")).alias("_hot"), F.lit(True).alias("_is_hot")), "_n")
    lines = lines.join(hot.drop("_n"), keys, "left")
    spread = F.xxhash64("doc_id", "_row", "_pos")
    lines = lines.withColumns({k: F.when(F.col("_is_hot"), spread).otherwise(F.col(k)) for k in keys})
    joined = lines.join(counted.where(repeats).select(*keys, "_keep"), keys, "left")
    keep = F.when(F.col("_is_hot"), F.col("_hot")).otherwise(F.col("_keep"))
    return (
        joined.where(F.col("doc_id") != keep)
        .groupBy("doc_id", "_row")
        .agg(F.sort_array(F.collect_set("_pos")).alias("dropped"))
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once: what a lambda refers to is otherwise
    evaluated for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(lines: Column, dropped: Column) -> Column:
    """``lines`` without the ascending positions ``dropped``, in time linear in both."""

    def kept(held: Column) -> Column:
        edges = F.concat(F.array(F.lit(-1)), held["dropped"], F.array(F.size(held["lines"])))
        return let(
            F.struct(held["lines"].alias("lines"), edges.alias("edges")),
            lambda h: F.flatten(
                F.transform(
                    F.sequence(F.lit(1), F.size(h["edges"]) - 1),
                    lambda i: F.slice(
                        h["lines"],
                        F.element_at(h["edges"], i) + 2,
                        F.element_at(h["edges"], i + 1) - F.element_at(h["edges"], i) - 1,
                    ),
                )
            ),
        )

    return let(F.struct(lines.alias("lines"), dropped.alias("dropped")), kept)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` for each row of ``docs``.

    A key of at least ``min_chars`` code points found in at least ``min_docs`` documents
    stays only in the smallest doc_id that holds it (there, all its lines stay). Null or
    empty text is one empty line. Rows with a null doc_id come back unchanged and count
    as no document. Repeated rows count as one document and are each returned. Other
    columns of ``docs`` play no part.
    """
    rows = id_text(docs).withColumn("_row", F.xxhash64("text"))
    gone = dropped_positions(rows, min_docs, min_chars)
    # building the hash table on the short lists spares sorting the texts
    joined = rows.join(gone.hint("shuffle_hash"), ["doc_id", "_row"], "left")
    n_dropped = F.coalesce(F.size("dropped"), F.lit(0))
    kept = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(
        F.array_join(without(lines_of(F.col("text")), F.col("dropped")), "\n")
    )
    return joined.select(
        "doc_id",
        (F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"))) + 1).cast("long").alias("n_lines"),
        n_dropped.cast("long").alias("n_dropped"),
        kept.alias("kept"),
    )


def without_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with all its columns, ``text`` without the lines that :func:`dedup_lines` drops.

    A text that loses every line becomes empty; a null text stays null.
    """
    rows = id_text(docs).withColumn("_row", F.xxhash64("text"))
    gone = dropped_positions(rows, min_docs, min_chars).select(
        F.col("doc_id").alias("_kiln_id"), F.col("_row").alias("_kiln_row"), F.col("dropped").alias("_kiln_dropped")
    )
    keyed = docs.withColumns(
        {"_kiln_id": docs["doc_id"].cast("long"), "_kiln_row": F.xxhash64(F.coalesce(docs["text"], F.lit("")))}
    )
    joined = keyed.join(gone.hint("shuffle_hash"), ["_kiln_id", "_kiln_row"], "left")
    kept = F.when(F.col("_kiln_dropped").isNull(), F.col("text")).otherwise(
        F.array_join(without(lines_of(F.col("text")), F.col("_kiln_dropped")), "\n")
    )
    return joined.select(*(kept.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns))
