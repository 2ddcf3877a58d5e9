"""Cleaning and packing a corpus: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnspark.llm import dart_minhash, line_dedup, packing, secrets, toxicity
from kilnspark.llm.common import documents, materialize, remove, scope


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, follows a changed text (null for a null text)."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go; null and empty texts stay."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one of them; no document goes.

    A null text stays null; rows with a null id stay as they are.
    """
    return _counted(line_dedup.without_repeated_lines(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, and every row with a null id.

    Texts without words are one class; of repeated rows one stays.
    """
    return dart_minhash.one_of_each_class(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the name of their kind; no document goes, a null text stays null."""
    return _counted(secrets.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised pieces and their places in sequences of 2048 tokens; a null text is empty."""
    return packing.best_fit_pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL cannot express the first stage, so not the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that stay.

    What a stage stores goes when its result is written, and that when the next one's is.
    """
    docs, written = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        with scope(spark) as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir)))
        if written:
            remove(spark, [written])
        written = docs._kiln_path
    return STAGES[-1][1](spark, docs, sf_dir)
