"""Embeddings kept by the text they were made of, so that each distinct text is sent once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .models import Embedder, embed_texts

SCHEMA = "model string, text_hash string, embedding array<float>, error string, made_at long"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a cache, none where it does not exist yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def _latest(rows: DataFrame, model: str, since: int | None) -> DataFrame:
    """One row per text: its latest vector, or the latest error if it has none."""
    rows = rows.where(F.col("model") == model)
    # an expired vector counts no more, nor does an error beside a vector
    rows = rows if since is None else rows.where(F.col("made_at") >= since)
    rank = F.struct(F.col("embedding").isNotNull(), "made_at")
    return rows.groupBy("text_hash").agg(F.max_by(F.struct("embedding", "error", "made_at"), rank).alias("held"))


def cached_embeddings(chunks: DataFrame, embedder: Embedder, path: str, model: str = "default", now: int = 0, keep: int | None = None,
                      text: str = "content", key: str = "chunk_id", batch: int = 8) -> DataFrame:
    """``key, embedding, error, made_at`` of all chunks, by way of the cache in ``path``.

    Texts without a vector of ``model`` made at ``now - keep`` or later are sent, each distinct
    text once however many chunks hold it, in calls of ``batch``; what comes back is appended
    to the cache as one job. A call that fails leaves an error for its texts and nothing else:
    vectors of other calls stay, and the next run sends the texts without one again. Null and
    blank texts are not sent and have neither vector nor error; repeated keys keep their rows.
    A task that is lost is run again and sends its texts again.
    """

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple] = []
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                try:
                    out += [(h, v, None) for h, v in zip(part["text_hash"], embed_texts(embedder, part["said"].tolist(), batch))]
                except Exception as e:  # noqa: BLE001
                    out += [(h, None, f"{type(e).__name__}: {e}") for h in part["text_hash"]]
            yield pd.DataFrame(out, columns=["text_hash", "embedding", "error"])

    since = None if keep is None else now - keep
    blank = ~F.coalesce(F.col(text), F.lit("")).rlike(r"\S")
    hashed = chunks.select(F.col(key), F.col(text).alias("said"), F.when(~blank, F.sha2(F.col(text), 256)).alias("text_hash"))
    held = _latest(read_cache(chunks.sparkSession, path), model, since).where("held.embedding IS NOT NULL")
    # hashes meet the cache before texts are shuffled; equal texts combine within their partition
    wanted = hashed.where("text_hash IS NOT NULL").join(held.select("text_hash"), "text_hash", "left_anti")
    wanted = wanted.groupBy("text_hash").agg(F.first("said").alias("said"))
    made = wanted.mapInPandas(send, "text_hash string, embedding array<float>, error string")
    made.select(F.lit(model).alias("model"), "text_hash", "embedding", "error", F.lit(now).cast("long").alias("made_at")).write.mode("append").parquet(path)
    found = _latest(read_cache(chunks.sparkSession, path), model, since)
    return hashed.drop("said").join(found, "text_hash", "left").select(key, "held.embedding", "held.error", "held.made_at")
