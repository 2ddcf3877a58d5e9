"""Streams with typed state and timers against their batch forms; cached embeddings; counted writes."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kilnspark.operators.embedding_cache import cached_embeddings, read_cache
from kilnspark.sources import sinks
from kilnspark.streaming import state


def run(rows, target, checkpoint):
    """What is new in ``rows`` goes to ``target``, a folder for each batch."""
    write = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(target)
    query = rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert query.awaitTermination(60)


MESSAGES = "conv_id long, turn int, facts map<string,string>"
TOLD = [
    (1, 0, {"name": "a", "sum": "10"}), (1, 2, {"sum": "30"}), (1, 1, {"sum": "20", "place": "x"}), (1, 2, {"sum": "31"}),
    (2, None, {"name": "b"}), (2, 0, {"name": None, "place": "y"}), (2, 0, {}), (3, 5, None), (1, 2, {"sum": "31"}),
]


@pytest.mark.parametrize("order", [1, -1])
def test_facts_in_any_order(spark, tmp_path, order):
    said, out, point = (str(tmp_path / n) for n in ("in", "out", "point"))
    stream = None
    for i, part in enumerate((TOLD[::order][:3], TOLD[::order][3:6], TOLD[::order][6:])):
        spark.createDataFrame(part, MESSAGES).coalesce(1).write.mode("append").parquet(said)
        stream = spark.readStream.schema(MESSAGES).parquet(said)
        run(state.fact_stream(stream), out, point)
    made = spark.read.parquet(out).groupBy("conv_id", "name").agg(F.max_by(F.struct("turn", "value"), F.struct("batch", "turn", "value")).alias("h"))
    got = sorted(map(tuple, made.select("conv_id", "name", "h.turn", "h.value").collect()))
    want = sorted(map(tuple, state.merged_facts(spark.createDataFrame(TOLD, MESSAGES)).collect()))
    assert got == want == [(1, "name", 0, "a"), (1, "place", 1, "x"), (1, "sum", 2, "31"), (2, "name", -1, "b"), (2, "place", 0, "y")]


def test_idle_conversations_are_forgotten(spark, tmp_path):
    said, out, point = (str(tmp_path / n) for n in ("in", "out", "point"))
    for part in ([(1, 5, {"sum": "10"})], [(2, 0, {"sum": "7"})], [(1, 0, {"sum": "1"})]):
        spark.createDataFrame(part, MESSAGES).coalesce(1).write.mode("append").parquet(said)
        # timers of processing time ask for batches without data for ever, which "available now" would wait for
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", False)
        try:
            run(state.fact_stream(spark.readStream.schema(MESSAGES).parquet(said), idle=1), out, point)
        finally:
            spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
        time.sleep(0.1)
    rows = {tuple(r) for r in spark.read.parquet(out).select("conv_id", "turn", "value", "expired").collect()}
    assert {(1, 5, "10", False), (1, 5, "10", True), (1, 0, "1", False)} <= rows  # turn 0 counts: turn 5 is forgotten


EVENTS = "task_id long, ts timestamp, status string"


def test_silent_tasks_fail(spark, tmp_path):
    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    batches = [
        [(1, at(0), "running"), (2, at(1), "completed"), (3, at(2), "running"), (None, at(2), "running"), (4, at(2), "pending")],
        [(3, at(50), "running"), (4, at(59), "running"), (4, at(59), "pending")],
        [(5, at(120), "running")],
        [(6, at(121), "running"), (5, None, "failed")],
    ]
    said, out, point = (str(tmp_path / n) for n in ("in", "out", "point"))
    for part in batches:
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(said)
        run(state.stall_stream(spark.readStream.schema(EVENTS).parquet(said)), out, point)
    last = spark.read.parquet(out).groupBy("task_id").agg(F.max_by(F.struct("last_us", "status"), F.struct("batch", "last_us", F.col("status") == "failed")).alias("h"))
    got = sorted(map(tuple, last.select("task_id", "h.last_us", "h.status").collect()))
    want = sorted(map(tuple, state.stalled(spark.createDataFrame([r for b in batches for r in b], EVENTS)).collect()))
    assert got == want
    assert [(k, s) for k, _, s in got] == [(1, "failed"), (2, "completed"), (3, "failed"), (4, "failed"), (5, "running"), (6, "running")]


def test_state_of_nothing(spark):
    assert state.merged_facts(spark.createDataFrame([], MESSAGES)).count() == 0
    assert state.stalled(spark.createDataFrame([], EVENTS)).count() == 0


def counting(folder, refused=()):
    """An embedder that writes down what it is sent, a file for each call, and refuses some texts."""

    def embed(texts):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        if set(texts) & set(refused):
            raise OSError("refused")
        return [[float(len(t))] for t in texts]

    return embed


def sent(folder):
    return sorted(t for f in folder.iterdir() for t in f.read_text().split("\n"))


def test_each_text_is_sent_once(spark, tmp_path):
    (tmp_path / "sent").mkdir()
    embed, cache = counting(str(tmp_path / "sent")), str(tmp_path / "cache")
    rows = [(1, "a"), (2, "bb"), (3, "a"), (4, None), (5, " "), (6, "bb"), (6, "ccc")]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string").withColumn("embedding", F.lit("other"))
    first = cached_embeddings(chunks.where("chunk_id < 6"), embed, cache, now=1)
    assert sent(tmp_path / "sent") == ["a", "bb"]
    made = cached_embeddings(chunks, embed, cache, now=2)
    assert sent(tmp_path / "sent") == ["a", "bb", "ccc"]
    got = sorted(((r.chunk_id, r.embedding, r.error, r.made_at) for r in made.collect()), key=str)
    assert got == [(1, [1.0], None, 1), (2, [2.0], None, 1), (3, [1.0], None, 1), (4, None, None, None), (5, None, None, None), (6, [2.0], None, 1), (6, [3.0], None, 2)]
    assert first.count() == 5
    cached_embeddings(chunks, embed, cache, now=9, keep=7)  # what was made at 1 has expired
    assert sent(tmp_path / "sent") == ["a", "a", "bb", "bb", "ccc"]
    cached_embeddings(chunks, embed, cache, model="other", now=9)
    assert len(sent(tmp_path / "sent")) == 8


def test_failed_calls_lose_nothing_else(spark, tmp_path):
    (tmp_path / "sent").mkdir()
    cache = str(tmp_path / "cache")
    chunks = spark.createDataFrame([(i, "x" * i) for i in range(1, 9)], "chunk_id long, content string").coalesce(1)
    made = cached_embeddings(chunks, counting(str(tmp_path / "sent"), {"xxx"}), cache, now=1, batch=1).orderBy("chunk_id").collect()
    assert [r.embedding for r in made] == [None if i == 3 else [float(i)] for i in range(1, 9)]
    assert made[2].error == "OSError: refused" and {r.error for r in made if r.chunk_id != 3} == {None}
    (tmp_path / "again").mkdir()
    embed = counting(str(tmp_path / "again"))
    again = cached_embeddings(chunks, embed, cache, now=2).orderBy("chunk_id").collect()
    assert sent(tmp_path / "again") == ["xxx"] and again[2].embedding == [3.0] and again[2].error is None
    assert read_cache(spark, cache).count() == 9


def test_counted_append(spark, tmp_path):
    rows = [(1, "a", "h"), (2, " ", "h"), (3, None, "g"), (4, "b", None), (5, "c", "g")]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string, hub_type string")
    path = str(tmp_path / "chunks")
    assert sinks.append_counted(chunks, path) == {"total": 5, "imported": 3, "skipped": 2, "without_hub": 1}
    assert sorted(r.chunk_id for r in spark.read.parquet(path).collect()) == [1, 4, 5]
    assert sinks.append_counted(chunks.where("false"), path) == {"total": 0, "imported": 0, "skipped": 0, "without_hub": 0}
