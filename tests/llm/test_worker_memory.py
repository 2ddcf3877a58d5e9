"""What a Python worker keeps between tasks, and what goes to it."""

import weakref

import public_tokenizers
import pyarrow as pa

from kilnspark.llm import common, packing, secrets


def test_a_worker_keeps_the_cache_of_one_operator():
    encoder = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.encoder(public_tokenizers.path("byte_bpe_50k.json")) is encoder
    gone = weakref.ref(encoder)
    del encoder
    assert common.held("another", list) == [] and gone() is None


def test_memory_is_given_back_batch_by_batch(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(len(seen)))
    seen = []
    for part in common.slices([pa.record_batch([range(5)], names=["x"])] * 3, 2):
        seen += part.column(0).to_pylist()
    assert seen == [*range(5)] * 3 and calls == [2, 7, 12, 15]


def test_only_texts_with_spans_are_cut_in_python(spark):
    docs = spark.createDataFrame([(i, "nothing here" if i else "password = abcdefgh12") for i in range(50)], "doc_id long, text string")
    plan = secrets.redact(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "cut(CASE WHEN isnotnull(_kiln_spans" in plan
    found = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert found == {i: "nothing here" if i else "[ASSIGN]" for i in range(50)}
