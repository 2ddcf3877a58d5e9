"""Building and merging a word index shuffles texts, not their postings."""

import uuid

import pytest

from kilnspark.operators import retrieval, text_index as ti

WORDS = [f"w{n}" for n in range(200)]


def shuffled(spark) -> int:
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)
    stages = store.stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def chunks(spark, ids, words=WORDS):
    return spark.createDataFrame([(n, " ".join(words)) for n in ids], "chunk_id long, content string")


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def postings(spark, path):
    index = ti.read_word_index(spark, path).selectExpr("term", "inline(arrays_zip(ids, counts, places))")
    return sorted(map(tuple, index.collect()))


def test_only_texts_are_shuffled(spark, path):
    before = shuffled(spark)
    ti.write_word_index(chunks(spark, range(40)), path, block_chars=2000)
    assert shuffled(spark) - before < 200  # of 8000 postings
    assert postings(spark, path) == sorted((w, n, 1, [at]) for n in range(40) for at, w in enumerate(WORDS))


def test_merge_shuffles_no_posting_and_takes_a_batch_name_twice(spark, path):
    ti.write_word_index(chunks(spark, range(40)), path, block_chars=2000)
    before, old = shuffled(spark), path
    for n, ids in enumerate([range(5), range(3, 8)]):  # the second merge has the name of the first, and replaces some of its chunks
        new = f"{path}-{n}"
        ti.merge_word_index(spark, old, chunks(spark, ids, [f"n{n}", "w0", "w0"]), new, batch="1", block_chars=2000)
        old = new
    assert shuffled(spark) - before < 2 * 1000
    merged = {c: "n0" for c in range(3)} | {c: "n1" for c in range(3, 8)}
    want = [(w, n, 1, [at]) for n in range(8, 40) for at, w in enumerate(WORDS)]
    want += [row for c, own in merged.items() for row in ((own, c, 1, [0]), ("w0", c, 2, [1, 2]))]
    assert postings(spark, old) == sorted(want)
    index = ti.read_word_index(spark, old)
    assert index.groupBy("term", "block").count().where("count > 1").count() == 0


def test_hits_of_asked_words_are_not_shuffled_again(spark):
    asked = spark.createDataFrame([(0, WORDS[:20]), (1, WORDS[10:30])], "query_id long, terms array<string>")
    index = retrieval.postings(chunks(spark, range(40)), asked=asked)
    start = shuffled(spark)
    assert index.count() == 40 * 30
    listed = shuffled(spark)
    assert retrieval.keyword_matches(index, asked).count() == 80
    assert shuffled(spark) - listed < listed - start + 100
