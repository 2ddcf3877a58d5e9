import itertools
import random

import plain_chunkers
import pytest
from pyspark.sql import functions as F

from kilnspark.operators import chunking, context, models, relational, retrieval

CHUNKS = [(1, [1.0, 0.1], "ماده 22 قانون مدنی", "قانون مدنی"), (2, [1.0, 0.5], "قانون مجازات اسلامی", "قانون مجازات"), (3, [0.01, 1.0], "x", None), (4, None, "", None)]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id int, embedding array<double>, content string, law_name string")


def ids(rows):
    return [r["chunk_id"] for r in rows.collect()]


def test_vector_search(chunks):
    found = retrieval.vector_search(chunks, [1.0, 0.0], 10).collect()
    assert [r.chunk_id for r in found] == [1, 2, 3]
    assert found[0].score == pytest.approx(0.995037, abs=1e-6) and found[1].score == pytest.approx(0.894427, abs=1e-6)
    assert ids(retrieval.vector_search(chunks, [1.0, 0.0], 1)) == [1]
    assert ids(retrieval.vector_search(chunks, [1.0, 0.0], 10, min_score=0.9)) == [1]
    assert ids(retrieval.vector_search(chunks.limit(0), [1.0, 0.0], 5)) == []
    with pytest.raises(ValueError):
        retrieval.vector_search(chunks, [1.0], 5, width=2)


def test_keyword_search(chunks):
    assert ids(retrieval.keyword_search(chunks, "مدنی", 5)) == [1]
    assert ids(retrieval.keyword_search(chunks, "nonexistenttermxyz", 5)) == []
    assert ids(retrieval.keyword_search(chunks, "", 5)) == []
    assert ids(retrieval.keyword_search(chunks, "از در", 5, stop_words=("از", "در"))) == []
    assert ids(relational.metadata_filter(retrieval.keyword_search(chunks, "قانون", 5), {"law_name": "قانون مدنی"})) == [1]
    assert sorted(ids(retrieval.keyword_search(chunks, '"قانون مدنی" or اسلامی', 5))) == [1, 2]
    assert ids(retrieval.keyword_search(chunks, "قانون -مدنی", 5)) == [2]


def test_trigram_search(chunks):
    assert ids(retrieval.trigram_search(chunks, "مدنی", 5, 0.1)) == [1]


def ranked(spark, rows):
    return spark.createDataFrame([(0, c, float(s)) for c, s in rows], "query_id int, chunk_id string, score double")


def test_fusion(spark):
    a, b = ranked(spark, [("A", 0.9), ("B", 0.8), ("C", 0.1)]), ranked(spark, [("B", 0.8), ("D", 0.5)])
    got = retrieval.rank_fusion([a, b], [3, 1], 3, ["vector", "keyword"]).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["B", "A", "C"]
    assert [r.relevance_score for r in got] == pytest.approx([0.064781, 0.04918, 0.047619], abs=1e-6)
    assert (got[0].vector_score, got[0].keyword_score, got[1].keyword_score) == (0.8, 0.8, 0.0)
    assert retrieval.rank_fusion([a.limit(0), b], [1, 1], 5, ["vector", "keyword"]).first().vector_score == 0.0


def test_fusion_ties_keep_first_seen(spark):
    a, b = ranked(spark, [("Z", 1)]), ranked(spark, [("A", 1)])
    assert [r.chunk_id for r in retrieval.rank_fusion([a, b], [1, 1], 5, ["x", "y"]).orderBy("rank").collect()] == ["Z", "A"]


def test_fallback_is_decided_per_query(spark):
    rows = lambda *r: spark.createDataFrame(r, "query_id int, chunk_id int, score double")
    got = retrieval.first_stage_that_finds([rows((1, 1, 1.0)), rows((1, 2, 1.0), (2, 3, 1.0))]).collect()
    assert sorted((r.query_id, r.chunk_id, r.stage) for r in got) == [(1, 1, 0), (2, 3, 1)]


def test_request():
    assert relational.search_request(query="x")["top_k"] == 10
    for bad in ({"top_k": 0}, {"top_k": 51}, {"min_score": 1.1}, {"query": " "}, {"query": "x" * 1001}, {"mode": "no"}):
        with pytest.raises(ValueError):
            relational.search_request(**{"query": "x", **bad})


def test_status(spark):
    for statuses, expected in (([], "pending"), (["completed"] * 2, "completed"), (["completed", "failed"], "failed"), (["cancelled", "running"], "cancelled"), (["pending", "completed"], "processing")):
        rows = spark.createDataFrame([(s,) for s in statuses], "s string")
        assert rows.agg(relational.display_status(F.col("s")).alias("v")).first().v == expected
    overall = relational.overall_progress(F.col("s"), F.col("p")).alias("v")
    assert spark.createDataFrame([], "s string, p int").agg(overall).first().v == 0
    for rows, want in (([("running", 50), ("completed", 33)], 41), ([("failed", 90), ("pending", 90), ("cancelled", 90), ("running", 81)], 20), ([(None, 9), ("completed", None)], 0)):
        assert spark.createDataFrame(rows, "s string, p int").agg(overall).first().v == want


def packed(spark, contents, budget):
    rows = [(0, i, c, 1, 3, None) for i, c in enumerate(contents)]
    chunks = spark.createDataFrame(rows, "query_id int, rank int, content string, page_start int, page_end int, legal_context string")
    first = context.build_context(chunks, budget=budget).first()
    return first.context if first else ""


def test_context(spark):
    assert packed(spark, [], 40) == ""
    short = packed(spark, ["x" * 100], 40)
    assert short.startswith("[Source 1 | Pages 1-3]\n") and len(short) == 40
    assert packed(spark, ["x" * 100], 10) == ""
    assert packed(spark, ["a", "b"], 1000) == "[Source 1 | Pages 1-3]\na\n\n[Source 2 | Pages 1-3]\nb"


def test_global_context(spark):
    rows = [(0, h, 1, c, 1, 2, "law") for h, c in (("advisory_opinion", "z" * 500), ("legislation", "aa"), ("other", "q"))]
    chunks = spark.createDataFrame(rows, "query_id int, hub_type string, rank int, content string, page_start int, page_end int, legal_context string")
    got = context.build_global_context(chunks, budget=200).first().context
    assert got.startswith("=== [legislation] ===\n[Source 1 | Pages 1-2 | law]\naa\n\n=== [advisory_opinion] ===\n[Source 2")
    assert len(got) <= 200 and "q" not in got


def test_citations(spark):
    rows = [(0, i, f"chunk-{i}") for i in (1, 2, 3)]
    chunks = spark.createDataFrame(rows, "query_id int, rank int, chunk_id string")
    for answer, expected in (("[Source 3] [Source 1]", ["chunk-1", "chunk-3"]), ("[Source 99]", []), ("none", []), ("[Source 2][Source 2]", ["chunk-2"])):
        said = spark.createDataFrame([(0, answer)], "query_id int, answer string")
        assert [r.chunk_id for r in context.resolve_citations(said, chunks).orderBy("n").collect()] == expected


def test_upsert_and_as_of(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, v int, s string")
    new = spark.createDataFrame([(1, 1, "c"), (3, 1, "d")], "k int, v int, s string")
    assert sorted(map(tuple, relational.upsert(old, new, ["k"], "v").collect())) == [(1, 1, "c"), (2, 5, "b"), (3, 1, "d")]
    places = spark.createDataFrame([(1, 0), (1, 7), (1, 20), (2, 3)], "document_id int, pos int")
    marks = spark.createDataFrame([(1, 5, 2), (1, 20, 3)], "document_id int, pos int, page int")
    assert sorted(map(tuple, relational.page_as_of(places, marks).collect())) == [(1, 0, 1), (1, 7, 2), (1, 20, 3), (2, 3, 1)]


TEXT = "پیش گفتار. [PAGE 1]\nماده 1 متن اول است. ادامه دارد! [PAGE 2]\nماده 2 متن دوم؟ بله: خوب.\n\nفصل 3 پایان."


def test_page_markers(spark):
    rows = spark.createDataFrame([("[PAGE 1]\nabcd[PAGE 2]\nefgh[PAGE 3]\nijkl",)], "t string")
    starts = chunking.page_starts(F.col("t"))
    spans = [chunking.pages_between(starts, F.lit(a), F.lit(b)) for a, b in ((0, 4), (2, 9))]
    got = rows.select(chunking.without_page_markers(F.col("t")).alias("text"), starts.alias("starts"), *(s.alias(f"s{i}") for i, s in enumerate(spans))).first()
    assert got.text == "abcdefghijkl" and [tuple(x) for x in got.starts] == [(0, 1), (4, 2), (8, 3)]
    assert got.s0 == [1] and got.s1 == [1, 2, 3]


PARTS = ["ماده 1", "دادنامه", "foo bar", ". ", "! ", "\n\n", " ", "لذا دادگاه", "x" * 30, "a b c d e f g h ", "رأيُ دادگاه", "[PAGE 2]\n", "[PAGE 13]", "3.5", "گردش كار", ": ", "حکم به", "w " * 30]


def _chunks(rows):
    return sorted((r.document_id, r.chunk_index, r.content, r.start, r.end, list(r.pages), r.token_count, r.section_title, r.section_type) for r in rows.collect())


@pytest.mark.parametrize(("smallest", "largest", "overlap"), [(3, 8, 1), (2, 6, 0), (5, 12, 2)])
def test_chunks_against_plain_loops(spark, smallest, largest, overlap):
    rnd = random.Random(smallest)
    rows = [(i, "".join(rnd.choice(PARTS) for _ in range(rnd.randrange(0, 50)))) for i in range(120)] + [(1000, None), (1001, "  ")]
    docs = spark.createDataFrame(rows, "document_id int, text string")
    plain = plain_chunkers.StructuralChunker(smallest, largest, overlap)
    want = sorted((i, *r) for i, t in rows for r in plain_chunkers.chunk_rows(plain, t))
    # within the row of a text, and as rows over all tasks
    for long in (chunking.LONG, 0):
        assert _chunks(chunking.structural_chunks(docs, smallest, largest, overlap, long=long)) == want
    simple = plain_chunkers.SimpleChunker(largest, overlap)
    want = sorted((i, *r) for i, t in rows for r in plain_chunkers.chunk_rows(simple, t))
    assert _chunks(chunking.simple_chunks(docs, largest, overlap)) == want


def test_chunks_cover_the_text(spark):
    rnd = random.Random(9)
    rows = [(i, "".join(rnd.choice(PARTS[:10]) for _ in range(40))) for i in range(60)]
    covered = {i: set() for i, _ in rows}
    for r in chunking.structural_chunks(spark.createDataFrame(rows, "document_id int, text string"), 4, 12).collect():
        assert r.token_count <= 12
        covered[r.document_id].update(range(r.start, r.end))
    for i, text in rows:
        assert {k for k, ch in enumerate(text) if not ch.isspace()} <= covered[i]


def test_long_document_is_packed_over_tasks(spark):
    """Both ways give the same chunks, also where running sums and searches cross blocks."""
    text = "".join(f"Word {i} is here{'!' * (i % 3)}. " for i in range(6000))
    docs = spark.createDataFrame([(1, text)], "document_id int, text string")
    one, other = (_chunks(chunking.structural_chunks(docs, 20, 60, 2, hints=(r"Word\s+\d*7",), long=long)) for long in (chunking.LONG, 1000))
    assert one == other and len(one) > 400


def test_chunks_of_odd_documents(spark):
    docs = spark.createDataFrame([("d", TEXT), ("e", None), ("f", "  ")], "document_id string, text string")
    got = chunking.structural_chunks(docs, 2, 8, 0).orderBy("chunk_index").collect()
    assert {r.document_id for r in got} == {"d"}
    assert [r.section_type for r in got][0] == "text" and {"article", "chapter"} <= {r.section_type for r in got}
    assert got[-1].pages == [2] and got[-1].metadata.start_page == 2
    simple = chunking.simple_chunks(docs, 5, 1).orderBy("chunk_index").collect()
    assert simple[0].section_title == chunking.PREAMBLE
    assert chunking.structural_chunks(docs.limit(0)).count() == 0 and chunking.simple_chunks(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chunking.simple_chunks(docs, 5, 5)


def test_token_windows(spark):
    tokens = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: i.cast("string"))
    got = spark.range(1).select(chunking.token_windows(tokens, 4, 1).alias("w")).first().w
    assert [w[0] for w in got] == ["1", "4", "7"] and got[-1] == ["7", "8", "9", "10"]
    with pytest.raises(ValueError):
        chunking.token_windows(tokens, 4, 4)


def test_header_fields(spark):
    text = "کلاسه پرونده: ۱۲۳۴۵۶۷۸۹۰۱۲۳۴\nتاریخ: ۱۴۰۲/۰۶/۱۵\nخواهان: علی محمدی\nخوانده: شرکت ساختمانی\nشعبه ۱۲"
    got = spark.range(1).select(chunking.header_fields(F.lit(text)).alias("m")).first().m
    assert got == {"case_number": "۱۲۳۴۵۶۷۸۹۰۱۲۳۴", "date": "۱۴۰۲/۰۶/۱۵", "plaintiff": "علی محمدی", "defendant": "شرکت ساختمانی", "branch": "۱۲"}


def test_models(spark):
    seen = []

    def embedder(texts):
        seen.append(len(texts))
        return [[float(len(t))] for t in texts]

    assert models.embed_texts(embedder, ["a", "", None, "bb", " "], batch=1) == [[1.0], None, None, [2.0], None] and seen == [1, 1]
    with pytest.raises(ValueError):
        models.embed_query(embedder, " ")
    tries = itertools.count()

    def flaky():
        if next(tries) < 2:
            raise OSError
        return 7

    assert models.with_retries(flaky, sleep=lambda _: None)() == 7
    model = lambda q: '```json\n{"legislation": {"query": "q1", "hypothetical": "h"}, "other": {"relevant": false}}\n```'
    routed = models.route_question("a long enough question", ["legislation", "other"], model)
    assert [(q.query, q.relevant) for q in routed.queries] == [("q1", True), ("a long enough question", False)] and not routed.fallback
    assert models.route_question("short", ["x"], model).fallback
    assert models.extract_facts(lambda m: "oops", "hi", {"a": 1}) == ({"a": 1}, 0.0)
    assert models.extract_facts(lambda m: '{"facts": {"b": 2}, "completeness_score": 0.8}', "hi", {"a": 1}) == ({"a": 1, "b": 2}, 0.8)


def test_answers(spark):
    from kilnspark.plans.answers import answer_from_chunks, answer_from_hubs

    rng = random.Random(1)
    rows = [(i, "legislation" if i % 2 else "advisory_opinion", f"law text {i} the rule", [rng.random(), 1.0], 1, 2, None) for i in range(12)]
    chunks = spark.createDataFrame(rows, "chunk_id int, hub_type string, content string, embedding array<double>, page_start int, page_end int, legal_context string")
    answer, cited = answer_from_chunks(spark, chunks, "the rule", lambda ts: [[1.0, 1.0] for _ in ts], lambda p: "see [Source 1]")
    assert answer == "see [Source 1]" and cited.count() == 1
    answer, cited = answer_from_hubs(spark, chunks, "the rule", lambda ts: [[1.0, 1.0] for _ in ts], lambda p: "see [Source 6]", hubs=("legislation", "advisory_opinion"), top_k=5)
    assert [r.hub_type for r in cited.collect()] == ["advisory_opinion"]
