"""Small exact cases of operators that the queries do not reach."""

import pytest
from pyspark.sql import functions as F

from kilnspark.functions import jsontext
from kilnspark.operators import chunking, context, models, relational, retrieval
from kilnspark.plans import answers, prompts
from kilnspark.sources import files
from kilnspark.streaming import ingest

CHUNKS = "chunk_id int, document_id int, hub_type string, content string, embedding array<double>, page_start int, page_end int, legal_context string, legal_status string"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (1, 1, "legislation", "كتاب قانون ۱۲", [1.0, 0.0, 0.0], 1, 2, "a", "valid"),
        (2, 1, "legislation", "contract law of sale", [0.9, 0.1, 0.0], 2, 3, "a", "repealed"),
        (3, 2, "advisory_opinion", "the opinion on contracts", [0.0, 1.0, 0.0], 1, 1, None, None),
        (4, 2, "advisory_opinion", None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, CHUNKS)


def ids(rows):
    return [r.chunk_id for r in rows.collect()]


def test_keyword_search_normalises_and_falls_back(chunks):
    find = lambda q, **how: ids(retrieval.keyword_search(chunks, q, 5, stop_words=("the", "of"), **how))
    assert find("کتاب 12") == find("كتاب ١٢") == [1]
    assert find("the contract") == [2]
    assert find('"contract of sale"') == [2]  # the stop word within a phrase goes too
    assert find("the of") == find("") == find("the of", fallback=True) == []
    assert find("contrakt lav") == [2, 3] and find("contrakt lav", fallback=False) == []


def test_wrong_width_is_an_error(spark, chunks):
    with pytest.raises(ValueError):
        retrieval.vector_search(chunks, [1.0, 0.0], 3)
    with pytest.raises(ValueError):
        retrieval.hybrid_search(chunks, [1.0, 0.0], "law", 3)
    asked = spark.createDataFrame([(0, "legislation", [1.0, 0.0])], "query_id int, hub string, vector array<double>")
    with pytest.raises(Exception, match="components"):
        retrieval.vector_search_many(chunks, asked, 3, F.col("hub_type") == F.col("hub")).collect()
    mixed = chunks.unionByName(chunks.limit(1).withColumn("embedding", F.array(F.lit(1.0))))
    with pytest.raises(Exception, match="components"):
        retrieval.vector_search(mixed, [1.0, 0.0, 0.0], 3, width=3).collect()


def test_trigram_search_needs_a_threshold(spark, chunks):
    asked = spark.createDataFrame([(0, "contract"), (1, "zzz")], "query_id int, query string")
    found = {(r.query_id, r.chunk_id) for r in retrieval.trigram_search_many(chunks, asked, 0.05).collect()}
    assert found == {(0, 2), (0, 3)}
    with pytest.raises(ValueError):
        retrieval.trigram_search_many(chunks, asked, 0)


def test_as_of_over_buckets(spark):
    places = spark.createDataFrame([(d, p) for d in (1, 2) for p in range(0, 60, 3)], "document_id int, pos int")
    marks = spark.createDataFrame([(1, 5, 2), (1, 20, 3), (1, 41, 4), (2, 33, 9)], "document_id int, pos int, page int")
    want = {(d, p): max(((m, n) for e, m, n in ((1, 5, 2), (1, 20, 3), (1, 41, 4), (2, 33, 9)) if e == d and m <= p), default=(0, 1))[1] for d in (1, 2) for p in range(0, 60, 3)}
    for bucket in (7, 100_000):
        assert {(r.document_id, r.pos): r.page for r in relational.page_as_of(places, marks, bucket=bucket).collect()} == want


def test_pages(spark):
    got = relational.paginated(spark.range(25), [F.col("id")], 9, 10)
    assert [r.id for r in got.pop("rows").collect()] == [20, 21, 22, 23, 24]
    assert got == {"total": 25, "pages": 3, "page": 3, "size": 10, "has_next": False, "has_previous": True}
    assert relational.page(spark.range(25), [F.col("id")], 2, 5, total=25).count() == 5


def test_global_context_cuts_within_the_budget(spark):
    rows = [(0, h, r, c * 40, 1, 2, None) for h in ("x", "y") for r, c in ((1, "ab"), (2, "cd"))] + [(1, "y", 1, "q", None, 3, "law")]
    table = spark.createDataFrame(rows, "query_id int, hub_type string, rank int, content string, page_start int, page_end int, legal_context string")
    for budget in (10, 60, 150, 260, 1000):
        got = {r.query_id: r.context for r in context.build_global_context(table, ("x", "y"), budget=budget).collect()}
        assert all(len(t) <= budget for t in got.values())
    assert got[1] == "=== [y] ===\n[Source 1 | Pages ?-3 | law]\nq"
    assert [got[0].count(f"[Source {n} ") for n in (1, 2, 3, 4, 5)] == [1, 1, 1, 1, 0]


def test_anchors_of_either_script(spark):
    text = "مقدمه. رأيُ دادگاه چنین است. متن رای. گردش كار. پایان"
    rows = spark.createDataFrame([(1, text)], "document_id int, text string")
    found = chunking.structural_chunks(rows, smallest=1).orderBy("chunk_index").collect()
    assert "".join(text[c.start : c.end] for c in found) == text
    assert [c.section_type for c in found if c.section_title] == ["verdict", "proceedings"]


def test_blob_store(spark, tmp_path):
    store = files.BlobStore(spark, f"file://{tmp_path}")
    assert store.save("a/b.bin", b"\x00\xff") == f"file://{tmp_path}/a/b.bin" and store.open("a/b.bin") == b"\x00\xff"
    assert store.delete("a/b.bin") and not store.delete("a/b.bin")
    with pytest.raises(FileNotFoundError):
        store.open("a/b.bin")
    with pytest.raises(ValueError):
        store.url("../x")


def test_prompts():
    assert prompts.hub_prompt("legislation", "C", "Q").endswith("C\n\nQ")
    assert "[Conflict]" in prompts.synthesis_prompt("P", "", "Q") and "\n\n\n" not in prompts.synthesis_prompt("P", "", "Q")
    with pytest.raises(ValueError):
        prompts.hub_prompt("other", "", "")


def test_validity_of_laws(spark, chunks):
    documents = spark.createDataFrame([(1, "reference_law"), (2, "user_upload")], "document_id int, document_type string")
    assert sorted(ids(answers.within_validity(chunks, documents))) == [1, 3, 4]
    answer, cited = answers.answer_from_chunks(spark, chunks, "قانون", lambda ts: [[0.9, 0.1, 0.0] for _ in ts], lambda p: "see [Source 1]", documents=documents)
    assert [r.chunk_id for r in cited.collect()] == [1]


def test_case_analysis(spark, chunks):
    seen = []

    def chat(prompt):
        seen.append(prompt)
        return "```json\n{'summary': 'good', 'success_probability': '70 per cent', 'strengths': ['a', 'b'],}\n```"

    got = answers.analyze_case(spark, chunks, "civil", {"claims": "contract sale", "amount": "1500"}, lambda ts: [[0.9, 0.1, 0.0] for _ in ts], chat, case_words=("contract",)).first()
    assert (got.summary, got.probability, got.strengths, got.risks, got.strategy) == ("good", 0.7, ["a", "b"], [], "quotes")
    assert got.report.startswith("# پرونده دعاوی حقوقی") and "## strengths\n- a\n- b" in got.report and "risks" not in got.report
    assert "contract law of sale" in seen[0] and "1,500" in seen[0] and "كتاب" not in seen[0]


def test_streams(spark, tmp_path):
    assert list(models.streamed(lambda p: p + "!")("a")) == ["a!"]
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c")], "conv_id int, turn int, role string, text string")
    turns.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in"))
    ingest.state_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    turns.limit(0).unionByName(spark.createDataFrame([(1, 2, "user", "d")], turns.schema)).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.state_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    last = {k: max((r for r in rows if r.conv_id == k), key=lambda r: r.batch) for k in (1, 2)}
    assert (last[1].messages, last[1].last_user, last[2].messages, last[2].last_user) == (3, "d", 1, "c")


def test_salvaged_lists():
    said = 'x "risks": ["one", "two", "cut'
    assert jsontext.salvage(said, ("risks", "summary")) == ("fields", '{"risks": ["one", "two"]}')
