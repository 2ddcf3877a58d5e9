import json

from pyspark.sql import functions as F

from kilnspark.sources import files, json_documents, sinks
from kilnspark.streaming import ingest


def test_json_formats(spark, tmp_path):
    folders = {h: tmp_path / f for f, h in json_documents.FOLDER_HUBS.items()}
    for f in folders.values():
        f.mkdir()
    a = {"source_file": "civil law", "total_chunks": 1, "chunks": [{"chunk_id": "c1", "madde_number": 4, "text": "ماده 4", "metadata": {"source": "s", "approval_date": "1392/02/01", "status": "معتبر"}}]}
    b = [{"text": "t", "chunk_type": "body", "full_title": "ruling", "metadata": {"judgment_number": "77", "hub_type": "precedent"}}]
    c = [{"chunk_id": "o1", "parent_title": "opinion", "text": "", "position": 0}, {"chunk_id": "o2", "metadata": {"parent_title": "opinion"}, "text": "y"}]
    for hub, body in (("legislation", a), ("judicial_precedent", b), ("advisory_opinion", c)):
        (folders[hub] / "f.json").write_text(json.dumps(body, ensure_ascii=False))
    (tmp_path / "broken.json").write_text("{oops")
    rows = {r.chunk_id: r for r in json_documents.read_chunks(json_documents.raw_files(spark, str(tmp_path))).collect()}
    assert set(rows) == {"c1", "77_body", "o1", "o2"}
    assert (rows["c1"].hub_type, rows["c1"].document_title, rows["c1"].idx, str(rows["c1"].approval_date)) == ("legislation", "civil law", 4, "1392-02-01")
    assert (rows["77_body"].hub_type, rows["77_body"].document_title) == ("judicial_precedent", "ruling")
    assert rows["o2"].document_title == "opinion" and rows["o2"].hub_type == "advisory_opinion"


def test_laws(spark, tmp_path):
    body = {"hub_type": "legislation", "documents": [{"title": "t", "content": "ماده 1", "metadata": {"law_name": "n", "approval_date": "1403/02/31"}}]}
    (tmp_path / "laws.json").write_text(json.dumps(body, ensure_ascii=False))
    row = json_documents.read_laws(json_documents.raw_files(spark, str(tmp_path))).first()
    assert (row.title, row.content, row.hub_type, row.law_name, row.approval_date) == ("t", "ماده 1", "legislation", "n", None)


def test_hub_audit(spark):
    rows = [(1, "/x/هاب قوانین مصوب/a.json", None, "", "advisory_opinion"), (2, "/x/y/a.json", "precedent", "", "judicial_precedent"), (3, "/x/y/a", None, "نظریه مشورتی", None), (4, "/x/y/a", None, "zzz", "legislation")]
    docs = spark.createDataFrame(rows, "document_id int, path string, metadata_hub string, title string, hub_type string")
    audit = json_documents.audit_hubs(docs)
    assert {r.document_id: (r.expected_hub, r.matches) for r in audit.collect()} == {
        1: ("legislation", False), 2: ("judicial_precedent", True), 3: ("advisory_opinion", False), 4: (None, True)}
    fixed = json_documents.fix_hubs(docs.select("document_id", "hub_type"), audit)
    assert {r.document_id: r.hub_type for r in fixed.collect()} == {1: "legislation", 2: "judicial_precedent", 3: "advisory_opinion", 4: "legislation"}


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF one|two")
    (tmp_path / "b.pdf").write_bytes(b"junk")

    def reader(data):
        if not data.startswith(b"%PDF"):
            raise ValueError("cannot open broken document")
        return data[5:].decode().split("|")

    found = files.binary_files(spark, str(tmp_path))
    pages = files.read_pages(found, reader)
    assert sorted((r.page, r.text) for r in pages.collect() if not r.error) == [(1, "one"), (2, "two")]
    assert files.with_page_markers(pages).first().text == "[PAGE 1]\none\n[PAGE 2]\ntwo"
    again = files.reread_pages(pages, F.col("text") == "two", lambda path, page: "better")
    assert sorted(r.text for r in again.collect() if r.text) == ["better", "one"]
    kinds = found.select(files.has_pdf_magic(F.col("content")).alias("ok"), files.error_class(F.lit("broken"), F.col("content")).alias("e")).collect()
    assert sorted((r.ok, r.e) for r in kinds) == [(False, "not_a_pdf"), (True, "corrupted")]
    got = spark.range(1).select(files.split_page_batch(F.lit("[PAGE 2]\na\n[PAGE 5] b")).alias("p")).first().p
    assert [(r.page, r.text) for r in got] == [(2, "a"), (5, "b")]


def test_html_tables(spark):
    html = "<p>x</p><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td></td></tr></table><table><tr><td>only</td></tr></table>"
    rows = files.html_tables(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).collect()
    assert [(r.page_id, r.n, r.table) for r in rows] == [(1, 0, [["a", "b"], ["1", None]])]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = lambda *r: spark.createDataFrame(r, "chunk_id int, hub_type string")
    sinks.append_chunks(rows((1, "a"), (2, "b")), path)
    sinks.reload_hubs(rows((3, "a")), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(2, "b"), (3, "a")]


def test_stream(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(2):
        spark.range(n * 10, n * 10 + 10).coalesce(1).write.mode("append").parquet(source)
        query = ingest.ingest(ingest.file_stream(spark, source, "id long"), lambda b: b.where("id % 2 = 0"), target, str(tmp_path / "ck"))
        query.awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == list(range(0, 20, 2))


def test_stream_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(200)
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = ingest.file_stream(spark, str(tmp_path / "e"), "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    query = ingest.event_windows(stream).writeStream.format("memory").queryName("windows").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = spark.sql("select sum(n) from windows").first()[0]
    assert got == 200
