"""The sink of whole batches, windows as a table function, page batches with fallback."""

import os

import pytest
from pyspark.sql import functions as F

from kilnspark.operators import table_functions
from kilnspark.sources import committed, files

CHUNKS = "document_id long, content string"


def test_batches_are_taken_once(spark, tmp_path):
    path = str(tmp_path / "chunks")
    one = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], CHUNKS)
    committed.append_batch(one, path, "first")
    committed.append_batch(one, path, "first")
    committed.append_batch(spark.createDataFrame([(3, "c")], CHUNKS), path, "second")
    committed.append_batch(spark.createDataFrame([], CHUNKS), path, "third")
    got = committed.committed(spark, path, CHUNKS)
    assert sorted((r.document_id, r.content) for r in got.collect() if r.content) == [(1, "a"), (1, "b"), (3, "c")]
    assert got.count() == 4
    assert sorted(os.listdir(f"{path}/commits")) == ["first.json", "second.json", "third.json"]


def test_a_failing_task_leaves_no_half_document(spark, tmp_path):
    path = str(tmp_path / "chunks")
    committed.append_batch(spark.createDataFrame([(1, "a")], CHUNKS), path, "first")
    bad = spark.range(0, 1000, 1, 4).select(F.lit(7).cast("long").alias("document_id"), F.when(F.col("id") == 999, F.raise_error(F.lit("lost"))).otherwise("x").cast("string").alias("content"))
    with pytest.raises(Exception, match="lost|abort|writ"):
        committed.append_batch(bad, path, "second")
    assert committed.committed(spark, path, CHUNKS).count() == 1
    committed.append_batch(bad.where("false").unionByName(spark.createDataFrame([(7, "x")], CHUNKS)), path, "second")
    assert committed.committed(spark, path, CHUNKS).count() == 2


@pytest.mark.parametrize("batch", ["", "../x", "a/b"])
def test_names_of_batches(spark, tmp_path, batch):
    with pytest.raises(Exception, match="batch"):
        committed.append_batch(spark.createDataFrame([(1, "a")], CHUNKS), str(tmp_path / "c"), batch)


def windows(tokens, size, overlap):
    """(window, tokens with pages) by plain slicing."""
    starts = [s for s in range(0, len(tokens), size - overlap) if s == 0 or len(tokens) > s + overlap]
    return [(n, tokens[s : s + size]) for n, s in enumerate(starts)]


@pytest.mark.parametrize("size, overlap", [(1, 0), (3, 0), (3, 1), (5, 4), (100, 20)])
def test_windows_cross_pages(spark, size, overlap):
    table_functions.register(spark)
    given = {1: [["a", "b"], [], ["c", "d", "e", "f"], None, ["g"]], 2: [[], None], 3: [["x"] * 250], 4: [["y"]]}
    rows = [(d, n, ts, "extra") for d, pages in given.items() for n, ts in enumerate(pages, 1)]
    pages = spark.createDataFrame(rows[::-1], "document_id long, page int, tokens array<string>, window string").repartition(3)
    got = spark.sql("SELECT * FROM page_windows(TABLE(SELECT * FROM {p}), {s}, {o})".replace("{s}", str(size)).replace("{o}", str(overlap)), p=pages).collect()
    want = set()
    for d, parts in given.items():
        tokens = [(t, n) for n, ts in enumerate(parts, 1) for t in ts or ()]
        want |= {(d, n, len(w), w[0][1], w[-1][1], " ".join(t for t, _ in w)) for n, w in windows(tokens, size, overlap)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_windows_are_checked_when_analysed(spark):
    table_functions.register(spark)
    pages = spark.createDataFrame([(1, 1, ["a"])], "document_id long, page int, tokens array<string>")
    for call in ("TABLE(SELECT * FROM {p}), 5, 5", "TABLE(SELECT document_id FROM {p}), 5, 1"):
        with pytest.raises(Exception, match="overlap|no column"):
            spark.sql(f"SELECT * FROM page_windows({call})", p=pages).collect()


def test_page_batches_fall_back_to_single_pages(spark):
    schema = "path string, page int, text string, error string"
    rows = [("f", n, f"bad {n}", None) for n in range(1, 8)] + [("f", 8, "good", None), ("g", 1, "bad 1", "e"), ("h", 1, "bad", None)]

    def batch_reader(path, pages):
        if path == "g":
            raise OSError("down")
        # of each call, the last page is left out and a second page is blank
        return "".join(f"[PAGE {n}]\n{'' if n == 2 else f'batch {path}{n} of {len(pages)}'}\n" for n in pages[:-1])

    def reader(path, page):
        if path == "h":
            raise OSError("down")
        return f"single {path}{page}"

    pages = spark.createDataFrame(rows, schema)
    got = files.reread_page_batches(pages, F.col("text").startswith("bad"), batch_reader, reader, size=3)
    assert {(r.path, r.page): r.text for r in got.collect()} == {
        ("f", 1): "batch f1 of 3", ("f", 2): "single f2", ("f", 3): "single f3", ("f", 4): "batch f4 of 3", ("f", 5): "batch f5 of 3",
        ("f", 6): "single f6", ("f", 7): "single f7", ("f", 8): "good", ("g", 1): "single g1", ("h", 1): "bad",
    }
    assert got.count() == 10
    assert files.reread_page_batches(pages, F.lit(False), batch_reader, reader).count() == 10
