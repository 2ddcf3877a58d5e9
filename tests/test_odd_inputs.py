"""Queries on rows that the supplied tables lack, against their SQL."""

import duckdb

from kilnspark import queries_documents  # noqa: F401
from kilnspark.registry import QUERIES, SQL


def test_upload_of_an_empty_document(spark, tmp_path):
    """A file is refused for its extension or its size; an empty one is not refused."""
    odd = [
        (0, "src1", 0), (1, "src1", -1), (2, "src1", None), (3, None, 0), (4, None, 5001), (5, "a.b/c", 5000), (6, "a\n", 5001), (7, "", 0),
    ]
    spark.createDataFrame(odd, "doc_id long, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    ours = QUERIES["upload_validation"](spark, str(tmp_path)).orderBy("doc_id").collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert [tuple(r) for r in ours] == con.execute(f"{SQL['upload_validation']} ORDER BY doc_id").fetchall()
    assert [r.error for r in ours] == [None, None, None, None, "size", None, "size", None]
