"""A sink that takes a batch of chunks whole or not at all, and once.

Tasks write Parquet files beside each other; a batch counts when its list of files is put
into ``commits``, which happens after all tasks are done. So a failed task or job leaves no
part of a document that a reader would see, files of repeated attempts are never listed, and
a batch that is written again (a job run anew after an unclear end) changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "committed_chunks"


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URL (``file:``, ``hdfs:``, ``s3:``) and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return pafs.FileSystem.from_uri(path)


@dataclass
class _Part(WriterCommitMessage):
    file: str | None
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, batch: str):
        self.path, self.batch = path, batch

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _place(self.path)
        name, out, rows = f"{self.batch}-{uuid.uuid4().hex}.parquet", None, 0
        try:
            for b in iterator:
                if out is None:
                    fs.create_dir(f"{root}/data", recursive=True)
                    out = pq.ParquetWriter(f"{root}/data/{name}", b.schema, filesystem=fs, compression="zstd")
                out.write_batch(b)
                rows += b.num_rows
        except BaseException:
            if out is not None:
                out.close()
                fs.delete_file(f"{root}/data/{name}")
            raise
        if out is not None:
            out.close()
        return _Part(name if out is not None else None, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _place(self.path)
        done = f"{root}/commits/{self.batch}.json"
        if fs.get_file_info(done).type != pafs.FileType.NotFound:
            return self.abort(messages)
        parts = [m for m in messages if m is not None and m.file]
        fs.create_dir(f"{root}/commits", recursive=True)
        made = f"{root}/commits/_{uuid.uuid4().hex}"  # Spark's readers pass over such names
        with fs.open_output_stream(made) as f:
            f.write(json.dumps({"batch": self.batch, "files": [m.file for m in parts], "rows": sum(m.rows for m in parts)}).encode())
        fs.move(made, done)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _place(self.path)
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(f"{root}/data/{m.file}")


class CommittedChunks(DataSource):
    """``df.write.format("committed_chunks").option("path", ...).option("batch", ...)``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        path, batch = self.options.get("path"), self.options.get("batch", "")
        if not path or not batch or not all(c.isalnum() or c in "-." for c in batch):
            raise ValueError("options path and batch (letters, digits, - and .) are needed")
        if overwrite:
            raise ValueError("batches are added (mode append), never overwritten")
        return _Writer(path, batch)


def append_batch(chunks: DataFrame, path: str, batch: str) -> None:
    """Add ``chunks`` as one batch; nothing happens if a batch of that name is there."""
    chunks.sparkSession.dataSource.register(CommittedChunks)
    chunks.write.format(NAME).mode("append").option("path", path).option("batch", batch).save()


def committed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of all batches that were taken; none if there is no batch."""
    lists = spark.read.schema("files array<string>").json(f"{path}/commits")
    files = [f"{path}/data/{f}" for r in lists.collect() for f in r.files]  # one name for each task that wrote
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
