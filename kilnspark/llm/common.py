"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The reliable folder that driver and executors share, ``spark.checkpoint.dir``.

    Where that is unset, a session of one process (tests) gets a temporary folder; on a
    cluster, where it would be lost with its machine, this is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="spark-kiln-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


#: Folders written in each open :func:`scope`, innermost last; the first belongs to no scope.
_OWNED: list[list[str]] = [[]]


def owned(path: str) -> str:
    """``path``, to be removed when the scope that is open now ends."""
    _OWNED[-1].append(path)
    return path


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scope(spark: SparkSession):
    """Tables that are stored inside are removed at the end, but for those handed to the
    function it gives, which go to the scope around it."""
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._kiln_path)
        return df

    _OWNED.append([])
    try:
        yield keep
    finally:
        here = _OWNED.pop()
        _OWNED[-1] += [p for p in here if p in kept]
        remove(spark, (p for p in here if p not in kept))


def clean(spark: SparkSession) -> None:
    """Remove what operators have stored outside a scope, once their results are used."""
    remove(spark, _OWNED[0])
    _OWNED[0].clear()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage with replicated, committed files, so a lost executor costs no
    recomputation and later stages all see the same rows. See :func:`scope` and
    :func:`clean` for how long the table lasts.
    """
    spark = df.sparkSession
    path = owned(f"{shared_dir(spark)}/table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._kiln_path = path
    return stored


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (null becomes empty); other columns are dropped."""
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
    )


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits of a text (null as empty), by which copies of it meet."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


#: Frequent keys that :func:`spread_join` spreads, for each shuffle partition, at most.
SPREAD = 4


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, by: str, counted: DataFrame | None = None, small: bool = False) -> DataFrame:
    """``left.join(right, keys, how)`` for a ``left`` of which a few keys may hold most rows.

    ``right`` has one row for each key; ``how`` is inner, left or left_semi. Keys that more
    than a quarter of an average partition's rows carry (so at most ``SPREAD`` for each
    partition: safe to broadcast) are split by a hash of ``by``; their rows of ``right`` are
    repeated for each part. Keys are counted in ``counted``, a stored table with about the
    rows of ``left``, which it is by default. ``small``: a partition of ``right`` surely fits
    in memory, so ``left`` need not be sorted.
    """
    counted = left if counted is None else counted
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = max(1, counted.count() // (SPREAD * parts))
    hot = counted.groupBy(*keys).agg(F.count("*").alias("_kiln_n")).where(F.col("_kiln_n") > each)
    hot = F.broadcast(hot.select(*keys, F.ceil(F.col("_kiln_n") / each).cast("int").alias("_kiln_parts")))
    split = lambda rows: rows.join(hot, keys, "left").withColumn("_kiln_parts", F.coalesce("_kiln_parts", F.lit(1)))
    part = F.pmod(F.xxhash64(by), F.col("_kiln_parts")).cast("int")
    pieces = split(left).withColumn("_kiln_part", part).drop("_kiln_parts")
    copies = split(right).withColumn("_kiln_part", F.explode(F.sequence(F.lit(0), F.col("_kiln_parts") - 1))).drop("_kiln_parts")
    copies = copies.hint("shuffle_hash") if small else copies
    return pieces.join(copies, [*keys, "_kiln_part"], how).drop("_kiln_part")


def most_frequent(counts: DataFrame, n: str) -> DataFrame:
    """The rows of the highest ``n``, ``SPREAD`` for each partition: a broadcast of bounded
    size, beyond which no key has more than a quarter of an average partition."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return F.broadcast(counts.orderBy(F.desc(n), *(c for c in counts.columns if c != n)).limit(SPREAD * parts))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n (null for a null id)."""
    return F.crc32(doc_id.cast("string")) % F.lit(n)


def give_back() -> None:
    """Hand memory that is free inside this process back to the system.

    Arrow and malloc keep what a batch has used, in every worker and long after its task, so
    a worker that served several operators would hold the largest batch of each.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that Python objects of few rows are alive at once; what a batch
    took is given back when the next has begun, as the caller holds its last rows until then."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
            if not at:
                give_back()
    give_back()


_HELD: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], object]):
    """What ``make`` gives, kept in this Python worker for its next tasks.

    One thing at a time: workers outlive their operator, and its caches go when the worker
    is used by another.
    """
    if key not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[key] = make()
    return _HELD[key]


class BoundedCache(dict):
    """A dict that forgets everything once it holds ``limit`` keys; a cache of pure results."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def room(self, n: int) -> None:
        if len(self) + n > self.limit:
            self.clear()
