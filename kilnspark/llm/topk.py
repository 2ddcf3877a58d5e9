"""Exact top-k by integer inner product.

A stated query set is scored against all rows. Queries and rows are dealt out in blocks, and
every block of queries meets every block of rows in one group of one plan; nothing passes
through the driver. In a group the queries come first, then the rows in batches: of each
batch posting lists are made, each term of the query rows scatters its weighted postings into
dense score arrays, partition selection takes the best of the batch, and those are merged
with the best so far. The lists of the groups are merged in the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Queries in a block, about: with the vector length this bounds what a task holds.
QUERY_BLOCK = 4096
#: Rows below which a block is not cut further, and groups for each partition, at most.
ROW_BLOCK, GROUPS = 10_000, 4
#: Cells of the dense score array alive at once.
SCORE_CELLS = 2_000_000
#: Below any score, and its negative exists.
LOWEST = -(2**62)


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of each component, x as double, as array of long.

    Vectors that are null or hold null or non-finite components are left out, as are null
    ids. Several rows with one id all stay.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    return (
        vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
        .where(F.coalesce(finite, F.lit(False)))
        .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))
    )


def _dense(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as an int64 matrix; short rows end in zeros, long ones are cut to ``width``."""
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = at < width
    out[row[inside], at[inside]] = flat[inside]
    return out


def postings(rows: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """For each term the rows that hold it (None for all of them) and its weights there."""
    lists = []
    for term in range(rows.shape[1]):
        holds = np.flatnonzero(rows[:, term])
        every = len(holds) == len(rows)
        lists.append((None if every else holds, np.ascontiguousarray(rows[:, term] if every else rows[holds, term])))
    return lists


def accumulate(queries: np.ndarray, lists: list[tuple[np.ndarray | None, np.ndarray]], n_rows: int) -> np.ndarray:
    """Scores (query x row), one term at a time, exact in 64-bit integers."""
    scores = np.zeros((len(queries), n_rows), np.int64)
    for term, (rows, weights) in enumerate(lists):
        asked = np.flatnonzero(queries[:, term])
        if not len(asked) or not len(weights):
            continue
        added = queries[asked, term, None] * weights[None, :]
        if rows is not None:
            scores[asked[:, None], rows[None, :]] += added
        elif len(asked) == len(queries):
            scores += added
        else:
            scores[asked] += added
    return scores


def best_of(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (query x k) of each query's k best rows but its own; ties to smaller ids.

    ``ids`` ascend, so the first rows among equals win: selection takes all rows above the
    k-th score and fills up with the first that equal it. Empty places hold ``LOWEST``.
    """
    scores = np.where(ids[None, :] == own[:, None], LOWEST, scores)
    if scores.shape[1] > k:
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        q, r = np.nonzero(scores >= kth[:, None])
    else:
        q, r = np.nonzero(scores > LOWEST)
    s = scores[q, r]
    order = np.lexsort((r, -s, q))
    q, r, s = q[order], r[order], s[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)  # q ascends: places count from its first entry
    top = place < k
    best, who = np.full((len(own), k), LOWEST), np.zeros((len(own), k), np.int64)
    best[q[top], place[top]], who[q[top], place[top]] = s[top], ids[r[top]]
    return best, who


class Best:
    """The k best rows so far of each query of a block; ``number`` tells queries of one id apart."""

    def __init__(self, number: np.ndarray, own: np.ndarray, wanted: np.ndarray, k: int):
        self.number, self.own, self.wanted, self.k = number, own, wanted, k
        self.scores, self.ids = np.full((len(own), k), LOWEST), np.zeros((len(own), k), np.int64)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        lists = postings(rows)
        step = max(1, SCORE_CELLS // len(ids))
        for at in range(0, len(self.own), step):
            part = slice(at, at + step)
            found, who = best_of(accumulate(self.wanted[part], lists, len(ids)), ids, self.own[part], self.k)
            found, who = np.hstack([self.scores[part], found]), np.hstack([self.ids[part], who])
            order = np.lexsort((who, -found), axis=1)[:, : self.k]
            self.scores[part], self.ids[part] = np.take_along_axis(found, order, 1), np.take_along_axis(who, order, 1)

    def listed(self) -> pa.RecordBatch:
        q, place = np.nonzero(self.scores > LOWEST)
        columns = self.number[q], self.own[q], self.ids[q, place], self.scores[q, place]
        return pa.record_batch([pa.array(c) for c in columns], names=["number", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best rows other than its own id.

    Both are stored tables with ``vec_id, v`` (see :func:`integer_vectors`) and ``number``,
    which tells rows apart. All rows of the query's own id are left out; several other rows
    of one id are candidates each, and several queries of one id get their rows each. Scores
    are integer inner products (missing components count as 0); ties go to the smaller
    vec_id; a query with fewer candidates gets all of them. Empty tables give no rows. Every row goes to each block of queries once; a block has ``query_block`` queries
    on average.
    """
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, math.ceil(queries.count() / query_block))
    row_blocks = max(1, min(math.ceil(GROUPS * parts / blocks), math.ceil(vectors.count() / row_block)))
    own_block = lambda n: F.pmod(F.xxhash64("number"), F.lit(n)).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("number", "vec_id", "v", own_block(blocks).alias("_q"), F.lit(0).alias("_row")).withColumn("_r", every_block(row_blocks))
    held = vectors.select("number", "vec_id", "v", own_block(row_blocks).alias("_r"), F.lit(1).alias("_row")).withColumn("_q", every_block(blocks))
    group = ["_q", "_r"]
    dealt = asked.unionByName(held).repartition(parts, *group).sortWithinPartitions(*group, "_row", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best, waiting = None, None, []
        for b in batches:
            q, r, row = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((np.diff(q) != 0) | (np.diff(r) != 0) | (np.diff(row) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, b.num_rows]):
                if start == end:
                    continue
                if at != (q[start], r[start]):
                    if best is not None:
                        yield best.listed()
                    at, best, waiting = (q[start], r[start]), None, []
                numbers, ids, v = (b.column(i)[start:end] for i in (3, 4, 5))
                if row[start] == 0:
                    waiting.append((numbers, ids, v))
                    continue
                if best is None:
                    if not waiting:
                        continue  # no queries in this block
                    width = max(max(x.value_lengths().to_pylist(), default=0) for *_, x in waiting)
                    number, own = (np.concatenate([w[i].to_numpy() for w in waiting]) for i in (0, 1))
                    best = Best(number, own, np.concatenate([_dense(x, width) for *_, x in waiting]), k)
                best.add(ids.to_numpy(), _dense(v, best.wanted.shape[1]))
        if best is not None:
            yield best.listed()

    merged = dealt.select(*group, "_row", "number", "vec_id", "v").mapInArrow(run, "number long, query_id long, vec_id long, score long")
    best = W.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    return (
        merged.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def top_k_every(vectors: DataFrame, every: int = 50, k: int = 5, **names) -> DataFrame:
    """:func:`top_k` of the rows whose id is divisible by ``every``, against all rows."""
    whole = materialize(integer_vectors(vectors, **names).withColumn("number", F.monotonically_increasing_id()))
    return top_k(whole, whole.where(F.col("vec_id") % every == 0), k)
