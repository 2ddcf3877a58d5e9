"""Best-fit packing of tokenised documents into fixed-length sequences.

Only an item's *length* decides where it goes, so packing is planned on the histogram of
lengths (at most ``capacity`` numbers, whatever the corpus size) and then carried out by
a distributed rank within each length:

1. tokenise, cut long documents into pieces, write the piece table once;
2. count pieces by length (partial aggregation, at most ``capacity`` rows in the end);
3. ``plan_bins``: items above a third of the capacity are matched at most two to a bin,
   greedily (each with the largest partner that still fits); smaller items then go, in
   descending length, into the tightest gap that holds them;
4. rank pieces within (length, salt), with as many salts as a length's count asks for, and
   join the plan, whose rows say which ranks of a length go to which run of bins.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import held, id_text, materialize, slices
from .pretokens import Splitter

CAPACITY = 2048
#: Groups for ranking, for each shuffle partition; a length has its share of them.
RANK_GROUPS = 4


class IdEncoder(dict):
    """Token ids of whole texts as little-endian uint32 bytes, through a cache of pre-tokens.

    Merges never cross a pre-token, so the ids of a text are those of its pre-tokens in
    turn; a pre-token that the cache does not hold goes to the tokenizer's merge model.
    Tokens that the tokenizer's file adds to the model, such as the end of a text, are cut
    out first, as the library does; each stretch between them is a text of its own.
    """

    def __init__(self, path: str, limit: int = 200_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model
        self.added: dict[str, bytes] = {}
        for at, token in tokenizer.get_added_tokens_decoder().items():
            if token.lstrip or token.rstrip or token.single_word:
                raise ValueError(f"added token {token.content!r}: only plain ones are supported")
            self.added[token.content] = at.to_bytes(4, "little")
        # the longest of those that start at one place
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.bytes = dict(enumerate(byte_alphabet()))
        self.splitter = Splitter()
        self.limit = limit

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        # one character for each byte, as translate() and the model's vocabulary need
        found = self.model.tokenize(word.encode().decode("latin-1").translate(self.bytes))
        ids = self[word] = b"".join(t.id.to_bytes(4, "little") for t in found)
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        get, split = self.__getitem__, self.splitter.split
        out = []
        for t in texts:
            if any(token in t for token in self.added):
                parts = self.cut.split(t)  # every second one is an added token
                out.append(b"".join(self.added[x] if i % 2 else b"".join(map(get, split(x))) for i, x in enumerate(parts)))
            else:
                out.append(b"".join(map(get, split(t))))
        return out


def encoder(path: str) -> IdEncoder:
    """One per Python worker: its cache serves all tasks of packing the worker runs."""
    return held(("encoder", path), lambda: IdEncoder(path))


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece of each document: its ids, then ``end_id``.

    A document longer than ``capacity`` is cut into pieces of exactly ``capacity``, save
    the first, which takes the remainder. Null or empty texts give one piece that holds
    just ``end_id``. Repeated rows are packed as often as they occur.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for b in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())):
                ids = memoryview(ids + end)
                total = len(ids) // 4
                start, stop = 0, total % capacity or capacity
                for piece in range((total + capacity - 1) // capacity):
                    for column, v in zip(out, (doc, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]))):
                        column.append(v)
                    start, stop = stop, stop + capacity
            yield pa.record_batch(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return id_text(docs).mapInArrow(run, PIECE_SCHEMA)


@dataclass
class Run:
    """``bins`` like bins, numbered from ``first``, each filled up to ``used``."""

    first: int
    bins: int
    used: int


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where each rank of each length goes.

    Rows (length, rank_from, rank_to, per_bin, first_bin, offset): the item of rank r
    (rank_from <= r < rank_to) goes to bin ``first_bin + (r - rank_from) // per_bin`` at
    ``offset + length * ((r - rank_from) % per_bin)``. Every step either uses up a length
    or a run of like bins, so there are a few rows for each length at most, and the work
    does not depend on how many items there are.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    moves: list[tuple[int, int, int, int, int, int]] = []
    taken = dict.fromkeys(left, 0)
    next_bin = 0
    gaps: dict[int, list[Run]] = {}
    free: list[int] = []  # the gaps that occur, ascending

    def place(length: int, run: Run, per_bin: int) -> None:
        moves.append((length, taken[length], taken[length] + run.bins * per_bin, per_bin, run.first, run.used))
        taken[length] += run.bins * per_bin
        left[length] -= run.bins * per_bin

    def keep(run: Run) -> None:
        gap = capacity - run.used
        if gap and run.bins:
            if gap not in gaps:
                bisect.insort(free, gap)
                gaps[gap] = []
            gaps[gap].append(run)

    def open_bins(n: int) -> Run:
        nonlocal next_bin
        run = Run(next_bin, n, 0)
        next_bin += n
        return run

    large = sorted(n for n in left if 3 * n > capacity)
    unmatched = list(large)  # ascending; lengths whose items are not all placed
    for a in reversed(large):
        while left[a]:
            at = bisect.bisect_right(unmatched, capacity - a) - 1
            while at >= 0 and (left[unmatched[at]] == 0 or (unmatched[at] == a and left[a] < 2)):
                at -= 1
            if at < 0:
                run = open_bins(left[a])
                place(a, run, 1)
                keep(Run(run.first, run.bins, a))
            elif (b := unmatched[at]) == a:
                run = open_bins(left[a] // 2)
                place(a, run, 2)
                keep(Run(run.first, run.bins, 2 * a))
            else:
                run = open_bins(min(left[a], left[b]))
                place(a, run, 1)
                place(b, Run(run.first, run.bins, a), 1)
                keep(Run(run.first, run.bins, a + b))
        unmatched = [n for n in unmatched if left[n]]
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            at = bisect.bisect_left(free, s)
            if at == len(free):
                per = capacity // s
                keep(open_bins(-(-left[s] // per)))
                continue
            gap = free[at]
            run = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], free[at]
            per = gap // s
            full = min(run.bins, left[s] // per)
            if full:
                place(s, Run(run.first, full, run.used), per)
                keep(Run(run.first, full, run.used + per * s))
            run = Run(run.first + full, run.bins - full, run.used)
            if run.bins and (rest := min(left[s], per)):
                place(s, Run(run.first, 1, run.used), rest)
                keep(Run(run.first, 1, run.used + rest * s))
                run = Run(run.first + 1, run.bins - 1, run.used)
            keep(run)
    return moves


def pack(items: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``items``, which has a ``length`` column.

    ``items`` is read three times and must be stable (a written table). ``order`` names
    columns that tell rows apart; rows equal in all of them are interchangeable. An empty
    table gives an empty result.
    """
    spark = items.sparkSession
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(
        plan_bins(histogram, capacity) or [],
        "p_length long, p_from long, p_to long, p_per long, p_first long, p_offset long",
    )
    # a length gets groups by its own count, so that one that a third of all pieces have
    # fills many tasks; in all there are at most ``groups`` and one for each length
    groups = RANK_GROUPS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = max(1, -(-sum(histogram.values()) // groups))
    salts = spark.createDataFrame([(n, -(-c // each)) for n, c in histogram.items()], "length long, _salts long")
    salted = items.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64(*order), F.col("_salts")))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = salted.join(F.broadcast(bases), ["length", "_salt"]).withColumn(
        "_rank", F.col("_base") + F.row_number().over(W.partitionBy("length", "_salt").orderBy(*order)) - 1
    )
    # the plan is bounded by the capacity (a few rows for each length), never by the data
    placed = ranked.join(
        F.broadcast(plan),
        (F.col("length") == F.col("p_length")) & (F.col("_rank") >= F.col("p_from")) & (F.col("_rank") < F.col("p_to")),
    )
    step = F.col("_rank") - F.col("p_from")
    return placed.select(
        *items.columns,
        (F.col("p_first") + F.floor(step / F.col("p_per"))).cast("long").alias("sequence_id"),
        (F.col("p_offset") + F.col("length") * (step % F.col("p_per"))).cast("long").alias("offset"),
    )


def best_fit_pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Tokenise ``docs`` and pack all of it: one row per piece with its place.

    See :func:`pieces` for nulls, empty and long texts. Columns of ``docs`` other than
    ``doc_id`` and ``text`` play no part. Offsets in a sequence are gapless from 0.
    """
    table = materialize(pieces(docs, tokenizer_path, capacity, end_id))
    return pack(table, ["doc_id", "piece", "start", "ids_crc32"], capacity)
