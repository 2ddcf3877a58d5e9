"""Removal of long strings of bytes that occur more than once, by shards of suffix arrays.

1. Every window of ``length`` bytes belongs to the smallest hash of the ``gram`` bytes long
   strings in it (its key), so equal windows have equal keys wherever they are. Neighbouring
   windows with one key form a run, whose bytes are its context: a short row for every 80 or
   so bytes, without the text.
2. Keys that occur once are dropped. Contexts are counted: one that occurs twice as a whole
   is removed as a whole. Of keys with contexts that differ, each distinct context is fetched
   once from its text.
3. Contexts that agree with no other of their key on enough bytes beside the key's string are
   left out. Shards are filled with the others, all those of a key in one. Each is sorted by
   its induced suffix array, and permuted common prefixes tell which windows occur twice.
4. Spans come back to their texts, are merged and removed.

A key with more distinct contexts than a shard may hold has its windows counted one by one
instead, by digest, so no group is bound to one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices
from .suffix_array import common_prefixes, suffix_array

#: Bytes of a repeated string, and of the strings in it that keys are made of.
LENGTH, GRAM = 200, 50
#: Windows in a run and bytes hashed in one go; bytes of a shard, and those of one key, at most.
RUN, BLOCK, SHARD, KEY = 4096, 1 << 20, 2_000_000, 8_000_000

_MUL, _ADD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)

RUNS = "key long, digest long, doc_id long, copy long, start long, windows int, twice boolean"


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` bytes long string, put together from those half as long."""
    one = (data.astype(np.uint64) + np.uint64(1)) * _ADD
    out, size = one, 1
    for bit in bin(gram)[3:]:
        out = out[: len(out) - size] * np.uint64(pow(int(_MUL), size, 1 << 64)) + out[size:]
        size *= 2
        if bit == "1":
            out = out[:-1] * _MUL + one[size : size + len(out) - 1]
            size += 1
    out = (out ^ (out >> np.uint64(29))) * _MIX
    return out ^ (out >> np.uint64(32))


def _sliding(best: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values, size = best(values[: len(values) - size], values[size:]), 2 * size
    return best(values[: len(values) - width + size], values[width - size :]) if size < width else values


def runs(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """``key, first window, end of windows, twice`` of the runs in texts that lie one after
    another in ``data``, each from one of ``starts`` on."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none.astype(bool)
    width = length - gram + 1
    hashes = gram_hashes(data, gram)
    least = _sliding(np.minimum, hashes, width)
    ends = np.append(starts[1:], len(data)) - length + 1
    lo = np.union1d(np.flatnonzero(np.diff(least)) + 1, starts[starts < len(least)])
    hi = np.append(lo[1:], len(least))
    hi = np.minimum(hi, ends[np.searchsorted(starts, lo, "right") - 1])
    lo, hi = lo[lo < hi], hi[lo < hi]
    if len(lo) and (hi - lo).max() > RUN:
        cut = [np.arange(a, b, RUN) if b - a > RUN else np.array([a]) for a, b in zip(lo, hi)]
        stop = np.repeat(hi, [len(c) for c in cut])
        lo = np.concatenate(cut)
        hi = np.minimum(lo + RUN, stop)
    # where a key's string occurs twice within the windows of a run, they may repeat in it
    most = _sliding(np.maximum, np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width)
    anchors = np.flatnonzero(hashes == most)
    near = (np.diff(anchors) <= width) & (hashes[anchors[1:]] == hashes[anchors[:-1]])
    keys = least[lo]
    return keys, lo, hi, np.isin(keys, hashes[anchors[1:][near]]) if near.any() else np.zeros(len(lo), bool)


def _pieces(offsets: np.ndarray, overlap: int) -> Iterator[tuple[int, int, int, int]]:
    """``first text, last text, from, to``: texts together, up to a block of bytes; a longer
    text alone, block by block with an overlap."""
    at, n = 0, len(offsets) - 1
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        if offsets[stop] - offsets[at] <= BLOCK:
            yield at, stop, int(offsets[at]), int(offsets[stop])
        else:
            for a in range(int(offsets[at]), int(offsets[stop]) - overlap, BLOCK):
                yield at, stop, a, min(a + BLOCK + overlap, int(offsets[stop]))
        at = stop


def context_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The runs of all texts, with a digest of each one's context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, copies = b.column(0), b.column(1)
            texts = b.column(2)
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            for first, last, a, z in _pieces(offsets, length - 1):
                starts = np.maximum(offsets[first:last], a) - a
                # an empty text has the start of the next one
                real = np.flatnonzero(np.diff(np.append(starts, z - a)) > 0)
                keys, lo, hi, twice = runs(data[a:z], starts[real], length, gram)
                whole = memoryview(data[a:z])
                digests = [int.from_bytes(blake2b(whole[s : e + length - 1], digest_size=8).digest(), "little", signed=True) for s, e in zip(lo.tolist(), hi.tolist())]
                owner = first + real[np.searchsorted(starts[real], lo, "right") - 1]
                yield pa.record_batch(
                    [
                        pa.array(keys.view(np.int64)), pa.array(digests, pa.int64()), ids.take(pa.array(owner)), copies.take(pa.array(owner)),
                        pa.array(lo + a - offsets[owner]), pa.array((hi - lo).astype(np.int32)), pa.array(twice),
                    ],
                    names=["key", "digest", "doc_id", "copy", "start", "windows", "twice"],
                )

    return docs.select("doc_id", "copy", F.col("text").cast("binary")).mapInArrow(run, RUNS)


def _beside_texts(docs: DataFrame, rows: DataFrame, extra: list[str]) -> DataFrame:
    """Each text (``kind`` 0), followed by its rows by ``start`` (``kind`` 1)."""
    more = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in extra]
    held = docs.select("doc_id", "copy", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("start"), F.col("text").cast("binary").alias("text"), *more)
    rows = rows.select("doc_id", "copy", F.lit(1).alias("kind"), "start", F.lit(None).cast("binary").alias("text"), *extra)
    return held.unionByName(rows).repartition("doc_id", "copy").sortWithinPartitions("doc_id", "copy", "kind", "start")


def _by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, int, list[tuple]]]:
    """``doc_id, copy, text, how often, its rows`` of what :func:`_beside_texts` lays out."""
    at, text, times, rows = None, b"", 0, []
    for b in slices(batches, 1024):
        columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
        for i, key in enumerate(zip(columns[0], columns[1])):
            if key != at:
                if times:
                    yield *at, text, times, rows
                at, times, rows = key, 0, []
            if columns[2][i] == 0:
                text, times = columns[4][i], times + 1
            else:
                rows.append((columns[3][i], *(c[i] for c in columns[5:])))
    if times:
        yield *at, text, times, rows


CONTEXTS = "key long, alone boolean, n long, doc_id long, copy long, start long, context binary"


def fetched(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The contexts of the runs in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["key", "alone", "n", "doc_id", "copy", "start", "context"]
        waiting: list[tuple] = []
        make = lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        for doc_id, copy, text, _, rows in _by_text(batches):
            for start, windows, key, n in rows:
                waiting.append((key, n == 1, n, doc_id, copy, start, text[start : start + windows + length - 1]))
                if len(waiting) == 2048:
                    yield make(waiting)
                    waiting = []
        if waiting:
            yield make(waiting)

    return _beside_texts(docs, wanted, ["windows", "key", "n"]).mapInArrow(run, CONTEXTS)


SPANS = "doc_id long, copy long, start long, end long"
_SPAN_NAMES = ["doc_id", "copy", "start", "end"]


def repeated_windows(contexts: list[bytes], length: int) -> np.ndarray:
    """Places, in the contexts laid end to end with one symbol behind each, of the windows
    that occur more than once."""
    sizes = np.array([len(c) + 1 for c in contexts])
    ends = np.cumsum(sizes)
    text = np.zeros(int(ends[-1]) + 1, np.int64)
    text[:-1] = np.frombuffer(b"\0".join([*contexts, b""]), np.uint8)
    text[:-1] += 2
    text[ends - 1] = 1  # below all bytes, so no string with it is a window
    order = suffix_array(text)
    alike = common_prefixes(text, order)[order] >= length
    found = np.zeros(len(text), bool)
    found[order] = alike | np.append(alike[1:], False)
    found = np.flatnonzero(found)
    return found[found + length < ends[np.searchsorted(ends, found, "right")]]


def may_repeat(held: list[tuple[int, bytes]], length: int, gram: int) -> np.ndarray:
    """Which contexts, each with its key, may hold a window that occurs more than once in them.

    A window's key is the hash of a string in it, its anchor, with at least half of the other
    bytes on one side. Equal windows lie alike about equal anchors, so two anchors of one key
    must agree on so many bytes before them, or behind them; contexts of which no anchor agrees
    with another hold none. Bytes are told by their hash, which can only keep too many.
    """
    half = (length - gram + 1) // 2
    keys = np.array([k for k, _ in held], np.int64)
    begins = np.cumsum([0, *(len(c) for _, c in held)])
    data = np.frombuffer(b"".join(c for _, c in held), np.uint8)
    hashes, longer = gram_hashes(data, gram), gram_hashes(data, gram + half)
    owner = np.repeat(np.arange(len(held)), np.diff(begins))[: len(hashes)]
    at = np.flatnonzero(hashes == keys.view(np.uint64)[owner])
    owner = owner[at]
    inside = at + gram <= begins[owner + 1]
    at, owner = at[inside], owner[inside]
    out = np.zeros(len(held), bool)
    for first in (at - half, at):
        whole = (first >= begins[owner]) & (first + gram + half <= begins[owner + 1])
        of, seen = owner[whole], longer[first[whole]]
        order = np.lexsort((seen, keys[of]))
        of, seen = of[order], seen[order]
        same = (seen[1:] == seen[:-1]) & (keys[of[1:]] == keys[of[:-1]])
        out[of[1:][same]] = out[of[:-1][same]] = True
    return out


def shard_spans(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """Spans of repeated windows in contexts that occur once as a whole."""

    def solved(held: list[tuple]) -> pa.RecordBatch:
        texts = [row[-1] for row in held]
        at = repeated_windows(texts, length) if texts else np.zeros(0, np.int64)
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
        first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        last = np.append(first[1:], len(at)) - 1
        if len(at):
            owner = np.searchsorted(begins, at[first], "right") - 1
            rows = [(held[o][3], held[o][4], held[o][5] + a, held[o][5] + z) for o, a, z in zip(owner.tolist(), (at[first] - begins[owner]).tolist(), (at[last] - begins[owner] + length).tolist()) if held[o][1]]
        else:
            rows = []
        return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 4)], names=_SPAN_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what comes is looked through first, so a shard is filled with what may repeat
        held, size, waiting, more, key = [], 0, [], 0, None

        def looked_through() -> None:
            nonlocal held, size, waiting, more
            found = [waiting[i] for i in np.flatnonzero(may_repeat([(row[0], row[-1]) for row in waiting], length, gram))]
            held, size = held + found, size + sum(len(row[-1]) for row in found)
            waiting, more = [], 0

        for b in slices(batches, 1024):
            for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                if more > SHARD and row[0] != key:
                    looked_through()
                    if size > SHARD:
                        yield solved(held)
                        held, size = [], 0
                key = row[0]
                waiting.append(row)
                more += len(row[-1])
        if waiting:
            looked_through()
        if held:
            yield solved(held)

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(run, SPANS)


def counted_spans(contexts: DataFrame, length: int) -> DataFrame:
    """The same for keys with too many contexts for a shard: windows meet by their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            out = []
            for _, alone, n, doc_id, copy, start, text in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                for at in range(len(text) - length + 1):
                    digest = blake2b(text[at : at + length], digest_size=16).digest()
                    out.append((digest, n, alone, doc_id, copy, start + at))
            kinds = [pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["digest", "n", "alone", "doc_id", "copy", "start"])

    windows = materialize(contexts.mapInArrow(run, "digest binary, n long, alone boolean, doc_id long, copy long, start long"))
    often = windows.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest")
    found = windows.where("alone").join(often, "digest", "left_semi")
    return found.select("doc_id", "copy", "start", (F.col("start") + length).alias("end"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, key_bytes: int = KEY) -> DataFrame:
    """``doc_id, copy, start, end``: bytes covered by strings that occur twice; spans may overlap.

    ``docs`` has ``doc_id, copy, text`` (see :func:`without_repeats`).
    """
    if not 0 < gram <= length:
        raise ValueError("gram must be positive and not above length")
    every = materialize(context_runs(docs, length, gram))
    often = materialize(every.groupBy("key").agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("n")).where("n > 1").select("key"))
    kept = materialize(every.join(often, "key", "left_semi"))
    context = ["key", "digest", "windows"]
    first = F.min(F.struct("doc_id", "copy", "start")).alias("first")
    counted = materialize(kept.groupBy(*context).agg(F.count("*").alias("n"), F.max("twice").alias("twice"), first))
    size = F.sum(F.col("windows") + (length - 1)).alias("size")
    mixed = counted.groupBy("key").agg(F.count("*").alias("contexts"), F.max("twice").alias("twice"), size)
    mixed = mixed.where("contexts > 1 OR twice").select("key", (F.col("size") > key_bytes).alias("large"))
    wanted = materialize(counted.drop("twice").join(mixed, "key").select("first.*", "windows", "key", "n", "large"))
    # a context that occurs twice is repeated from end to end
    whole = kept.join(counted.where("n > 1").select(*context), context)
    whole = whole.select("doc_id", "copy", "start", (F.col("start") + F.col("windows") + (length - 1)).alias("end"))
    spans = whole.unionByName(shard_spans(fetched(docs, wanted.where("NOT large").drop("large"), length), length, gram))
    large = wanted.where("large").drop("large")
    if large.isEmpty():
        return spans
    return spans.unionByName(counted_spans(fetched(docs, large, length), length))


KEPT = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def without_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, key_bytes: int = KEY) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: each text as UTF-8 without the bytes covered by a
    ``length`` bytes long string that starts anywhere else too, in the same text or another.

    ``spans`` are the maximal removed runs. Overlapping occurrences count; strings are judged
    on the whole input. A null text is empty; ids may be null or repeated (rows with one id
    and different texts are told apart by their texts; equal rows are copies of each other,
    and each gives its row); an empty table gives none; other columns are dropped.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("copy"), text.alias("text"))
    spans = repeated_spans(docs, length, gram, key_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        waiting, size = [], 0
        make = lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "n_bytes", "spans", "kept"])
        for doc_id, _, text, times, rows in _by_text(batches):
            merged: list[list[int]] = []
            for start, end in rows:
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([start, end])
            edges = [0, *(x for span in merged for x in span), len(text)]
            kept = b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2]))
            row = (doc_id, len(text), [{"start": a, "end": z} for a, z in merged], kept)
            for _ in range(times):
                waiting.append(row)
                size += len(kept)
                if len(waiting) == 512 or size > BLOCK:
                    yield make(waiting)
                    waiting, size = [], 0
        if waiting:
            yield make(waiting)

    return _beside_texts(docs, spans, ["end"]).mapInArrow(run, KEPT)
