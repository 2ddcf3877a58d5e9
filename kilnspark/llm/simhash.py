"""SimHash fingerprints and an exact search for all fingerprints within a Hamming radius.

Terms are pairs of neighbouring words (with an edge mark at both ends of the text); each
votes, as often as it occurs, on the signed bits of its 128-bit hash. Texts of fewer than
``SHORT`` words also vote with their runs of four characters, so that a few words still
make a graded fingerprint.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialize, slices, spread_join

BITS = 128
SHORT = 16
#: Bits of 128. Wider radii find more edited copies, but need more or less selective tables.
RADIUS = 6
#: Fingerprints alike in two neighbouring blocks beyond which links are counted round a centre.
CROWD = 64
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixing of each value (multiply and xor-shift rounds)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHashes:
    """64-bit hashes of words, each distinct word hashed once."""

    def __init__(self, limit: int = 500_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if new := set(words).difference(self.known):
            if len(self.known) + len(new) > self.limit:
                self.known.clear()
                new = set(words)
            for w in new:
                self.known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def term_hashes(text: str, word_hashes: WordHashes) -> np.ndarray:
    words = word_hashes(text.encode().lower().split())
    edged = np.concatenate([np.zeros(1, np.uint64), words, np.zeros(1, np.uint64)])
    terms = edged[:-1] * _ODD[0] + edged[1:]
    if len(words) < SHORT:
        chars = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.uint64)
        runs = np.zeros(max(0, len(chars) - 3), np.uint64)
        for at in range(4):
            runs = runs * np.uint64(0x100000001B3) + chars[at : at + len(runs)]
        terms = np.concatenate([terms, runs + _ODD[1]])
    return mix(terms)


#: Bits of every byte as votes 0 and 1.
_BYTE_VOTES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int32)


def fingerprint(terms: np.ndarray) -> bytes:
    """Bit i is set if more than half of the votes of all terms say so."""
    wide = np.stack([terms, mix(terms + _ODD[1])], axis=1).view(np.uint8)  # terms x 16 bytes
    ones = np.empty(BITS, np.int64)
    if len(terms) < 64:
        ones[:] = np.unpackbits(wide, axis=1).sum(axis=0)
    else:
        for at in range(BITS // 8):  # counting equal bytes first leaves 256 rows to add up
            ones[8 * at : 8 * at + 8] = np.bincount(wide[:, at], minlength=256) @ _BYTE_VOTES
    return np.packbits(2 * ones > len(terms)).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits, 0 to 1."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


def edited(text: str, following: str) -> str:
    """``text``, its last quarter replaced by as many first characters of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


#: Buckets of consecutive ids for each shuffle partition.
BUCKETS = 4


class Buckets:
    """Where a row stands among cuts of the order (id, then hash of the text).

    An id that comes up among the quantiles more than once is frequent; its rows are cut by
    the hash, which is spread evenly. All is a few numbers for each bucket.
    """

    def __init__(self, quantiles: list[int]):
        self.keys, n = np.unique(np.array(quantiles, np.int64), return_counts=True)
        self.frequent = bool((n > 1).any())
        self.first = np.concatenate([[0], np.cumsum(n)])  # cuts before each key's
        self.splits = n
        self.heads: np.ndarray = np.zeros(0, np.int64)

    def place(self, key: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The number of cuts at or below each (key, h)."""
        at = np.searchsorted(self.keys, key, side="right")
        here = self.first[at]
        same = (at > 0) & (self.keys[np.maximum(at - 1, 0)] == key) if len(self.keys) else np.zeros(len(key), bool)
        n = self.splits[at[same] - 1]
        # the first cut of a key is at its lowest hash, the others divide the range of hashes
        share = (h[same].astype(float) + 2.0**63) / 2.0**64
        here[same] -= n - 1 - np.minimum((share * n).astype(np.int64), n - 1)
        return here


def with_next(docs: DataFrame) -> DataFrame:
    """Rows in buckets of consecutive ids, each bucket followed by the row that comes next.

    Columns ``_bucket, _extra, doc_id, text``; each partition holds whole buckets in order.
    The first row of a bucket is copied to the end of the bucket before it (``_extra`` =
    1), the very first to the end of the last, so no window over all rows is needed. Only
    the bounds of the buckets, ``BUCKETS`` for each partition, pass through the driver.
    """
    spark = docs.sparkSession
    rows = id_text(docs).withColumn("_k", F.coalesce("doc_id", F.lit(-(2**63))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = BUCKETS * parts
    at = [i / n for i in range(1, n)]
    found = rows.select(F.col("_k").cast("double")).approxQuantile("_k", at, 0.25 / n)
    buckets = Buckets([min(int(c), 2**63 - 1) for c in found])
    # texts are hashed for their place only where an id is frequent
    h = F.xxhash64("text") if buckets.frequent else F.lit(0).cast("long")
    held = spark.sparkContext.broadcast(buckets)

    @F.pandas_udf("long")
    def bucket(k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(held.value.place(k.to_numpy(), h.to_numpy()))

    heads = rows.select("_k", h.alias("_h"), bucket("_k", h).alias("_bucket")).groupBy("_bucket").agg(F.min(F.struct("_k", "_h")).alias("head"))
    heads = sorted((r["head"]["_k"], r["head"]["_h"], r["_bucket"]) for r in heads.collect())
    keys, hashes, own = (np.array(c, np.int64) for c in zip(*heads)) if heads else (np.zeros(0, np.int64),) * 3
    held_heads = spark.sparkContext.broadcast((keys, hashes, np.roll(own, 1)))

    @F.pandas_udf("array<struct<b:long,x:int>>")
    def places(k: pd.Series, h: pd.Series) -> pd.Series:
        """The row's own bucket and, for the first of it, the one before."""
        keys, hashes, before = held_heads.value
        k, h = k.to_numpy(), h.to_numpy()
        own = held.value.place(k, h)
        out = [[{"b": b, "x": 0}] for b in own.tolist()]
        low, high = (np.searchsorted(keys, k, side=s) for s in ("left", "right"))
        for i in np.flatnonzero(low < high):
            out[i] += [{"b": int(before[j]), "x": 1} for j in range(low[i], high[i]) if hashes[j] == h[i]]
        return pd.Series(out)

    return (
        rows.select(F.explode(places("_k", h)).alias("_at"), "_k", "doc_id", "text")
        .select(F.col("_at.b").alias("_bucket"), F.col("_at.x").alias("_extra"), "_k", F.xxhash64("text").alias("_h"), "doc_id", "text")
        .repartition(parts, "_bucket")
        .sortWithinPartitions("_bucket", "_extra", "_k", "_h", "text")
        .select("_bucket", "_extra", "doc_id", "text")
    )


_WORDS = WordHashes()
FINGERPRINT_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The edited text is the text with its last quarter (``n_chars // 4`` code points)
    replaced by as many first ones of the next document (ascending doc_id, then hash of the
    text, then text; the first follows the last). Null texts are empty; the fingerprint of no terms has no bit
    set. Null ids come first in the order. Equal texts have equal fingerprints. Repeated
    rows are each other's next. Other columns of ``docs`` play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in slices(batches):
            out: list[list] = [[] for _ in range(7)]
            for bucket, extra, doc, text in zip(*(c.to_pylist() for c in b.columns)):
                mark = fingerprint(term_hashes(text, _WORDS))
                if last is not None and last[:2] == (bucket, 0):
                    _, _, was, before, own = last
                    new = edited(before, text)
                    changed = fingerprint(term_hashes(new, _WORDS))
                    row = (was, len(before), hashlib.sha256(new.encode()).hexdigest(), own.hex(), changed.hex())
                    for column, v in zip(out, (*row, likeness(own, changed), likeness(own, mark))):
                        column.append(v)
                last = (bucket, extra, doc, text, mark)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = [f.split()[0] for f in FINGERPRINT_SCHEMA.split(", ")]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return with_next(docs).mapInArrow(run, FINGERPRINT_SCHEMA)


def halves(hexed: Column) -> list[Column]:
    """The fingerprint as two longs, for bit arithmetic."""
    return [F.conv(F.substring(hexed, at, 16), 16, -10).cast("long") for at in (1, 17)]


def _hexed(high: Column, low: Column) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(x), 16, "0") for x in (high, low))))


def _tables(marks: DataFrame, radius: int, balls: DataFrame | None = None) -> tuple[DataFrame, Column]:
    """``hi, lo, table, key`` of each distinct fingerprint in every table, and the condition
    under which two of a key, called ``a`` and ``b``, are a pair of that table.

    The digits fall into radius + 2 blocks, of which at least two are equal in any pair
    within the radius. There is a table for each two blocks; a pair belongs to the table of
    its first two equal blocks, so it comes up once although others hold it too.

    Spark takes the rows of all tables for no more bytes than the fingerprints have on disk,
    and would broadcast them. So every join of them, and of other tables that Parquet packs
    tightly, says how it is done.
    """
    digits, blocks = BITS // 4, radius + 2
    edges = [digits * i // blocks for i in range(blocks + 1)]
    high, low = halves(F.col("fingerprint"))
    one = marks.where(F.col("fingerprint").isNotNull()).select(high.alias("hi"), low.alias("lo")).distinct()
    one = one if balls is None else one.join(balls.hint("merge"), ["hi", "lo"], "left")
    masks = []
    for start, end in itertools.pairwise(edges):
        mask = (16 ** (end - start) - 1) << 4 * (digits - end)
        masks.append([F.lit(half - (half >> 63 << 64)).cast("long") for half in (mask >> 64, mask & (1 << 64) - 1)])
    within = lambda b: (F.col("hi").bitwiseAND(masks[b][0]), F.col("lo").bitwiseAND(masks[b][1]))
    # a hash of two blocks as key is half as wide; it can only add candidates
    keys = [
        F.struct(F.lit(1 << i | 1 << j).alias("table"), F.xxhash64(F.lit(i), F.lit(j), *within(i), *within(j)).alias("key"))
        for i, j in itertools.combinations(range(blocks), 2)
    ]
    table = one.select(*one.columns, F.inline(F.array(*keys)))
    other = [F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}")) for c in ("hi", "lo")]
    equal = F.lit(0)
    for b, mask in enumerate(masks):
        same = other[0].bitwiseAND(mask[0]).bitwiseOR(other[1].bitwiseAND(mask[1])) == 0
        equal = equal + F.when(same, 1 << b).otherwise(0)
    rest = equal.bitwiseAND(equal - 1)  # without the lowest bit
    first_two = equal - rest.bitwiseAND(rest - 1)
    pair = (F.col("a.key") == F.col("b.key")) & (_distance() <= radius) & (first_two == F.col("a.table"))
    return table, pair


def _distance() -> Column:
    return F.bit_count(F.col("a.hi").bitwiseXOR(F.col("b.hi"))) + F.bit_count(F.col("a.lo").bitwiseXOR(F.col("b.lo")))


def within_radius(marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs of distinct fingerprints that differ in at most ``radius`` bits.

    ``marks`` has a string column ``fingerprint`` (32 hex digits); equal ones count once,
    nulls never. Returns ``a, b, distance``, each pair once.
    """
    table, pair = _tables(marks, radius)
    before = (F.col("a.hi") < F.col("b.hi")) | ((F.col("a.hi") == F.col("b.hi")) & (F.col("a.lo") < F.col("b.lo")))
    return table.alias("a").hint("merge").join(table.alias("b"), pair & before).select(
        _hexed(F.col("a.hi"), F.col("a.lo")).alias("a"), _hexed(F.col("b.hi"), F.col("b.lo")).alias("b"), _distance().alias("distance")
    )


def _long(n: int) -> Column:
    return F.lit(n - (n >> 63 << 64)).cast("long")


def balls(marks: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """``hi, lo, ball_hi, ball_lo``: fingerprints within ``radius`` of the centre of a crowd.

    A crowd is more than ``crowd`` fingerprints of equal neighbouring blocks, its centre what
    most of them have at each bit. A fingerprint is in one ball at most, that of its largest
    crowd.
    """
    table, _ = _tables(marks, radius)
    rows = table.where(F.col("table").isin([1 << i | 1 << i + 1 for i in range(0, radius + 1, 2)]))
    sizes = rows.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > crowd)
    members = materialize(rows.join(sizes.hint("shuffle_hash"), "key").select("hi", "lo", "key", "m"))

    def majority(half: str) -> Column:
        ones = (F.sum(F.shiftrightunsigned(half, i).bitwiseAND(F.lit(1))) for i in range(64))
        bits = (F.when(2 * n > F.count("*"), _long(1 << i)).otherwise(_long(0)) for i, n in enumerate(ones))
        return functools.reduce(Column.bitwiseOR, bits)

    centres = members.groupBy("key").agg(majority("hi").alias("ball_hi"), majority("lo").alias("ball_lo"))
    far = F.bit_count(F.col("hi").bitwiseXOR(F.col("ball_hi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("ball_lo")))
    near = members.join(centres.hint("shuffle_hash"), "key").where(far <= radius)
    return near.groupBy("hi", "lo").agg(F.max(F.struct("m", "ball_hi", "ball_lo")).alias("_b")).select("hi", "lo", "_b.ball_hi", "_b.ball_lo")


def _inside(held: DataFrame, radius: int) -> DataFrame:
    """``hi, lo, n_near``: the other members of its ball within ``radius`` of each member.

    Members that differ from the centre in a and b bits, k of them the same, are a + b - 2k
    apart. How many have at least t of a member's bits follows from how many hold each subset
    of these (inclusion and exclusion), so no two members need meet: at most 2 ** radius rows
    for each.
    """
    n = radius + 1
    off = [F.col(c).bitwiseXOR(F.col(f"ball_{c}")) for c in ("hi", "lo")]
    every = F.array(*(F.struct(_long(b >> 64).alias("h"), _long(b & (1 << 64) - 1).alias("l")) for b in (1 << i for i in range(BITS))))
    flips = F.filter(every, lambda s: off[0].bitwiseAND(s["h"]).bitwiseOR(off[1].bitwiseAND(s["l"])) != 0)
    joined = lambda t, s: F.struct(t["h"].bitwiseOR(s["h"]).alias("h"), t["l"].bitwiseOR(s["l"]).alias("l"))
    nothing = F.array(F.struct(_long(0).alias("h"), _long(0).alias("l")))
    subsets = F.aggregate("_flips", nothing, lambda acc, s: F.concat(acc, F.transform(acc, lambda t: joined(t, s))))
    rows = materialize(held.withColumn("_flips", flips).select(*held.columns, F.size("_flips").alias("a"), F.inline(subsets)))
    by = ["ball_hi", "ball_lo", "h", "l"]
    holders = rows.groupBy(*by).agg(*(F.sum((F.col("a") == b).cast("long")).alias(f"c{b}") for b in range(n)))

    def factor(a: int, j: int, b: int) -> int:
        t = max(0, -((radius - a - b) // 2))
        return int(j == 0) if t == 0 else (-1) ** (j - t) * math.comb(j - 1, t - 1) if j >= t else 0

    factors = F.array(*(F.lit(factor(a, j, b)) for a in range(n) for j in range(n) for b in range(n)))
    j = F.bit_count("h") + F.bit_count("l")
    share = sum((F.get(factors, (F.col("a") * n + j) * n + b) * F.col(f"c{b}") for b in range(n)), F.lit(0))
    return rows.hint("merge").join(holders, by).groupBy("hi", "lo").agg((F.sum(share) - 1).alias("n_near"))


def near_counts(marks: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """``fingerprint, n_near``: how many others are within ``radius`` bits, where any are.

    Links between members of one ball (see :func:`balls`) are counted by what they differ in
    from its centre; all others in the join, and never listed.
    """
    held = materialize(balls(marks, radius, crowd))
    table, pair = _tables(marks, radius, held)
    other = (F.col("a.hi") != F.col("b.hi")) | (F.col("a.lo") != F.col("b.lo"))
    same = F.coalesce((F.col("a.ball_hi") == F.col("b.ball_hi")) & (F.col("a.ball_lo") == F.col("b.ball_lo")), F.lit(False))
    counts = table.alias("a").hint("merge").join(table.alias("b"), pair & other & ~same).groupBy("a.hi", "a.lo").agg(F.count("*").alias("n_near"))
    counts = counts.unionByName(_inside(held, radius)).groupBy("hi", "lo").agg(F.sum("n_near").alias("n_near")).where("n_near > 0")
    return counts.select(_hexed(F.col("hi"), F.col("lo")).alias("fingerprint"), "n_near")


def simhash_documents(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """:func:`fingerprints` and ``n_near``, the other fingerprints within ``radius`` bits."""
    table = materialize(fingerprints(docs))
    joined = spread_join(table, near_counts(table, radius), ["fingerprint"], "left", by="doc_id", small=True)
    return joined.select(*table.columns, F.coalesce("n_near", F.lit(0)).alias("n_near"))
