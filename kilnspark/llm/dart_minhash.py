"""Near-duplicate classes by DartMinHash signatures, banded joining and an exact check.

A weighted set throws darts: every element owns a region (weight x rank), cut into fixed
cells; a hash of element and cell says how many darts fall there, where, and to which of
the signature's coordinates each belongs. A coordinate keeps the dart of the lowest rank.
Two sets keep the same dart with a probability equal to their weighted Jaccard similarity,
and a set of any size throws about ``k ln k + 2 k`` darts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPREAD, held, id_text, materialize, most_frequent, remove, scope, slices, spread_join, text_key

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
#: Members of a bucket beyond which the shingles that few such members hold are counted.
CROWD = 16
#: Members of a bucket beyond which pairs that share a rare shingle are found by it; rare is
#: a shingle that at most so many members hold.
HUGE, RARE = 128, 32
#: Nodes, of 16 bytes each, up to which those that share a bucket, or are at one end of pairs, are broadcast.
BROADCAST_NODES = 1_000_000

_MUL = np.uint64(0xD6E8FEB86659FD93)
_S32 = np.uint64(32)
_G = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S32)) * _MUL
    x = (x ^ (x >> _S32)) * _MUL
    return x ^ (x >> _S32)


def _times_g(n: int) -> np.uint64:
    return np.uint64(n * int(_G) % 2**64)


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _poisson_table(mean: float) -> np.ndarray:
    """Cumulated probabilities of 0, 1, 2, ... events; in logarithms, so any mean will do."""
    n = np.arange(int(mean + 12 * math.sqrt(mean)) + 24)
    logs = n * math.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(n[1:]))])
    return np.cumsum(np.exp(logs))


class DartMinHash:
    """Signatures of ``k`` coordinates for weighted sets.

    Weights are cut into [0, 1), [1, 2), [2, 4), ...; ranks into [0, base), [base, 2 base),
    [2 base, 4 base), ..., with a base that falls as weights rise, so that first cells have
    the same area. A cell holds a Poisson number of darts with the mean of its area, drawn
    from the hash of (element, cell), so every set that contains the element sees the same
    darts.
    """

    def __init__(self, k: int, seed: int = 1, base: float = 1 / 16):
        self.k, self.base = k, base
        self.darts = k * math.log(k) + 2 * k
        self.seed = mix(np.array([seed], np.uint64))[0]
        self._tables: dict[float, np.ndarray] = {}

    @staticmethod
    def _weight_cell(c: int) -> tuple[float, float]:
        return (0.0, 1.0) if c == 0 else (2.0 ** (c - 1), 2.0**c)

    def _rank_base(self, wcell: int) -> float:
        return self.base / 2 ** max(0, wcell - 1)

    def _throw(self, elements, weights, owner, wcell: int, rcell: int):
        """Darts of one cell: owner, coordinate, rank and identity."""
        (wlo, whi), base = self._weight_cell(wcell), self._rank_base(wcell)
        rlo, rhi = (0.0, base) if rcell == 0 else (base * 2 ** (rcell - 1), base * 2**rcell)
        area = (whi - wlo) * (rhi - rlo)
        if area not in self._tables:
            self._tables[area] = _poisson_table(area)
        table = self._tables[area]
        cell = mix(elements + _times_g(1 + wcell * 64 + rcell) + self.seed)
        counts = np.searchsorted(table, _uniform(cell), side="right")
        hit = np.flatnonzero(counts)
        counts = counts[hit]
        at = np.repeat(hit, counts)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        dart = mix(cell[at] + (nth.astype(np.uint64) + np.uint64(1)) * _G)
        rank = rlo + (rhi - rlo) * _uniform(mix(dart + np.uint64(1)))
        if len(at) and weights[at].min() < whi:
            inside = wlo + (whi - wlo) * _uniform(mix(dart + np.uint64(2))) < weights[at]
            at, dart, rank = at[inside], dart[inside], rank[inside]
        return owner[at], (dart % np.uint64(self.k)).astype(np.int64), rank, dart

    def signatures(self, elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, sets: int) -> np.ndarray:
        """Rows of k dart identities; ``owner`` says to which of ``sets`` sets an element
        belongs. A set without weight has a row of zeros."""
        out = np.zeros((sets, self.k), np.uint64)
        total = np.bincount(owner, weights, sets)
        limit = np.full(sets, np.inf)
        np.divide(self.darts, total, out=limit, where=total > 0)
        todo = total > 0
        while todo.any():
            active = todo[owner]
            e, w, o = elements[active], weights[active], owner[active]
            found, wcell = [], 0
            while len(e):
                # rank cells up to the one that holds the limit; darts above it stay out
                need = np.ceil(np.log2(np.where(todo, limit, 1.0) / self._rank_base(wcell))).astype(int)
                cells = np.maximum(0, need) + 1
                for rcell in range(int(cells[o].max())):
                    near = cells[o] > rcell
                    found.append(self._throw(*((e, w, o) if near.all() else (e[near], w[near], o[near])), wcell, rcell))
                more = w > self._weight_cell(wcell)[1]
                e, w, o = e[more], w[more], o[more]
                wcell += 1
            own, coord, rank, dart = (np.concatenate(x) for x in zip(*found))
            low = rank < limit[own]
            own, coord, rank, dart = own[low], coord[low], rank[low], dart[low]
            slot = own * self.k + coord
            order = np.lexsort((dart, rank, slot))
            slot = slot[order]
            first = np.ones(len(slot), bool)
            first[1:] = slot[1:] != slot[:-1]
            out.reshape(-1)[slot[first]] = dart[order][first]
            got = np.bincount(slot[first] // self.k, minlength=sets)
            todo = todo & (got < self.k)  # rarely a coordinate is still empty: throw twice as far
            limit[todo] *= 2
        return out


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of each signature."""
    out = np.zeros((len(signatures), bands), np.uint64)
    for band in range(bands):
        h = np.full(len(signatures), _times_g(band + 1), np.uint64)
        for row in range(rows):
            h = mix(h ^ signatures[:, band * rows + row]) + _G
        out[:, band] = h
    return out


class Shingler:
    """Hashed runs of ``words`` lower-cased words of a text, ascending, and how often each occurs.

    A text with fewer words has one shingle, all of it; a text without words has none.
    """

    def __init__(self, words: int = WORDS, limit: int = 100_000):
        self.words, self.limit = words, limit
        self.known: dict[bytes, int] = {}

    def tokens(self, text: str) -> list[bytes]:
        return text.encode().lower().split()

    def shingles(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if new := set(tokens).difference(self.known):
            if len(self.known) + len(new) > self.limit:
                self.known.clear()
                new = set(tokens)
            for w in new:
                self.known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        h = np.fromiter(map(self.known.__getitem__, tokens), np.uint64, len(tokens))
        n = max(1, len(h) - self.words + 1) if len(h) else 0
        out = np.full(n, min(self.words, len(h)), np.uint64)
        for at in range(min(self.words, len(h))):
            out = mix(out + h[at : at + n] * _G)
        return np.unique(out, return_counts=True)


SKETCH_SCHEMA = (
    "doc_id long, t1 long, t2 long, node binary, n long, bands array<long>, shingles array<int>, weights array<int>"
)


def sketch(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, t1, t2, node, n, bands, shingles, weights`` of each text.

    ``t1`` and ``t2`` are the key of the text; ``node`` (16 bytes) is a digest of its words,
    so texts of equal words share it; a shingle that occurs once weighs 1, and 1 more each
    time its count doubles, so that one run said a thousand times does not make two texts
    alike; ``n`` is the sum of all weights; ``bands`` are the band hashes (empty without
    shingles) of the weighted shingles; ``shingles`` are the low 32 bits of the distinct
    shingle hashes, ascending, with their ``weights``, for the check.
    """
    hasher = DartMinHash(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = held(("shingler", words), lambda: Shingler(words))
        for b in slices(batches, 64):
            nodes, sets = [], []
            for text in b.column(3).to_pylist():
                tokens = sh.tokens(text)
                nodes.append(hashlib.blake2b(b" ".join(tokens), digest_size=16).digest())
                shingles, counts = sh.shingles(tokens)
                sets.append((shingles, np.frexp(counts)[1]))  # 1 + the whole part of log2
            sizes = np.array([len(s) for s, _ in sets])
            elements = np.concatenate([np.zeros(0, np.uint64), *(s for s, _ in sets)])
            weights = np.concatenate([np.zeros(0), *(c for _, c in sets)]).astype(float)
            owner = np.repeat(np.arange(len(sets)), sizes)
            keys = band_hashes(hasher.signatures(elements, weights, owner, len(sets)), bands, rows)
            listed = [k.tolist() if n else [] for k, n in zip(keys.view(np.int64), sizes)]
            low, many = zip(*(_low_bits(*s) for s in sets)) if sets else ((), ())
            total = [int(c.sum()) for _, c in sets]
            kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            made = [pa.array(c, k) for c, k in zip((nodes, total, listed, low, many), kinds)]
            names = [f.split()[0] for f in SKETCH_SCHEMA.split(", ")]
            yield pa.record_batch([*b.columns[:3], *made], names=names)

    t1, t2 = text_key(F.col("text"))
    return id_text(docs).select("doc_id", t1.alias("t1"), t2.alias("t2"), "text").mapInArrow(run, SKETCH_SCHEMA)


def _low_bits(shingles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The low 32 bits of the hashes, ascending, and the summed weights of each."""
    low, at = np.unique(shingles.astype(np.uint32), return_inverse=True)
    return low.view(np.int32), np.bincount(at, weights, len(low)).astype(np.int32)


def similarity_of(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets (elements without repeats, and their weights);
    0 if one is empty."""
    if not len(x) or not len(y):
        return 0.0
    _, at, there = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(nx[at], ny[there]).sum())
    return both / (int(nx.sum()) + int(ny.sum()) - both)


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, similarity`` of each pair of nodes (a stored table); ``sets`` has ``node,
    shingles, weights``, a row a node. Where the nodes at one end are few, such as the centres
    of groups, only their sets are shuffled for it."""

    def of(end: str) -> DataFrame:
        ends = pairs.select(F.col(end).alias("node")).distinct()
        return sets.join(F.broadcast(ends), "node", "left_semi") if ends.count() <= BROADCAST_NODES else sets

    left, right = (of(s).select(F.col("node").alias(s), F.col("shingles").alias(f"s{s}"), F.col("weights").alias(f"w{s}")) for s in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            parts = []
            for column in batch.columns[2:]:
                values, at = column.values.to_numpy(), column.offsets.to_numpy()
                parts.append([values[i:j] for i, j in zip(at, at[1:])])
            found = pa.array(list(map(similarity_of, *parts)), pa.float64())
            yield pa.record_batch([*batch.columns[:2], found], names=["a", "b", "similarity"])

    # the centre of a large group is in as many pairs as the group has members
    both = spread_join(spread_join(pairs, left, ["a"], "inner", by="b"), right, ["b"], "inner", by="a", counted=pairs)
    return both.select("a", "b", "sa", "wa", "sb", "wb").mapInArrow(run, "a binary, b binary, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node connected to each node of ``edges`` (a, b).

    Alternates large-star and small-star steps, each a map-side combined minimum and a join
    that splits the edges of a node with many, until the set of edges stays the same; each
    step is stored, and what it was made from is removed.
    """
    spark = edges.sparkSession
    pointing = lambda x, y: (F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    with scope(spark) as keep:
        now = materialize(edges.where("a <> b").select(*pointing(F.col("a"), F.col("b"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        before = None
        while state[0] and state != before:
            with scope(spark) as pass_on:
                both = materialize(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
                least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
                large = spread_join(both, least, ["u"], "inner", by="v").where(F.col("v") > F.col("u"))
                # every edge now points from a larger node to a smaller one
                large = materialize(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
                least = large.groupBy("u").agg(F.min("v").alias("m"))
                small = spread_join(large, least, ["u"], "inner", by="v")
                ends = F.array(*(F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in "uv"))
                small = small.select(F.inline(ends)).where("u <> v").distinct()
                now = pass_on(materialize(small))
            before, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        keep(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


#: Members of one bucket that meet in one task, at most, in each of the two sides of a block.
BLOCK = 512


def _in_blocks(x: DataFrame, y: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Two tables for a join on ``bucket, _i, _j`` in which every row of ``x`` meets every row
    of ``y`` of its bucket once, and no task more than about ``block`` rows of each.

    Both have ``nx`` and ``ny``, the rows of the bucket in ``x`` and ``y``: the rows of either
    fall into groups, and go to every group of the other.
    """
    groups = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / block)).cast("int")
    own = lambda n: F.pmod(F.xxhash64("node"), groups(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), groups(n) - 1))
    return x.withColumn("_i", own("nx")).withColumn("_j", every("ny")), y.withColumn("_j", own("ny")).withColumn("_i", every("nx"))


#: Entries that are counted together where frequent buckets are looked for.
STRETCH = 1_000_000


def busy_buckets(nodes: DataFrame) -> DataFrame:
    """``bucket, members`` of frequent buckets (a stored table), ``SPREAD`` for each partition at most.

    A bucket with more than a quarter of an average partition's entries has that share of some
    stretch of them too, so each stretch tells those it knows, and nothing else is shuffled.
    """
    share = SPREAD * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def told() -> pa.RecordBatch:
            bucket, n = np.unique(np.concatenate(waiting), return_counts=True)
            often = n > max(1, size / share)
            return pa.record_batch([pa.array(bucket[often]), pa.array(n[often].astype(np.int64))], names=["bucket", "n"])

        for b in slices(batches, 4096):
            waiting.append(b.column(0).flatten().to_numpy())
            size += len(waiting[-1])
            if size > STRETCH:
                yield told()
                waiting, size = [], 0
        if size:
            yield told()

    known = nodes.select("bands").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    entries = nodes.select(F.explode("bands").alias("bucket"))
    counted = entries.join(F.broadcast(most_frequent(known, "n").select("bucket")), "bucket")
    return materialize(counted.groupBy("bucket").agg(F.count("*").alias("members")))


def shared_entries(nodes: DataFrame) -> DataFrame:
    """``bucket, band, key, members`` of each entry whose bucket has several; ``nodes`` has
    ``key, bands``.

    Entries of frequent buckets are known by their sizes and stay where they are; all others
    are shuffled once and counted where they meet.
    """
    entries = nodes.select("key", F.posexplode("bands").alias("band", "bucket"))
    big = F.broadcast(busy_buckets(nodes))
    met = entries.join(big, "bucket", "left_anti").withColumn("members", F.count("*").over(Window.partitionBy("bucket")))
    return met.where("members > 1").unionByName(entries.join(big, "bucket")).select("bucket", "band", "key", "members")


def linked_nodes(table: DataFrame, similarity: float = SIMILARITY, crowd: int = CROWD, huge: int = HUGE, rare: int = RARE, block: int = BLOCK) -> DataFrame:
    """``node, label``: the components of all pairs of nodes that share a bucket and reach
    ``similarity``; nodes without such a partner may be missing.

    ``table`` is a stored table of :func:`sketch`.

    1. In every bucket each member is held against one centre: as many pairs as members,
       however large the bucket.
    2. Members outside the largest component of their bucket are held against its centre.
    3. Members that are linked already need no check between them. Those of different
       components are held against each other, save where that is known to fail.

    For buckets of more than ``crowd`` members, the shingles of each member that no other
    such member holds are weighed. The rest bounds its overlap with any of them: a member
    whose rest is below ``similarity`` of its shingles has no partner, and a pair is none
    if the smaller rest is below the overlap that its sizes ask for. The member with the
    least of such shingles, which is the nearest to the origin of a group of copies, is the
    centre. In buckets of more than ``huge`` members, the bound leaves out all shingles
    that at most ``rare`` members hold, and pairs that share one of those are found by an
    equality join on it (at most ``rare`` members a key). So members of a large group of
    copies, or sharers of a passage, are not all held against each other, and no pair that
    reaches ``similarity`` is lost. What is left of a large bucket is dealt out in blocks.
    """
    nodes = table.where(F.size("bands") > 0).groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = materialize(nodes)  # read several times, shuffled once
    # every entry is shuffled, so with half a node; two nodes of one key get each other's
    # buckets, which can only add candidates
    key = F.xxhash64("node").alias("key")
    found = shared_entries(nodes.select(key, "bands"))
    shared = materialize(found.join(nodes.select(key, "node", "n"), "key").select("bucket", "band", "node", "n", "members"))
    remove(table.sparkSession, [nodes._kiln_path])

    # only nodes that share a bucket matter from here on, each once; where they are few, the
    # others go before anything of them is shuffled
    crowds = materialize(shared.groupBy("node").agg(F.max("members").alias("_most")))
    rows = table.select("node", "shingles", "weights")
    if crowds.count() <= BROADCAST_NODES:
        rows = rows.join(F.broadcast(crowds.select("node")), "node", "left_semi")
    sets = rows.groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("weights").alias("weights"))
    sets = materialize(sets.join(crowds, "node"))
    listed = sets.where(F.col("_most") > crowd).select("node", (F.col("_most") > huge).alias("huge"), F.inline(F.arrays_zip("shingles", "weights")).alias("s", "w"))
    listed = materialize(listed)  # read twice: listed once
    counted = listed.groupBy("s").agg(F.count("*").alias("c"))
    # shingles that most members hold are not rare, so they go before the join
    common = most_frequent(counted.where(F.col("c") > rare), "c").drop("c")
    scant = listed.join(common, "s", "left_anti").join(counted.where(F.col("c") <= rare), "s")
    few = materialize(scant.select("s", "c", "w", "node", "huge"))
    scarce = few.groupBy("node").agg(F.sum(F.when(F.col("c") == 1, F.col("w")).otherwise(0)).alias("alone"), F.sum("w").alias("few"))
    # outside crowded buckets nothing is known, so nothing is ruled out
    member = shared.join(scarce, "node", "left")
    member = member.withColumns({c: F.when(F.col("members") > crowd, F.coalesce(c, F.lit(0))).otherwise(0) for c in ("alone", "few")})
    # shingles that another member may hold; in huge buckets, those that are not rare
    member = member.withColumns({"rest": F.col("n") - F.col("alone"), "main": F.col("n") - F.when(F.col("members") > huge, F.col("few")).otherwise(F.col("alone"))})
    able = member.where(F.col("rest") >= similarity * (1 - 1e-9) * F.col("n"))
    able = materialize(able.select("bucket", "band", "node", "n", "alone", "rest", "main"))

    alike = lambda x, y: F.least(x, y) >= similarity * F.greatest(x, y)
    overlap = similarity / (1 + similarity) * (1 - 1e-9)
    # of two sets of these sizes and bounds; sizes too far apart cannot reach the similarity
    possible = lambda a, b, by: alike(a("n"), b("n")) & (F.least(a(by), b(by)) >= overlap * (a("n") + b("n")))
    reach = F.col("similarity") >= similarity
    centre = F.min(F.struct("alone", "node", "n", "rest")).alias("head")

    def against(rows: DataFrame, heads: DataFrame) -> DataFrame:
        """Pairs of each bucket's head and its members of other labels, save where that is
        known to fail."""
        met = spread_join(rows, heads, ["bucket"], "inner", by="node", counted=able)
        fits = (F.col("label") != F.col("top")) & possible(F.col, lambda c: F.col(f"head.{c}"), "rest")
        return met.where(fits).select(F.col("head.node").alias("a"), F.col("node").alias("b")).distinct()

    def labelled() -> DataFrame:
        return able.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    alone = able.withColumn("label", F.col("node"))
    heads = able.groupBy("bucket").agg(centre).withColumn("top", F.col("head.node"))
    first = materialize(checked(materialize(against(alone, heads)), sets))
    labels = materialize(components(first.where(reach).select("a", "b")))

    named = labelled()
    centres = named.groupBy("label").agg(centre)
    largest = named.groupBy("bucket", "label").agg(F.count("*").alias("_c")).groupBy("bucket").agg(F.max(F.struct("_c", "label"))["label"].alias("label"))
    heads = largest.join(centres, "label").withColumnRenamed("label", "top")
    others = against(named, heads)
    pairs = materialize(others.join(first.select("a", "b"), ["a", "b"], "left_anti"))
    second = materialize(checked(pairs, sets))
    labels = materialize(joined_labels(labels, second.where(reach).select("a", "b")))

    named = labelled()
    groups = named.groupBy("bucket", "label").agg(F.count("*").alias("_c")).groupBy("bucket")
    groups = groups.agg(F.max(F.struct("_c", "label")).alias("_top"), F.sum("_c").alias("ny"), F.count("*").alias("_kinds")).where("_kinds > 1")
    groups = groups.select("bucket", F.col("_top.label").alias("top"), (F.col("ny") - F.col("_top._c")).alias("nx"), "ny")
    open_ = spread_join(named, groups, ["bucket"], "inner", by="node", counted=able)
    of_node = shared.groupBy("node").agg(F.collect_list(F.struct("band", "bucket")).alias("_in"))  # one for each band at most
    earlier = F.transform(F.filter("_in", lambda e: e["band"] < F.col("band")), lambda e: e["bucket"])
    open_ = open_.join(of_node, "node").withColumn("before", earlier)
    open_ = materialize(open_.select("bucket", "node", "n", "rest", "main", "label", "top", "nx", "ny", "before"))

    def apart(x: DataFrame, y: DataFrame, keys: list[str], by: str, once) -> DataFrame:
        """Pairs of members under one key, of different components, that ``by`` does not rule out."""
        fits = possible(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"), by) & (F.col("x.label") != F.col("y.label"))
        same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys]
        found = x.alias("x").join(y.alias("y"), [*same, fits & once])
        return found.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))

    # the largest component of a bucket need not meet itself; others meet it, and each other
    # in one order; a pair counts in the first bucket that both are in
    order = (F.col("y.label") == F.col("y.top")) | (F.col("x.node") < F.col("y.node"))
    new = ~F.arrays_overlap("x.before", "y.before")
    sides = _in_blocks(open_.where("label <> top"), open_, block)
    pairs = apart(*sides, ["bucket", "_i", "_j"], "main", order & new)
    # a pair in a huge bucket either reaches the overlap without rare shingles or shares one
    facts = open_.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "label")), F.min("rest").alias("rest"))
    scarce = few.where(F.col("huge") & (F.col("c") > 1)).select("s", "node").join(facts, "node")
    by_rare = apart(scarce, scarce, ["s"], "rest", F.col("x.node") < F.col("y.node"))
    pairs = pairs.unionByName(by_rare).distinct()
    seen = first.unionByName(second).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = checked(materialize(pairs.join(seen, ["a", "b"], "left_anti")), sets)
    return joined_labels(labels, more.where(reach).select("a", "b"))


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``labels`` (a stored table of :func:`components`) with further ``links``
    (a, b): only the components that those join are searched again."""
    for end in "ab":
        ends = labels.select(F.col("node").alias(end), F.col("label").alias("_label"))
        links = links.join(ends, end, "left").withColumn(end, F.coalesce("_label", end)).drop("_label")
    joined = materialize(components(links.select("a", "b")).select(F.col("node").alias("label"), F.col("label").alias("_label")))
    whole = spread_join(labels, joined, ["label"], "left", by="node").select("node", F.coalesce("_label", "label").alias("label"))
    # nodes that had no link so far
    single = joined.join(labels, joined["label"] == labels["node"], "left_anti")
    return whole.unionByName(single.select(F.col("label").alias("node"), F.col("_label").alias("label")))


def classes_by_row(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, t1, t2, class_id, n_shingles, first``: a row for each row of ``docs``.

    ``t1`` and ``t2`` are the key of the text; ``first`` marks the rows that stand for their
    class: those of its smallest (doc_id, t1, t2).
    """
    with scope(docs.sparkSession) as keep:
        table = materialize(sketch(docs, words, bands, rows))
        given = materialize(table.select("doc_id", "t1", "t2", "node", "n"))
        least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "t1", "t2"))).alias("least")
        labels = materialize(linked_nodes(table, similarity))
        remove(docs.sparkSession, [table._kiln_path])
        nodes = given.groupBy("node").agg(least).join(labels, "node", "left")
        nodes = materialize(nodes.select("node", F.coalesce("label", "node").alias("label"), "least"))
        classes = nodes.groupBy("label").agg(F.min("least").alias("least"))
        nodes = materialize(spread_join(nodes.drop("least"), classes, ["label"], "inner", by="node").select("node", "least"))
        found = keep(materialize(spread_join(given, nodes, ["node"], "inner", by="doc_id")))
    own = F.col("least") == F.struct("doc_id", "t1", "t2")
    return found.select(
        "doc_id", "t1", "t2", F.col("least.doc_id").alias("class_id"), F.col("n").alias("n_shingles"), F.coalesce(own, F.lit(False)).alias("first")
    )


def near_duplicate_classes(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, class_id, n_shingles``: a row for each row of ``docs``.

    Documents belong to one class if a chain of documents joins them in which neighbours
    have the same words or a weighted Jaccard similarity of their five-word shingles, each
    weighted by how often the text holds it, of at least 0.8. ``class_id`` is the smallest
    doc_id of the class (null if all its ids are null). Null texts are empty; texts without
    words are copies of each other. Repeated rows fall into one class. Other columns of
    ``docs`` play no part. ``how``: see :func:`classes_by_row`.

    Candidates come from banded signatures: with 32 bands of 5 coordinates a pair at
    exactly 0.8 is missed with probability 3e-6, a closer one less often.
    """
    return classes_by_row(docs, **how).select("doc_id", "class_id", "n_shingles")


def one_of_each_class(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with all its columns, one row of each near-duplicate class: its smallest doc_id.

    Of rows with equal id and text one stays; of different texts under one id, each that
    stands for a class stays. Rows with a null doc_id all stay, since nothing names them.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    classes = classes_by_row(named, **how).where("first")
    own = ["_kiln_id", "_kiln_t1", "_kiln_t2"]
    first = classes.select(*(F.col(c).alias(k) for c, k in zip(("doc_id", "t1", "t2"), own))).distinct()
    t1, t2 = text_key(F.col("text"))
    keyed = named.withColumns(dict(zip(own, (F.col("doc_id").cast("long"), t1, t2))))
    kept = keyed.join(first, own, "left_semi").dropDuplicates(own).drop(*own)
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))
