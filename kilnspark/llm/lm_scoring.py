"""Language-model scores from an Elias-Fano n-gram trie.

The model is counted by Spark from the training fold, smoothed by interpolated absolute
discounting, and written as shards of a trie into the shared folder:

* level 1: all words, as sorted 64-bit hashes, with their counts; the place of a word in
  this order, from 1 on, is its id;
* levels 2 and 3: all pairs and triples, in shards by a number that mixes the ids of a pair
  reversibly. In a shard stand the first words, with monotone pointers to their second
  words; these, with monotone pointers to the words that follow the pair; and those.

Words of level 1, first words and pointers are Elias-Fano coded; second and third words are
packed. A pair is found by successor search for its first word and then among that word's
children only, a triple among the children of its pair. Beside each entry stand 16-bit codes
of counts (exact below 32,768), of which smoothed probabilities are made. All is searched in
memory-mapped files, so a task touches only the pages its texts ask for. Nothing is left
out: every training token counts at every level, whatever the size of the corpus.

The shards lie in ``spark.checkpoint.dir``, on any file system that Arrow knows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, id_text, materialize, owned, shared_dir, slices
from .elias_fano import EliasFano, encode, load_arrays, pack_bits, save_arrays, search_packed

#: Words of a smaller share of all training tokens stay at level 1; 0: none do.
SHARE = 0.0
#: Words in a shard, about.
SHARD = 500_000
#: Training tokens for a shard of pairs and triples, about.
GRAM_SHARD = 2_000_000
#: Tokens that a task counts before it hands blocks on.
BLOCK = 2_000_000
#: Distinct words that a task counts before it hands them on, about.
KEPT = 400_000
#: Texts whose tokens are numbered at once: the more, the more of their words are the same.
TEXTS = 2048
#: Cannot occur in a word, so it can stand for the end of a text.
END = b"\n"
BOS = 0

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 2**64)


def coded(n: np.ndarray) -> np.ndarray:
    """Counts in 16 bits: exact below 2 ** 15, then 1024 steps for each power of two."""
    wide = np.log2(np.maximum(n, 1) / 2**15) * 1024 + 2**15
    return np.where(n < 2**15, n, np.minimum(np.rint(wide), 65535)).astype(np.uint16)


_CODES = np.arange(2**16, dtype=float)
_DECODED = np.where(_CODES < 2**15, _CODES, 2 ** ((_CODES - 2**15) / 1024 + 15))


def decoded(codes: np.ndarray) -> np.ndarray:
    return _DECODED[codes]


def joined(v: np.ndarray, w: np.ndarray, bits: int) -> np.ndarray:
    """The pairs as numbers in their order, ``w`` in the lowest ``bits``; :func:`parted` turns them back."""
    return v.astype(np.uint64) << np.uint64(bits) | w.astype(np.uint64)


def parted(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (x >> np.uint64(bits)).astype(np.int64), (x & np.uint64(2**bits - 1)).astype(np.int64)


def pair_keys(v: np.ndarray, w: np.ndarray, bits: int) -> np.ndarray:
    """The pairs as numbers of ``2 * bits`` bits, spread evenly; :func:`unpaired` turns them back."""
    x = joined(v, w, bits)
    return (x ^ x >> np.uint64(bits)) * np.uint64(_ODD) & np.uint64(4**bits - 1)


def unpaired(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = keys * np.uint64(_INVERSE) & np.uint64(4**bits - 1)
    x ^= x >> np.uint64(bits)
    return parted(x, bits)


def by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that occurs, and where."""
    order = np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 2**16 else shard, kind="stable")
    at = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for a, b in zip(at, [*at[1:], len(order)]):
        yield int(shard[order[a]]), order[a:b]


def top_bits(x: np.ndarray, bits: int, width: int) -> np.ndarray:
    """The highest ``bits`` of numbers of ``width`` bits."""
    return (x >> np.uint64(width - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)


#: Of the bytes of a word.
word_hash = xxhash.xxh3_64_intdigest


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(word_hash, words), np.uint64, len(words))


def numbered_tokens(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct tokens of some texts, the place among them of each token, and where each text starts.

    Tokens are words between blanks, A-Z lower-cased, and an end token for each text. On
    UTF-8, Arrow's ASCII functions know exactly A-Z and the six ASCII blanks.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    real = pc.not_equal(pc.binary_length(words), 0)  # blanks at either end leave an empty word
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    each = np.diff(upto[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])])
    coded_words = words.filter(real).dictionary_encode()
    distinct = coded_words.dictionary
    ends = np.cumsum(each + 1)
    at = np.full(len(coded_words) + len(each), len(distinct), np.int64)
    inner = np.ones(len(at), bool)
    inner[ends - 1] = False
    at[inner] = coded_words.indices.to_numpy()
    offsets = np.append(0, np.cumsum(pc.binary_length(distinct).to_numpy())).tolist()
    data = distinct.buffers()[2].to_pybytes() if len(distinct) else b""
    return [*(data[a:b] for a, b in zip(offsets, offsets[1:])), END], at, ends - each - 1


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def count_words(texts: DataFrame) -> DataFrame:
    """``h, n``: count of each word (by hash) and the end token in column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            h, n = map(np.concatenate, zip(*kept))
            order = np.argsort(h)
            h = h[order]
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            return h[at], np.add.reduceat(n[order], at)

        def flush():
            h, n = kept.pop()
            return pa.record_batch([pa.array(_signed(h)), pa.array(n)], names=["h", "n"])

        for b in slices(batches, TEXTS):
            if not b.num_rows:
                continue
            words, at, _ = numbered_tokens(b.column(0))
            kept.append((hashes(words), np.bincount(at, minlength=len(words))))
            if sum(len(h) for h, _ in kept) > 2 * KEPT:
                kept[:] = [merged()]
                if len(kept[0][0]) > KEPT:
                    yield flush()
        if kept:
            kept[:] = [merged()]
            yield flush()

    return texts.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class _Numbered(dict):
    """Numbers for keys in the order in which they are first asked for; ``new`` lists those."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        self.new.append(key)
        self[key] = n = len(self)
        return n


class Words:
    """Small integers for tokens, through a bounded cache of what ``look`` finds by hash.

    What is given is gone through once. The cache is emptied before as many words as came last
    would pass the limit.
    """

    def __init__(self, look, limit: int = 500_000):
        self.look, self.limit = look, limit
        self.index, self.last = _Numbered(), 0
        self.columns: list[np.ndarray] | None = None

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) + self.last > self.limit:
            self.index, self.columns = _Numbered(), None
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if new := self.index.new:
            found = self.look(hashes(new))
            self.columns = list(found) if self.columns is None else [np.concatenate(x) for x in zip(self.columns, found)]
        self.last = len(new)
        self.index.new = []
        return at


def contexts(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words two and one before each token; BOS before a text, -1 for none."""
    v, u = np.full(len(ids), -1, np.int64), np.full(len(ids), -1, np.int64)
    v[1:] = ids[:-1]
    v[starts] = BOS
    u[1:] = v[:-1]
    u[starts] = -1
    return u, v


def pack_block(key: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending keys as differences, words and counts, byte plane by byte plane, compressed."""
    columns = (np.diff(key, prepend=np.uint64(0)), w.astype(np.uint32), n.astype(np.uint32))
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpack_block(block: bytes, size: int) -> tuple[np.ndarray, ...]:
    planes = np.frombuffer(pa.decompress(block, 16 * size, codec="zstd", asbytes=True), np.uint8).reshape(16, size)
    column = lambda a, b, kind: np.ascontiguousarray(planes[a:b].T).reshape(-1).view(kind)
    return np.cumsum(column(0, 8, np.uint64), dtype=np.uint64), column(8, 12, np.uint32), column(12, 16, np.uint32)


def summed(key: np.ndarray, w: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Sorted distinct (key, w) and the sum of ``n`` (each one: 1) of each.

    Numbers sort several times faster than columns do, so the place of each key among the
    distinct ones and ``w``, both of 32 bits at most, are put together.
    """
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    key, both = key[new], (np.cumsum(new) - 1).astype(np.uint64) << np.uint64(32) | w[order]
    if n is None:
        both.sort()
    else:
        again = np.argsort(both)
        both, n = both[again], n[order][again].astype(np.int64)
    at = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    total = np.diff(np.append(at, len(both))) if n is None else np.add.reduceat(n, at)
    return key[both[at] >> np.uint64(32)], (both[at] & np.uint64(2**32 - 1)).astype(np.uint32), total


def count_ngrams(texts: DataFrame, meta: dict) -> DataFrame:
    """``shard, size, block``: blocks of counted (pair, next word), to be summed by shard.

    Each pair of words is counted with the word that follows it, or ``none`` for no such
    word, so one record for each token holds the counts of both levels.
    """
    held = texts.sparkSession.sparkContext.broadcast(meta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(held.value)
        words = Words(model.words)
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            key, w, n = summed(*map(np.concatenate, zip(*kept)))
            kept.clear()
            shard = top_bits(key, model.gram_bits, 2 * model.bits)
            at = np.flatnonzero(np.diff(shard, prepend=-1))
            ends = np.append(at[1:], len(key))
            blocks = [pack_block(key[a:b], w[a:b], n[a:b]) for a, b in zip(at, ends)]
            return pa.record_batch([pa.array(shard[at]), pa.array(ends - at), pa.array(blocks, pa.binary())], names=["shard", "size", "block"])

        for b in slices(batches, TEXTS):
            if not b.num_rows:
                continue
            distinct, at, starts = numbered_tokens(b.column(0))
            at = words(distinct)[at]
            ids = words.columns[1][at]
            _, v = contexts(ids, starts)
            following = np.append(ids[1:], -1)
            following[starts[1:] - 1] = -1
            pair = (ids >= 0) & (v >= 0)
            following = np.where(following >= 0, following, model.none)[pair].astype(np.uint32)
            kept.append((pair_keys(v[pair], ids[pair], model.bits), following))
            if sum(len(k) for k, _ in kept) > BLOCK:
                yield flush()
        if sum(len(k) for k, _ in kept):
            yield flush()

    return texts.select("text").mapInArrow(run, "shard long, size long, block binary")


def discount(counts_of_counts: dict[int, int]) -> float:
    """n1 / (n1 + 2 n2), the usual estimate; one half where it is not defined."""
    n1, n2 = counts_of_counts.get(1, 0), counts_of_counts.get(2, 0)
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5


def _once_and_twice(counts: DataFrame) -> dict[int, int]:
    return {r["n"]: r["c"] for r in counts.where("n <= 2").groupBy("n").agg(F.count("*").alias("c")).collect()}


class Model:
    """A written trie. Small fixed parts travel in ``meta``; the levels are mapped files."""

    def __init__(self, meta: dict):
        self.__dict__.update(meta)
        self._open: dict[str, dict] = {}

    def shard(self, name: str, at: int) -> dict | None:
        key = f"{name}-{at}"
        if key not in self._open:
            arrays = load_arrays(f"{self.folder}/{key}")
            if arrays is not None:
                for level in {k.split(".")[0] for k in arrays if k.endswith(".shape")}:
                    arrays[level] = EliasFano({k.split(".")[1]: v for k, v in arrays.items() if k.startswith(f"{level}.")})
            self._open[key] = arrays
        return self._open[key]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training counts and ids by word hash (level 1); 0 and -1 for others."""
        counts, ids = np.zeros(len(hashes), np.int64), np.full(len(hashes), -1, np.int64)
        rest = hashes & np.uint64(2 ** (64 - self.word_bits) - 1)
        for s, own in by_shard(top_bits(hashes, self.word_bits, 64)):
            if (part := self.shard("words", s)) is not None:
                at, hit = part["words"].successor(rest[own])
                own, at = own[hit], at[hit]
                counts[own] = part["counts"][at]
                ids[own] = self.offsets[s] + at + 1
        return counts, ids

    def words(self, hashes: np.ndarray):
        """Columns for :class:`Words`: count, id for the higher levels, base log10, probability."""
        c, ids = self.find(hashes)
        base = np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))
        if self.total:
            p = np.where(c > 0, c - self.d1, self.d1 * self.distinct) / self.total
        else:
            p = np.ones(len(c))
        return c, np.where(c >= self.least, ids, -1), base, p

    def probabilities(self, ids: np.ndarray, p1: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of every token, given the words before it: p3 over p2 over p1, interpolated."""
        _, v = contexts(ids, starts)
        p = p1.copy()
        if not self.total:
            return p
        # pairs in order, each once; words that the model lacks are one more word
        given = np.flatnonzero(v >= 0)
        w = np.where(ids[given] >= 0, ids[given], self.none)
        found, where = np.unique(joined(v[given], w, self.bits), return_inverse=True)
        v, w = parted(found, self.bits)
        new = np.append(True, v[1:] != v[:-1])[: len(v)]
        of = np.cumsum(new) - 1
        often, left = (x[of] for x in self._context(v[new]))
        shard, rank, n, wide_left = np.zeros(len(v), np.int64), np.full(len(v), -1), np.zeros(len(v)), np.ones(len(v))
        full = w != self.none
        shard[full], rank[full], n[full], wide_left[full] = self._level2(v[full], w[full])
        p[given] = p[given] * left[where] + (np.where(n > 0, n - self.d2, 0) / often)[where]
        # the pair that ends at the token before is the context of the next one of its text
        pair = np.full(len(ids), -1)
        pair[given] = np.where(rank >= 0, np.arange(len(rank)), -1)[where]
        inner = np.ones(len(ids), bool)
        inner[starts] = False
        wide = np.flatnonzero(inner)
        wide = wide[pair[wide - 1] >= 0]
        before = pair[wide - 1]
        p[wide] *= wide_left[before]
        full = ids[wide] >= 0
        wide, before = wide[full], before[full]
        found, where = np.unique(joined(before, ids[wide], self.bits), return_inverse=True)
        before, third = parted(found, self.bits)
        n3 = self._level3(shard[before], rank[before], third)
        p[wide] += (np.where(n3 > 0, n3 - self.d3, 0) / n[before])[where]
        return p

    def _context(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each word is a context, and what share it leaves to level 1."""
        often, kinds, used = (np.full(len(ids), x, float) for x in (self.texts, 0, 0))
        words = np.flatnonzero(ids != BOS)
        shard = np.searchsorted(self.offsets, ids[words] - 1, side="right") - 1
        for s, own in by_shard(shard):
            own = words[own]
            often[own] = self.shard("words", s)["counts"][ids[own] - 1 - self.offsets[s]]
        for s, own in by_shard(ids // SHARD):
            if (part := self.shard("contexts", s)) is not None:
                kinds[own], used[own] = (part[c][ids[own] % SHARD] for c in ("kinds", "used"))
        return often, (often - used + self.d2 * kinds) / often

    def _level2(self, v: np.ndarray, w: np.ndarray):
        """Shard, rank (-1: unseen) and count of pairs, and what share each leaves to level 2.

        Pairs must come in order, by first word.
        """
        shard = top_bits(pair_keys(v, w, self.bits), self.gram_bits, 2 * self.bits)
        rank, n, left = np.full(len(v), -1, np.int64), np.zeros(len(v)), np.ones(len(v))
        for s, own in by_shard(shard):
            if (part := self.shard("ngrams", s)) is None:
                continue
            # pairs come by their first word, so each of those is looked for once
            new = np.diff(v[own], prepend=-1) != 0
            at, hit = part["first"].successor(v[own][new])
            start, end = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            start[hit], end[hit] = (part["children"].access(at[hit] + x) for x in (0, 1))
            of = np.cumsum(new) - 1
            at = search_packed(part["second"], self.bits, start[of], end[of], w[own].astype(np.uint64))
            own, at = own[at >= 0], at[at >= 0]
            rank[own] = at
            n[own] = decoded(part["n2"][at])
            left[own] = self.d3 * decoded(part["kinds"][at])
            if "unused" in part:
                left[own] += decoded(part["unused"][at])
            left[own] /= n[own]
        return shard, rank, n, left

    def _level3(self, shard: np.ndarray, rank: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Counts of the triples of a known pair (by shard and rank) and a word.

        Triples of a pair must stand side by side.
        """
        out = np.zeros(len(ids))
        for s, own in by_shard(shard):
            part = self.shard("ngrams", s)
            if part is not None and "third" in part:
                new = np.diff(rank[own], prepend=-1) != 0
                pairs, of = rank[own][new], np.cumsum(new) - 1
                start, kinds = part["grandchildren"].access(pairs), part["kinds"][pairs]
                end = start + kinds
                if (many := np.flatnonzero(kinds >= 2**15)).size:  # their number is not exact
                    end[many] = part["grandchildren"].access(pairs[many] + 1)
                at = search_packed(part["third"], self.bits, start[of], end[of], ids[own].astype(np.uint64))
                out[own[at >= 0]] = decoded(part["n3"][at[at >= 0]])
        return out


def fit(texts: DataFrame, share: float = SHARE, shard: int = SHARD) -> Model:
    """Count, smooth and write the model of all rows of ``texts`` (column ``text``)."""
    spark = texts.sparkSession
    folder = owned(f"{shared_dir(spark)}/trie-{uuid.uuid4().hex}")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    counts = materialize(count_words(texts))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    d1 = discount(_once_and_twice(counts))
    word_bits = max(0, math.ceil(math.log2(max(1, distinct / shard))))
    bits = (distinct + 1).bit_length()
    if bits > 32:
        raise ValueError("more than 2 ** 32 - 2 distinct words")
    meta = {
        "folder": folder, "total": total, "distinct": distinct, "d1": d1, "word_bits": word_bits,
        "least": max(1, math.ceil(share * total)), "bits": bits, "none": distinct + 1, "texts": 0, "d2": 0.5, "d3": 0.5,
        "offsets": np.zeros(2**word_bits, np.int64),
        "gram_bits": min(2 * bits, max(0, math.ceil(math.log2(max(1, total / GRAM_SHARD))))),
    }

    def write_words(key, table):
        h = table.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        rest = h[order] & np.uint64(2 ** (64 - word_bits) - 1)
        arrays = {f"words.{k}": v for k, v in encode(rest, 2 ** (64 - word_bits)).items()}
        n = table.column("n").to_numpy()[order]
        arrays["counts"] = n.astype(np.uint32 if n.max() < 2**32 else np.uint64)
        save_arrays(f"{folder}/words-{key[0].as_py()}", arrays)
        return pa.table({"shard": [key[0].as_py()], "n": [len(h)]}, schema=pa.schema([("shard", pa.int64()), ("n", pa.int64())]))

    top = F.shiftrightunsigned("h", 64 - word_bits).cast("long") if word_bits else F.lit(0).cast("long")
    sizes = np.zeros(2**word_bits, np.int64)
    for r in counts.withColumn("shard", top).groupBy("shard").applyInArrow(write_words, "shard long, n long").collect():
        sizes[r["shard"]] = r["n"]
    if not total:
        return Model(meta)
    meta["offsets"] = np.cumsum(sizes) - sizes
    (texts_n,), (end,) = Model(meta).find(np.array([word_hash(END)], np.uint64))
    meta["texts"] = int(texts_n)

    def write_ngrams(key, table):
        parts = [unpack_block(b, n) for b, n in zip(table.column("block").to_pylist(), table.column("size").to_pylist())]
        keys, w, n = summed(*map(np.concatenate, zip(*parts)))
        first = np.flatnonzero(np.diff(keys, prepend=keys[0] + np.uint64(1)))
        rank = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        pair_n = np.add.reduceat(n, first)
        u, v = unpaired(keys[first], bits)
        order = np.argsort(joined(u, v, bits))  # by first word, then by second
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        u, v, pair_n = u[order], v[order], pair_n[order]
        three = np.flatnonzero(w != meta["none"])
        # by pair; their words ascend already
        three = three[np.sort(place[rank[three]] << 32 | np.arange(len(three))) & 2**32 - 1]
        triple_n, context = n[three], place[rank[three]]
        kinds = np.bincount(context, minlength=len(u))
        # nothing follows the end of a text, and nothing asks for what does
        unused = np.where(v == end, 0, pair_n - np.bincount(context, triple_n, len(u)).astype(np.int64))
        starts = np.flatnonzero(np.diff(u, prepend=-1))
        roots = u[starts]
        levels = {
            "first": (roots, 2**bits),
            "children": (np.append(starts, len(u)), len(u) + 1),
            "grandchildren": (np.append(0, np.cumsum(kinds)), len(three) + 1),
        }
        arrays = {f"{name}.{k}": a for name, (x, top) in levels.items() for k, a in encode(x.astype(np.uint64), top).items()}
        arrays |= {"second": pack_bits(v.astype(np.uint64), bits), "n2": coded(pair_n), "kinds": coded(kinds)}
        if unused.any():
            arrays["unused"] = coded(unused)
        if len(three):
            arrays |= {"third": pack_bits(w[three].astype(np.uint64), bits), "n3": coded(triple_n)}
        save_arrays(f"{folder}/ngrams-{key[0].as_py()}", arrays)
        sizes = np.diff(np.append(starts, len(u)))
        once = [(level, k, int((c == k).sum())) for level, c in ((2, pair_n), (3, triple_n)) for k in (1, 2)]
        columns = [
            np.concatenate([np.ones(len(roots), np.int64), [x[0] for x in once]]),
            np.concatenate([roots, [x[1] for x in once]]),
            np.concatenate([sizes, np.zeros(len(once), np.int64)]),
            np.concatenate([np.add.reduceat(pair_n, starts), [x[2] for x in once]]),
        ]
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=["level", "word", "kinds", "n"])

    grams = count_ngrams(texts, meta).groupBy("shard")
    told = materialize(grams.applyInArrow(write_ngrams, "level long, word long, kinds long, n long"))
    often = {2: {}, 3: {}}
    for r in told.where("level > 1").groupBy("level", "word").agg(F.sum("n").alias("n")).collect():
        often[r["level"]][r["word"]] = r["n"]
    meta["d2"], meta["d3"] = discount(often[2]), discount(often[3])

    def write_contexts(key, table):
        at, arrays = table.column("word").to_numpy() % SHARD, {}
        for name in ("kinds", "n"):
            x = table.column(name).to_numpy()
            arrays[name] = np.zeros(SHARD, np.uint32 if x.max() < 2**32 else np.uint64)
            arrays[name][at] = x
        save_arrays(f"{folder}/contexts-{key[0].as_py()}", {"kinds": arrays["kinds"], "used": arrays["n"]})
        return pa.table({"shard": [key[0].as_py()], "n": [len(at)]}, schema=pa.schema([("shard", pa.int64()), ("n", pa.int64())]))

    by_word = told.where("level = 1").groupBy("word").agg(F.sum("kinds").alias("kinds"), F.sum("n").alias("n"))
    by_word.withColumn("shard", F.expr(f"word div {SHARD}")).groupBy("shard").applyInArrow(write_contexts, "shard long, n long").collect()
    return Model(meta)


_MODELS: dict[str, tuple[Model, Words]] = {}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of each text."""
    held = docs.sparkSession.sparkContext.broadcast({k: v for k, v in vars(model).items() if not k.startswith("_")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meta = held.value
        if meta["folder"] not in _MODELS:
            _MODELS.clear()
            opened = Model(meta)
            _MODELS[meta["folder"]] = opened, Words(opened.words)
        trie, words = _MODELS[meta["folder"]]
        for b in slices(batches, TEXTS):
            if not b.num_rows:
                continue
            distinct, at, starts = numbered_tokens(b.column(1))
            at = words(distinct)[at]
            count, ids, base, p1 = (c[at] for c in words.columns)
            logs = np.log10(trie.probabilities(ids, p1, starts))
            ends = np.append(starts[1:], len(at))
            out = [ends - starts, np.add.reduceat((count > 0).astype(np.int64), starts), np.full(len(starts), trie.total, np.int64), np.add.reduceat(base, starts), np.add.reduceat(logs, starts)]
            yield pa.record_batch(
                [b.column(0), *map(pa.array, out)],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return id_text(docs).mapInArrow(
        run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def score_documents(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """Fit on the rows whose crc32(doc_id) mod 5 is not 1, score every row.

    ``base_score`` is the add-half unigram score; ``score`` the log10 probability of the
    text (words, then the end) under the trie, where all unseen words are one class. Null
    texts are empty: just the end token. Rows with a null id are scored, not learned from,
    and not held out. Repeated rows count as often as they occur. Without training rows
    both scores are 0. Other columns of ``docs`` play no part.
    """
    fold = crc_mod(docs["doc_id"].cast("long"), 5)
    model = fit(id_text(docs.where(docs["doc_id"].isNotNull() & (fold != 1))), share)
    return score(docs, model).select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), 5) == 1, F.lit(False)).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )
