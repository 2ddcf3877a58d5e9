"""Prefix trie of conversations that are rebuilt from families, merged family first.

1. Turns become digests of 128 bits, so no text is shuffled. They are sorted over all
   partitions by conversation and turn, numbered, and each gets the digest of the sequence up
   to it: a polynomial over a prime field, which parts of a long conversation that lie in
   several partitions compute on their own and join through one row for each partition.
2. Conversations are cogrouped by base id. A group rebuilds its family and merges equal
   nodes of its members: the family's small trie. Long conversations are dealt out in blocks
   of turns, since the digest of a rebuilt sequence follows from that of the original one.
3. Only the families' nodes are shuffled and merged by digest.

A node belongs to its smallest member, so a conversation's own nodes are one piece of its
path, from where it leaves all smaller ones to its end. What a node's subtree adds up to is
the rest of its own piece and all of the pieces of its other members: no level-by-level loop.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, slices, spread_join

#: A Mersenne prime above all digests, and the base of the polynomial: any number will do.
PRIME, BASE = (1 << 127) - 1, 0x5DEECE66D_0B4B9F7A_3C2E1D97
#: A family has this many ids, and at most so many turns of its first one are shared.
FAMILY, SHARED = 5, 9
#: Turns of a conversation in one group.
BLOCK = 1 << 16
#: Characters of a text that take part in the order of turns with one number and role.
TIE = 32
#: Characters of a list of ids that go on as one piece.
PIECE = 1 << 16

ROOT = bytes(16)

TURNS = "conv_id long, part int, carried boolean, edge boolean, pos long, code binary, before binary, bytes long"
NODES = "node binary, depth long, parent binary, bytes long, members array<long>, ends array<long>"


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "big") % PRIME


def _bytes(code: int) -> bytes:
    return code.to_bytes(16, "big")


def turn_digests(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, start, digest, bytes`` of each turn; null role and text are empty.

    Rows with a null id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat_ws(":", F.octet_length(role).cast("string"), role, text)
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.substring(text, 1, TIE).alias("start"),
        F.substring(F.unhex(F.sha2(said, 256)), 1, 16).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )


def _numbered_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions and sequence digests within this partition; ``carried`` rows are of its first
    conversation, which may have begun in an earlier one; ``edge`` marks what later ones need:
    the last row of the first and of the last conversation."""
    part = TaskContext.get().partitionId()
    conv = first = held = None
    pos = code = 0
    for b in slices(batches, 4096):
        out: list[tuple] = []
        for c, digest, size in zip(*(b.column(i).to_pylist() for i in range(3))):
            if c != conv:
                if held is not None:  # the end of a conversation
                    out.append((*held[:3], held[2], *held[4:]))
                first = c if conv is None else first
                conv, pos, code = c, 0, 0
            elif held is not None:
                out.append(held)
            before, pos, code = code, pos + 1, (code * BASE + _number(digest)) % PRIME
            held = (c, part, c == first, False, pos, _bytes(code), _bytes(before), size)
        yield _turns(out)
    if held is not None:
        yield _turns([(*held[:3], True, *held[4:])])


def _turns(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    names = ["conv_id", "part", "carried", "edge", "pos", "code", "before", "bytes"]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, code, before, bytes``: each turn's place (from 1), the digest of the
    turns up to it and of those before it.

    Turns are ordered by number (null first); equal numbers by role, then by the text's
    beginning, then by digest, so that repeated rows follow one another.
    """
    digests = materialize(turn_digests(conversations))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "start", "digest"]
    dealt = digests.repartitionByRange(*order).sortWithinPartitions(*order)
    local = materialize(dealt.select("conv_id", "digest", "bytes").mapInArrow(_numbered_parts, TURNS))
    # two rows for each partition at most: what its first and its last conversation have come to
    edges = local.where("edge").select("part", "conv_id", "carried", "pos", "code").collect()
    offsets, so_far = [], (None, 0, 0)
    for part, conv, carried, pos, code in sorted(edges, key=lambda r: (r[0], not r[2])):
        known, n, state = so_far
        if carried and conv == known:
            offsets.append((part, n, _bytes(state)))
            so_far = (conv, n + pos, (state * pow(BASE, pos, PRIME) + _number(code)) % PRIME)
        else:
            so_far = (conv, pos, _number(code))
    if not offsets:
        return local.select("conv_id", "pos", "code", "before", "bytes")
    spark = conversations.sparkSession
    offsets = spark.createDataFrame(offsets, "part int, n long, state binary")  # one row for each partition at most
    moved = local.where("carried").join(F.broadcast(offsets), "part")

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            out = []
            for conv, pos, code, before, size, n, state in zip(*(b.column(i).to_pylist() for i in range(7))):
                state, power = _number(state), pow(BASE, pos - 1, PRIME)
                before = (state * power + _number(before)) % PRIME
                code = (state * power * BASE + _number(code)) % PRIME
                out.append((conv, pos + n, _bytes(code), _bytes(before), size))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["conv_id", "pos", "code", "before", "bytes"])

    columns = ["conv_id", "pos", "code", "before", "bytes"]
    shifted = moved.select(*columns, "n", "state").mapInArrow(shift, "conv_id long, pos long, code binary, before binary, bytes long")
    # those of a part without an offset stay as they are
    kept = local.join(F.broadcast(offsets.select("part", F.lit(True).alias("carried"))), ["part", "carried"], "left_anti")
    return materialize(kept.select(*columns).unionByName(shifted))


def _family(key: tuple, known: pa.Table, turns: pa.Table) -> pa.Table:
    """The merged nodes of one family, or of one block of its turns.

    ``known``: the family's conversations (``conv_id, head, length, code``: how many turns the
    base gives at most, how many there are, the digest of those that are replaced), and the
    base's first turns (null ``conv_id``). ``turns``: what follows those that are replaced.
    """
    block = key[1].as_py()
    heads = sorted((r for r in known.to_pylist() if r["conv_id"] is None), key=lambda r: r["pos"])
    nodes: dict[tuple[int, bytes], list] = {}

    def put(depth: int, node: bytes, parent: bytes | None, size: int, conv: int, ends: bool) -> None:
        held = nodes.setdefault((depth, node), [parent, size, [], []])
        held[2].append(conv)
        if ends:
            held[3].append(conv)

    rebuilt = {}
    for r in known.to_pylist():
        if (conv := r["conv_id"]) is None:
            continue
        given = min(r["head"], len(heads))
        start = heads[given - 1]["code"] if given else ROOT
        rebuilt[conv] = (given, _number(start), r["head"], r["length"], _number(r["code"]) if r["code"] else 0)
        if block == 0:
            length = given + max(0, r["length"] - r["head"])
            put(0, ROOT, None, 0, conv, length == 0)
            for h in heads[:given]:
                put(h["pos"], h["code"], h["before"], h["bytes"], conv, length == h["pos"])
    for conv, pos, code, before, size in zip(*(turns.column(c).to_pylist() for c in ("conv_id", "pos", "code", "before", "bytes"))):
        given, start, head, length, replaced = rebuilt[conv]
        change, power = start - replaced, pow(BASE, pos - head - 1, PRIME)
        parent = _bytes((_number(before) + change * power) % PRIME)
        node = _bytes((_number(code) + change * power * BASE) % PRIME)
        put(given + pos - head, node, parent, size, conv, pos == length)
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    rows = [(node, depth, *held) for (depth, node), held in nodes.items()]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    names = ["node", "depth", "parent", "bytes", "members", "ends"]
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def family_nodes(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """``node, depth, parent, bytes, members, ends`` of each family: members are at most five,
    ``ends`` those whose rebuilt turns end there. Stored."""
    turns = numbered_turns(conversations)
    head = (F.crc32(F.col("conv_id").cast("string")) % SHARED).alias("head")
    base = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")
    turns = turns.select("*", head, base)
    convs = turns.groupBy("base", "conv_id", "head").agg(F.max("pos").alias("length"), F.max(F.when(F.col("pos") == F.col("head"), F.col("code"))).alias("code"))
    nothing = lambda c, t: F.lit(None).cast(t).alias(c)
    first = turns.where((F.col("conv_id") == F.col("base")) & (F.col("pos") < SHARED))
    known = convs.select("base", "conv_id", "head", "length", "code", nothing("pos", "long"), nothing("before", "binary"), nothing("bytes", "long"))
    known = known.unionByName(first.select("base", nothing("conv_id", "long"), nothing("head", "long"), nothing("length", "long"), "code", "pos", "before", "bytes"))
    # what a family knows goes to each block of its turns
    blocks = convs.groupBy("base").agg(F.max(F.greatest(F.lit(0), F.floor((F.col("length") - F.col("head") - 1) / block))).cast("int").alias("last"))
    known = materialize(known.join(blocks, "base").withColumn("block", F.explode(F.sequence(F.lit(0), "last"))).drop("last"))
    own = turns.where(F.col("pos") > F.col("head")).withColumn("block", F.floor((F.col("pos") - F.col("head") - 1) / block).cast("int"))
    own = own.select("base", "block", "conv_id", "pos", "code", "before", "bytes").groupBy("base", "block")
    return materialize(known.groupBy("base", "block").cogroup(own).applyInArrow(_family, NODES))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces ``node, first, ids`` of the ids of each node, comma-joined; rows come in order."""
    node, first, held, size = None, None, [], 0
    names = ["node", "first", "ids"]

    def piece() -> pa.RecordBatch:
        return pa.record_batch([pa.array([node], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(held)], pa.string())], names=names)

    for b in slices(batches, 4096):
        out = []
        for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if n != node or size > PIECE:
                if held:
                    out.append(piece())
                node, first, held, size = n, c, [], 0
            held.append(str(c))
            size += len(held[-1]) + 1
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
    if held:
        yield piece()


def _hashed_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, state = None, None
    for b in slices(batches, 64):
        nodes, hashes = [], []
        for n, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if n != node:
                if state is not None:
                    nodes.append(node)
                    hashes.append(state.hexdigest())
                node, state = n, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.record_batch([pa.array(nodes, pa.binary()), pa.array(hashes, pa.string())], names=["node", "ends_sha256"])
    if state is not None:
        yield pa.record_batch([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])


def ends_digests(families: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of the nodes at which conversations end: ids ascending, comma-joined.

    Ids are sorted over all partitions and joined into pieces there; only pieces of a node
    meet, one after the other, so no list of ids is ever held.
    """
    ids = families.select("node", F.explode("ends").alias("conv_id"))
    ids = ids.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = ids.mapInArrow(_joined_ids, "node binary, first long, ids string")
    pieces = pieces.repartition("node").sortWithinPartitions("node", "first")
    return pieces.select("node", "ids").mapInArrow(_hashed_pieces, "node binary, ends_sha256 string")


def conversation_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root),
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``. Null
    conversation ids are left out, null turns come first, null roles and texts are empty,
    repeated turns count each, other columns are ignored; an empty table has no node.
    """
    families = family_nodes(conversations, block)
    nodes = families.groupBy("node").agg(
        F.min(F.array_min("members")).alias("conv_id"),
        F.sum(F.size("members")).cast("long").alias("n_convs"),
        *(F.min(c).alias(c) for c in ("depth", "parent", "bytes")),
    )
    nodes = materialize(nodes)
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("bytes")
    nodes = materialize(nodes.select("node", "conv_id", "depth", "parent", "n_convs", "n_children", leaf.alias("leaf"), saved.alias("saved")))
    # members that do not own a node, once for each
    owners = nodes.select("node", F.col("conv_id").alias("owner"))
    guests = spread_join(families.select("node", "depth", "members"), owners, ["node"], "inner", "members", counted=families)
    guests = guests.select("node", "depth", "owner", F.explode("members").alias("member")).where("member <> owner")
    guests = materialize(guests)
    # what lies on a conversation's own piece, from each of its nodes on, block by block
    part = F.floor(F.col("depth") / block).alias("part")
    pieces = nodes.groupBy("conv_id", part).agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("tokens"))
    later = W.partitionBy("conv_id").orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select("conv_id", "part", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(c) for c in ("leaves", "tokens")))
    rest = W.partitionBy("conv_id", "part").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    own = nodes.withColumn("part", part).join(pieces, ["conv_id", "part"])
    own = own.withColumn("leaves", F.col("leaves") + F.sum("leaf").over(rest)).withColumn("tokens", F.col("tokens") + F.sum("saved").over(rest)).drop("part")
    # and the whole pieces of the others that pass through
    whole = nodes.groupBy(F.col("conv_id").alias("member")).agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("tokens"))
    passing = guests.join(whole, "member").groupBy("node").agg(F.sum("leaves").alias("more_leaves"), F.sum("tokens").alias("more_tokens"))
    above = guests.select(F.col("node").alias("parent"), F.col("member").alias("conv_id"), F.col("owner").alias("parent_owner"))
    out = own.join(passing, "node", "left").join(above, ["parent", "conv_id"], "left").join(ends_digests(families), "node", "left")
    nobody = hashlib.sha256().hexdigest()
    return out.select(
        "conv_id",
        "depth",
        F.when(F.col("parent").isNotNull(), F.coalesce("parent_owner", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).cast("long").alias("n_leaves"),
        (F.col("tokens") + F.coalesce("more_tokens", F.lit(0))).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"),
    )
