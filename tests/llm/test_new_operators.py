"""Repeated strings, prefix trie and fill-in-the-middle against brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kilnspark.llm import fill_middle, prefix_trie, repeats, suffix_array

DOCS = "doc_id long, text string"


# --- suffix arrays -----------------------------------------------------------------------


def _suffixes(t):
    return sorted(range(len(t)), key=lambda i: t[i:])


def _shared(t, i, j):
    n = 0
    while i + n < len(t) and j + n < len(t) and t[i + n] == t[j + n]:
        n += 1
    return n


@pytest.mark.parametrize("dense", [0, 1, 64])
def test_suffix_array_and_common_prefixes(monkeypatch, dense):
    monkeypatch.setattr(suffix_array, "DENSE", dense)
    rnd = random.Random(dense)
    for _ in range(300):
        n, letters = rnd.randrange(0, 60), rnd.choice([1, 2, 3, 10, 400])
        t = [rnd.randrange(1, letters + 1) for _ in range(n)]
        if rnd.random() < 0.3:
            t = (t[:5] * 20)[:n]
        text = np.array([*t, 0])
        order = suffix_array.suffix_array(text)
        want = _suffixes(text.tolist())
        assert order.tolist() == want
        shared = suffix_array.common_prefixes(text, order)
        assert shared[want[0]] == 0
        assert all(shared[i] == _shared(text.tolist(), i, j) for j, i in zip(want, want[1:]))


def test_repeated_windows():
    contexts = [b"abcabcabd", b"xxabcabdyy", b"zz", b"xxabca"]
    found = repeats.repeated_windows(contexts, 4).tolist()
    whole, at = b"\0".join([*contexts, b""]), []
    count = Counter(c[i : i + 4] for c in contexts for i in range(len(c) - 3))
    for i in range(len(whole) - 3):
        w = whole[i : i + 4]
        if b"\0" not in w and count[w] > 1:
            at.append(i)
    assert found == at


# --- repeated strings --------------------------------------------------------------------


def removed_by_brute_force(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[s : s + length] for _, b in texts for s in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = tuple((m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone)))
        out.append((i, len(b), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def removed(df, **named):
    rows = repeats.without_repeats(df, **named).collect()
    return sorted(((r.doc_id, r.n_bytes, tuple(tuple(s) for s in r.spans), bytes(r.kept)) for r in rows), key=repr)


def texts_with_passages(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abé漢 ") for _ in range(rnd.randrange(1, 9))) for _ in range(60)]
    passages = [" ".join(rnd.choice(words) for _ in range(rnd.choice([5, 20, 60]))) for _ in range(12)]
    rows = []
    for i in range(80):
        t = " ".join(rnd.choice(passages) if rnd.random() < 0.3 else rnd.choice(words) for _ in range(rnd.randrange(0, 40)))
        if rnd.random() < 0.1:
            t += "a" * rnd.randrange(1, 900) + "ab" * rnd.randrange(0, 400)
        rows.append((i if rnd.random() < 0.95 else None, t if rnd.random() < 0.95 else None))
    # repeated rows, one id with other texts, long runs of one letter, empty and null texts
    return rows + rows[:4] + [(3, "x" * 30000), (4, "x" * 7000), (5, ""), (6, None)]


@pytest.mark.parametrize(("length", "gram", "key_bytes"), [(20, 8, 8_000_000), (20, 20, 8_000_000), (12, 5, 100), (200, 50, 8_000_000)])
def test_repeats_against_brute_force(spark, length, gram, key_bytes):
    rows = texts_with_passages(length + gram)
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    assert removed(df, length=length, gram=gram, key_bytes=key_bytes) == removed_by_brute_force(rows, length)


def test_repeats_of_odd_tables(spark):
    assert removed(spark.createDataFrame([], DOCS)) == []
    rows = [(1, "y" * 300, 0, "k"), (2, "z" * 100, 1, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, copy int, key string")
    assert removed(df) == [(1, 300, ((0, 300),), b""), (2, 100, (), b"z" * 100)]


def test_runs_do_not_depend_on_blocks(monkeypatch):
    """Windows and their keys are the same however texts are put together and cut."""
    rnd = random.Random(7)
    texts = [bytes(rnd.choice(b"abc ") for _ in range(rnd.randrange(0, 400))) for _ in range(40)] + [b"q" * 5000]

    def keys(block, most):
        monkeypatch.setattr(repeats, "BLOCK", block)
        monkeypatch.setattr(repeats, "RUN", most)
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.cumsum([0, *map(len, texts)])
        out = {}
        for first, last, a, z in repeats._pieces(offsets, 29):
            starts = np.maximum(offsets[first:last], a) - a
            real = np.flatnonzero(np.diff(np.append(starts, z - a)) > 0)
            for k, lo, hi, _ in zip(*repeats.runs(data[a:z], starts[real], 30, 10)):
                for w in range(lo, hi):
                    assert out.setdefault(int(w + a), int(k)) == int(k)
        return out

    small, large = keys(64, 16), keys(1 << 20, 4096)
    assert small == large
    windows = {o + i for o, t in zip(np.cumsum([0, *map(len, texts)]).tolist(), texts) for i in range(len(t) - 29)}
    assert set(small) == windows


# --- prefix trie -------------------------------------------------------------------------


def trie_by_brute_force(rows):
    turns, rebuilt, members, children, totals = {}, {}, {}, {}, {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    said = {c: [(r, x) for _, r, x in sorted(v)] for c, v in turns.items()}
    for c, own in said.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(said.get(base, [])[:h] + own[h:])
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    for path in sorted(members, key=len, reverse=True):
        below = [totals[k] for k in children.get(path, [])]
        saved = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        totals[path] = (sum(x for x, _ in below) or 1, sum(y for _, y in below) + saved)
    out = []
    for path, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(m), len(path), parent, len(m), len(children.get(path, [])), *totals[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string"


def trie(df, **named):
    return sorted((tuple(r) for r in prefix_trie.conversation_trie(df, **named).collect()), key=repr)


@pytest.mark.parametrize(("seed", "block"), [(0, 1 << 16), (1, 7), (2, 1)])
def test_trie_against_brute_force(spark, seed, block):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-6, 60), 40):
        for t in range(rnd.choice([1, 2, 5, 9, 14])):
            role = rnd.choice(["user", None, "a"]) if rnd.random() < 0.3 else "user"
            rows.append((c, rnd.choice([t, t, t, t, None, t + 1]), role, rnd.choice(["x", "y", "é", None, ""]) if rnd.random() < 0.6 else "x"))
    rows += [(20, t, "user", f"long {t % 7}") for t in range(300)]  # one conversation over several partitions
    rows += [(None, 1, "user", "z"), (3, None, None, None), (3, None, None, None)]
    assert trie(spark.createDataFrame(rows, TURNS).repartition(5), block=block) == trie_by_brute_force(rows)


def test_trie_of_odd_tables(spark):
    assert trie(spark.createDataFrame([], TURNS)) == []
    rows = [(c, t, "user", "hello", c, "n") for c in range(40) for t in range(3)]  # all alike
    df = spark.createDataFrame(rows, TURNS + ", node long, depth string")
    assert trie(df) == trie_by_brute_force([r[:4] for r in rows])


def test_ends_of_a_node_with_many_members(spark, monkeypatch):
    ids = spark.range(3000).select("id").withColumnRenamed("id", "c")
    families = ids.selectExpr("cast(repeat('n', 16) as binary) AS node", "array(c) AS ends")
    found = prefix_trie.ends_digests(families).collect()
    assert [r.ends_sha256 for r in found] == [hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest()]


# --- fill in the middle ------------------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def test_cuts_against_brute_force():
    rnd = random.Random(1)
    for _ in range(500):
        text = "".join(rnd.choice("ab é漢😀 \n\t\x0b\x85\xa0") for _ in range(rnd.randrange(0, 60)))
        units = UNIT.findall(text)
        index = fill_middle.UnitIndex(text.encode(), every=rnd.choice([1, 2, 3, 7]), block=rnd.choice([1, 2, 5, 16, 64]))
        assert index.n == len(units)
        for u in range(len(units) + 1):
            part = "".join(units[:u])
            assert index.cut(u) == (len(part.encode()), len(part))


def middle_by_brute_force(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    units = UNIT.findall(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text, text
    if h4 % 100 < 80:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def test_fill_in_middle_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choice("ab <>PSMé漢😀\n\t") for _ in range(rnd.randrange(0, 80)))) for i in range(300)]
    rows += [(None, "a b c"), (7, None), (8, ""), (9, "  "), (10, "a <P> b"), (11, "<"), rows[0], rows[0], (12, "word " * 50000), (13, "漢" * 70000 + " end ")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", n int, form string")
    out = fill_middle.fill_in_middle(df)
    got = out.withColumn("back", fill_middle.restored(out["output"], out["form"])).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted((middle_by_brute_force(*r) for r in rows), key=repr)
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert fill_middle.fill_in_middle(spark.createDataFrame([], DOCS)).collect() == []
