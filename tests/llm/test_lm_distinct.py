"""Language model: words, pairs and triples are asked for once in a batch, however often they occur."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from kilnspark.llm import lm_scoring


def test_work_grows_with_distinct_grams(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("a b c d e f g".split(), k=12))) for i in range(40)]
    model = lm_scoring.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    search, asked, numbered = lm_scoring.search_packed, [], []

    class Words(lm_scoring.Words):
        def __call__(self, words):
            numbered.append(len(words))
            return super().__call__(words)

    def counted(words, width, low, high, want):
        asked.append(len(want))
        return search(words, width, low, high, want)

    monkeypatch.setattr(lm_scoring, "search_packed", counted)
    monkeypatch.setattr(lm_scoring, "Words", Words)
    runs = []

    class Docs:  # stands for a DataFrame, so that the function of its tasks runs here
        sparkSession = spark

        def mapInArrow(self, run, schema):
            runs.append(run)

    monkeypatch.setattr(lm_scoring, "id_text", lambda docs: docs)
    lm_scoring.score(Docs(), model)
    work, scores = [], []
    for copies in (1, 20):
        asked.clear()
        numbered.clear()
        texts = [t for _, t in rows] * copies
        batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
        (out,) = runs[0](iter([batch]))
        work.append((sum(asked), sum(numbered)))
        scores.append(out.column(5).to_pylist())
    assert work[0] == work[1] and work[0][1] == 8
    assert scores[1] == pytest.approx(scores[0] * 20)
    assert all(math.isfinite(x) and x < 0 for x in scores[0])


def test_tokens_in_arrow():
    """As Python splits and lower-cases bytes, for every ASCII character and some others."""
    rng = random.Random(5)
    letters = [*map(chr, range(128)), *" \t\n\x0b\x0c\r" * 8, *"ÀÉİßǅ\x85\xa0   　﻿😀"]
    texts = ["", " ", "\n \t", "a", " A\x00b  İ ", *("".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(500))]
    for given in (pa.array(texts), pa.array(["x y", *texts, "z"])[1:-1], pa.array(texts, pa.large_string()), pa.array(["", " "]), pa.array([""]), pa.array([], pa.string())):
        distinct, at, starts = lm_scoring.numbered_tokens(given)
        want = [[*t.encode().lower().split(), b"\n"] for t in given.to_pylist()]
        assert [distinct[i] for i in at] == [w for ws in want for w in ws]
        assert starts.tolist() == np.cumsum([0, *map(len, want)])[:-1].tolist()
        assert len(set(distinct)) == len(distinct)


@pytest.mark.parametrize("bits", [8, 44, 64])
def test_sums_of_pairs_and_words(bits):
    rng = np.random.default_rng(bits)
    key = rng.integers(0, 2**bits - 1, 60, np.uint64, endpoint=True)[rng.integers(0, 60, 5000)]
    w = rng.choice(np.array([0, 1, 5, 2**31, 2**32 - 1], np.uint32), 5000)
    for n in (None, rng.integers(1, 2**32, 5000).astype(np.uint32)):
        want = {}
        for k, x, c in zip(key.tolist(), w.tolist(), [1] * 5000 if n is None else n.tolist()):
            want[k, x] = want.get((k, x), 0) + c
        got = [x.tolist() for x in lm_scoring.summed(key, w, n)]
        assert list(zip(*got)) == [(*k, c) for k, c in sorted(want.items())]


def test_word_counts_across_batches(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "KEPT", 20)
    monkeypatch.setattr(lm_scoring, "TEXTS", 3)
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randint(0, 50)}" for _ in range(rng.randint(0, 9))) for _ in range(60)]
    want = {}
    for t in texts:
        for w in [*t.encode().split(), b"\n"]:
            h = lm_scoring.word_hash(w)
            want[h] = want.get(h, 0) + 1
    got = lm_scoring.count_words(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert len(got) == len(want) and {r.h % 2**64: r.n for r in got} == want


def test_pairs_of_32_bits_keep_their_order():
    v, w = np.array([2**32 - 1, 2**31, 2**31, 1]), np.array([0, 2**32 - 1, 3, 2**31])
    x = lm_scoring.joined(v, w, 32)
    assert np.argsort(x).tolist() == [3, 2, 1, 0]
    assert [y.tolist() for y in lm_scoring.parted(x, 32)] == [v.tolist(), w.tolist()]
