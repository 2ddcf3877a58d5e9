"""Repeated bytes: what is left out before a shard is sorted, and how names are sorted."""

import random

import numpy as np

from kilnspark.llm import repeats, suffix_array

LENGTH, GRAM = 40, 10


def _contexts(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    keys, lo, hi, _ = repeats.runs(data, starts, LENGTH, GRAM)
    whole = data.tobytes()
    return sorted((k, whole[a : b + LENGTH - 1]) for k, a, b in zip(keys.view(np.int64).tolist(), lo.tolist(), hi.tolist()))


def _repeating(contexts):
    seen = {}
    for i, (_, c) in enumerate(contexts):
        for at in range(len(c) - LENGTH + 1):
            seen.setdefault(c[at : at + LENGTH], []).append(i)
    return {i for where in seen.values() if len(where) > 1 for i in where}


def test_contexts_that_may_repeat_stay_and_most_others_go():
    rng = random.Random(3)
    made = lambda n: bytes(rng.choices(b"abcdefghijklmnop", k=n))
    passage, phrase = made(70), made(14)
    texts = [made(60) + phrase + made(60) for _ in range(60)]  # a shared string, no shared window
    texts += [made(30) + passage[i % 5 : 50 + i] + made(30) for i in range(20)]
    texts += [b"x" * 90, (b"ab" * 60), made(25) + b"0123456789" + made(20) + b"0123456789" + made(25)]
    contexts = _contexts(texts)
    kept = set(np.flatnonzero(repeats.may_repeat(contexts, LENGTH, GRAM)).tolist())
    must = _repeating(contexts)
    assert must and must <= kept
    shared = [i for i, (_, c) in enumerate(contexts) if phrase[2:12] in c]
    assert len(shared) >= 60 and len(kept) <= 2 * len(must) + 5 and len(kept & set(shared)) < len(shared) / 4


def test_names_are_sorted_by_doubling():
    rng = np.random.default_rng(5)
    periodic = np.tile(rng.integers(1, 4, 7), 300)
    for text in (rng.integers(1, 3, 500), rng.integers(1, 400, 2000), np.ones(600, int), periodic, np.concatenate([periodic, periodic[3:]]), np.arange(1, 50)):
        text = np.append(text, 0).astype(np.int64)
        plain = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        assert suffix_array._by_doubling(text).tolist() == plain == suffix_array.suffix_array(text).tolist()
    assert suffix_array._by_doubling(np.zeros(1, np.int64)).tolist() == [0]
