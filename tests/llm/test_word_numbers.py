"""Language model: tokens are numbered in one pass, bits are found in words."""

import numpy as np

from kilnspark.llm.elias_fano import EliasFano, encode
from kilnspark.llm.lm_scoring import Words, word_hash


class _Counted(list):
    passes = 0

    def __iter__(self):
        self.passes += 1
        return super().__iter__()


def test_tokens_are_gone_through_once():
    words = Words(lambda h: (h, h + np.uint64(1)), limit=6)
    for batch in (b"a b a c".split(), b"c d a".split(), b"a e f g".split(), b"h h".split(), b"a i j k l m n o p".split()):
        given = _Counted(batch)
        at = words(given)
        assert given.passes == 1
        assert words.columns[0][at].tolist() == [word_hash(w) for w in batch]
        assert len(words.index) == len(words.columns[1])
    assert words(_Counted(b"q".split())).tolist() == [0]  # emptied


def test_bits_of_all_ranks():
    rng = np.random.default_rng(2)
    for n, top in ((1, 1), (70, 90), (500, 600), (500, 10**6), (300, 2**63), (0, 5)):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        held = EliasFano(encode(values, top))
        assert held.access(np.arange(n)).astype(np.uint64).tolist() == values.tolist()
        asked = np.concatenate([values, rng.integers(0, top, 50, dtype=np.uint64)])
        at, hit = held.successor(asked)
        assert at.tolist() == np.searchsorted(values, asked).tolist()
        assert hit.tolist() == np.isin(asked, values).tolist()
