"""Suffix arrays by induced sorting, and permuted common prefixes, for one shard in a task.

Suffixes are classified as S (smaller than the next one) or L (larger). Leftmost S suffixes
(those behind an L) are sorted through the substrings between them, which are named and
sorted recursively where names repeat; all others are then induced in linear time, first L
from left to right, then S from right to left, a bucket at a time with array operations. Names
whose alphabet is large against their number are sorted by doubling instead.
"""

from __future__ import annotations

import numpy as np

#: Symbols for each letter from which suffixes are induced, whole buckets at a time.
DENSE = 64


def _s_type(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last one is."""
    n = len(text)
    step = np.sign(np.diff(text))
    # a run of equal symbols is of the type of its end
    known = np.flatnonzero(step)
    after = np.searchsorted(known, np.arange(n - 1))
    out = np.ones(n, bool)
    out[:-1] = step[known[after]] > 0 if len(known) else False
    return out


def _by_bucket(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray, letters: int) -> np.ndarray:
    counts = np.bincount(text, minlength=letters)
    tails = np.cumsum(counts)
    heads = tails - counts
    s_counts = np.bincount(text[is_s], minlength=letters)
    s_from = tails - s_counts
    out = np.full(len(text), -1, np.int64)
    # the leftmost S suffixes in their order, by bucket
    order = np.argsort(text[lms], kind="stable")
    lms, lms_at = lms[order], np.concatenate([[0], np.cumsum(np.bincount(text[lms], minlength=letters))])

    def deal(found: np.ndarray, own: int, at: np.ndarray, forward: bool) -> np.ndarray:
        """Put suffixes into the buckets of their symbols, in order; those of ``own`` come back."""
        symbols = text[found]
        by = np.argsort(symbols, kind="stable")
        found, symbols = found[by], symbols[by]
        starts = np.flatnonzero(np.diff(symbols, prepend=-1))
        mine = found[:0]
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(found)]):
            c = int(symbols[a])
            if forward:
                out[at[c] : at[c] + b - a] = found[a:b]
                at[c] += b - a
            else:
                at[c] -= b - a
                out[at[c] : at[c] + b - a] = found[a:b][::-1]
            if c == own:
                mine = found[a:b]
        return mine

    at = heads.copy()
    for c in np.flatnonzero(counts).tolist():
        # L suffixes in bucket c are those put there so far and those these put there themselves
        front = out[heads[c] : at[c]]
        while len(front):
            before = front[front > 0] - 1
            front = deal(before[~is_s[before]], c, at, True)
        before = lms[lms_at[c] : lms_at[c + 1]] - 1
        deal(before[before >= 0], c, at, True)
    at = tails.copy()
    for c in np.flatnonzero(counts)[::-1].tolist():
        # S suffixes from the right: those put into bucket c so far, then its L suffixes
        front = out[at[c] : tails[c]][::-1]
        while len(front):
            before = front[front > 0] - 1
            front = deal(before[is_s[before]], c, at, False)
        before = out[heads[c] : s_from[c]][::-1]
        before = before[before > 0] - 1
        deal(before[is_s[before]], c, at, False)
    out[0] = len(text) - 1  # the end mark is in no other suffix's way
    return out


def _by_doubling(text: np.ndarray) -> np.ndarray:
    """The sorted suffixes by ranks of their beginnings, of twice the length each time; only
    those that still tie are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    places, width = np.arange(n), 1
    group, second = text[order], np.zeros(n, np.int64)
    rank = np.empty(n, np.int64)
    while True:
        new = np.ones(len(places), bool)
        new[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        rank[order[places]] = places[np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))]
        places = places[~(new & np.append(new[1:], True))]
        if not len(places):
            return order
        # the last symbol occurs once, so suffixes that tie go on behind what they share
        at = order[places]
        group, second = rank[at], rank[at + width]
        by = np.argsort(group * n + second)
        order[places], group, second = at[by], group[by], second[by]
        width *= 2


def _names(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks of the substrings from each leftmost S suffix to the next, in text order.

    ``order``: the suffixes sorted by those substrings, so equal ones are neighbours.
    """
    n = len(text)
    ends = np.append(lms[1:], n - 1)
    length = np.zeros(n, np.int64)
    length[lms] = ends - lms + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    left = np.flatnonzero(same)
    at = 0
    while len(left):
        x, y = a[left], b[left]
        differ = text[x + at] != text[y + at]
        same[left[differ]] = False
        at += 1
        left = left[~differ & (length[x] > at)]
    name = np.empty(n, np.int64)
    name[order] = np.concatenate([[0], np.cumsum(~same)])
    return name[lms]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The sorted suffixes of ``text``, non-negative whole numbers of which the last is the
    only 0."""
    text = np.asarray(text, np.int64)
    n, letters = len(text), int(text.max()) + 1
    if n == 1:
        return np.zeros(1, np.int64)
    if n < DENSE * letters:
        return _by_doubling(text)
    is_s = _s_type(text)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    rough = _by_bucket(text, is_s, lms, letters)
    order = rough[is_lms[rough]]
    names = _names(text, lms, order)
    if names.max() + 1 == len(lms):
        by = np.empty(len(lms), np.int64)
        by[names] = np.arange(len(lms))
    else:
        by = suffix_array(names)
    return _by_bucket(text, is_s, lms[by], letters)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """By text position: how much a suffix shares with the one before it in ``order``.

    A suffix whose predecessor stands behind the same symbol as itself shares one symbol less
    than the suffix before it in the text, so only the others are compared, all at once.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[order[1:]], before[order[0]] = order[:-1], -1
    place = np.arange(n)
    # the sentinel's suffix has no predecessor and shares nothing; nor does what follows it
    reducible = (place > 0) & (before > 0)
    reducible[1:] &= (text[before[1:] - 1] == text[:-1]) & (before[:-1] >= 0)
    ask = np.flatnonzero(~reducible & (before >= 0))
    shared = np.zeros(n, np.int64)
    # words of eight symbols first, then symbols
    padded = np.concatenate([np.asarray(text, np.uint8 if text.max() < 256 else np.uint16), np.zeros(64, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    width = 8
    left, a, b = ask, ask.copy(), before[ask].copy()
    while len(left):
        room = np.maximum(a, b) + width <= n
        equal = np.zeros(len(left), bool)
        equal[room] = (words[a[room]] == words[b[room]]).all(axis=1)
        stop = ~equal
        x, y, k = a[stop], b[stop], left[stop]
        gone = np.zeros(len(x), np.int64)
        going = np.arange(len(x))
        while len(going):
            same = padded[x[going]] == padded[y[going]]
            same &= np.maximum(x[going], y[going]) < n
            going = going[same]
            gone[going] += 1
            x[going] += 1
            y[going] += 1
        shared[k] = x - k
        left, a, b = left[equal], a[equal] + width, b[equal] + width
    # the others follow from the nearest one before them
    base = np.where(reducible, -1, place)
    base = np.maximum.accumulate(base)
    return np.where(reducible, shared[base] - (place - base), shared)
