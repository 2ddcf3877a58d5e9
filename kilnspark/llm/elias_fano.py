"""Elias-Fano coded ascending integers and packed ones, with vectorised search, in mapped files."""

from __future__ import annotations

import json
import os
import tempfile

import numpy as np
from pyarrow import fs

_U64 = np.uint64
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(bool)


def _places(bits: np.ndarray) -> np.ndarray:
    """Place of the r-th set bit of each byte, in row-major order; 8 where there are fewer."""
    out = np.full((256, 8), 8, np.int64)
    byte, place = np.nonzero(bits)
    out[byte, np.cumsum(bits, axis=1)[byte, place] - 1] = place
    return out


_ONE_AT = _places(_BITS)
#: The lowest and the highest bit of each byte of a word.
_LOWEST, _HIGHEST = _U64(0x0101010101010101), _U64(0x8080808080808080)


def save_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """All arrays in one file of any file system that Arrow knows; written aside and renamed,
    so a retried task does no harm."""
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(os.path.dirname(path))
    aside = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    with where.open_output_stream(aside) as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            out.write(a.tobytes() + b"\0" * (-a.nbytes % 64))
    where.move(aside, path)


def load_arrays(uri: str) -> dict[str, np.ndarray] | None:
    """Views into the memory-mapped file, whose pages are read when touched; None if there is
    no such file. A file of an object store is copied once by each worker that asks for it."""
    where, path = fs.FileSystem.from_uri(uri)
    if where.get_file_info(path).type == fs.FileType.NotFound:
        return None
    if isinstance(where, fs.LocalFileSystem):
        data = np.asarray(np.memmap(path, np.uint8, "r"))
    else:
        with tempfile.TemporaryFile() as copy, where.open_input_stream(path) as given:
            while part := given.read(1 << 24):
                copy.write(part)
            copy.flush()
            data = np.asarray(np.memmap(copy, np.uint8, "r"))  # the mapping outlives the file's name
    size = int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8 : 8 + size].tobytes())
    return {
        name: data[8 + size + at : 8 + size + at + n * np.dtype(kind).itemsize].view(kind)
        for name, (kind, n, at) in head.items()
    }


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` bits of each value, end to end, in 64-bit words (one spare word)."""
    words = np.zeros(len(values) * width // 64 + 2, _U64)
    if width:
        at = np.arange(len(values), dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(_U64)
        np.bitwise_or.at(words, word, values << shift)
        over = shift.astype(np.int64) + width > 64
        np.bitwise_or.at(words, word[over] + 1, values[over] >> (_U64(64) - shift[over]))
    return words


def packed(words: np.ndarray, width: int, i: np.ndarray) -> np.ndarray:
    """The values at places ``i`` of what :func:`pack_bits` made."""
    if not width:
        return np.zeros(len(i), _U64)
    at = i * width
    word, shift = at >> 6, (at & 63).astype(_U64)
    # a shift by 64 is undefined, so shift twice
    return (words[word] >> shift | words[word + 1] << (_U64(63) - shift) << _U64(1)) & _U64(2**width - 1)


def search_packed(words: np.ndarray, width: int, low: np.ndarray, high: np.ndarray, want: np.ndarray) -> np.ndarray:
    """For each value its place among the ascending ones at ``low`` to ``high`` (exclusive); -1 if none."""
    out = np.full(len(want), -1, np.int64)
    at = np.flatnonzero(low < high)
    lo, hi, want = low[at], high[at] - 1, want[at]
    while len(at):
        mid = (lo + hi) >> 1
        here = packed(words, width, mid)
        less = here < want
        out[at[here == want]] = mid[here == want]
        lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid - 1)
        left = (lo <= hi) & (here != want)
        at, lo, hi, want = at[left], lo[left], hi[left], want[left]
    return out


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays that hold ascending uint64 ``values`` below ``universe``.

    The low bits stand side by side; the high parts are one unary bit vector, with the
    zeros before each of its words as a directory.
    """
    n = len(values)
    width = max(0, (universe // max(1, n)).bit_length() - 1)
    low = pack_bits(values & _U64(2**width - 1) if width < 64 else values, width)
    high = (values >> _U64(width)).astype(np.int64) if width < 64 else np.zeros(n, np.int64)
    ones = high + np.arange(n)
    top = universe - 1 >> width
    size = (top + n) // 64 + 1
    bits = np.zeros(size * 64, np.uint8)
    bits[ones] = 1
    unary = np.packbits(bits, bitorder="little").view(_U64)
    per_word = bits.reshape(size, 64).sum(axis=1, dtype=np.int64)
    zeros = np.arange(size, dtype=np.int64) * 64 - np.concatenate([[0], np.cumsum(per_word)[:-1]])
    return {"low": low, "unary": unary, "zeros": zeros, "shape": np.array([n, width, top], np.int64)}


class EliasFano:
    """Search in what :func:`encode` made."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.low, self.unary, self.zeros = arrays["low"], arrays["unary"], arrays["zeros"]
        self.n, self.width, self.top = map(int, arrays["shape"])
        self.ones: np.ndarray | None = None

    def _zero(self, rank: np.ndarray) -> np.ndarray:
        """Positions of the zeros of these ranks (from 0) in the unary vector."""
        word = np.searchsorted(self.zeros, rank, side="right") - 1
        return self._within(word, rank - self.zeros[word], ~self.unary[word])

    def _one(self, rank: np.ndarray) -> np.ndarray:
        if self.ones is None:
            self.ones = np.arange(len(self.zeros)) * 64 - self.zeros
        word = np.searchsorted(self.ones, rank, side="right") - 1
        return self._within(word, rank - self.ones[word], self.unary[word])

    @staticmethod
    def _within(word: np.ndarray, left: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Place of the set bit of rank ``left`` in each word: first its byte, then its place there.

        The eight bytes of a word are counted side by side in it.
        """
        n = bits - (bits >> _U64(1) & _U64(0x5555555555555555))
        n = (n & _U64(0x3333333333333333)) + (n >> _U64(2) & _U64(0x3333333333333333))
        upto = (n + (n >> _U64(4)) & _U64(0x0F0F0F0F0F0F0F0F)) * _LOWEST  # set bits up to each byte
        passed = (np.minimum(left, 64).astype(_U64) * _LOWEST | _HIGHEST) - upto & _HIGHEST
        byte = np.minimum(np.bitwise_count(passed), 7)
        shift = byte.astype(_U64) << _U64(3)
        before = (upto << _U64(8) >> shift & _U64(255)).astype(np.int64)
        return word * 64 + byte * np.int64(8) + _ONE_AT[bits >> shift & _U64(255), np.clip(left - before, 0, 7)]

    def lows(self, i: np.ndarray) -> np.ndarray:
        return packed(self.low, self.width, i)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        return (self._one(i) - i) << self.width | self.lows(i).astype(np.int64)

    def successor(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value at or above each key (n if none), and whether it equals it."""
        keys = keys.astype(_U64)
        if not self.n or not len(keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        high = (keys >> _U64(self.width)).astype(np.int64)
        inside = high <= self.top
        high = np.minimum(high, self.top)
        # values with this high part stand between two zeros of the unary vector
        start = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) - np.maximum(high - 1, 0), 0)
        end = np.minimum(self._zero(high) - high, self.n)
        start, want = np.minimum(start, self.n), keys & _U64(2**self.width - 1)
        lo, hi = start.copy(), end.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            less = np.zeros(len(lo), bool)
            less[open_] = self.lows(mid[open_]) < want[open_]
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        hit = inside & (lo < end)
        hit[hit] = self.lows(lo[hit]) == want[hit]
        return np.where(inside, lo, self.n), hit
