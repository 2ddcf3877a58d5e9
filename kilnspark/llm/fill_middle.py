"""Fill-in-the-middle transformation with a sparse checkpoint index.

One map over whole texts. While the units of a text are counted, block by block of its bytes,
the place of every few hundredth unit is put down as a checkpoint: units, bytes and code
points before it. A cut is found by binary search among the checkpoints and a short rescan
from there, so what is held for a text is a small part of it and no list of its units exists.

A unit is a run of characters that are no white space, with the white space before it; white
space at the end of a text is a unit of its own. White space is ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: fixed values: the marks of prefix, suffix and middle
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units between checkpoints, and bytes looked at in one go.
EVERY, BLOCK = 256, 1 << 16

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _ends(data: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Where units end (first byte behind each) that have their last byte in ``[start, stop)``."""
    blank = _BLANK[data[start : stop + 1]]
    if stop >= len(data):  # the text's end ends a unit, of either kind
        ends = np.flatnonzero(~blank[:-1] & blank[1:]) + start + 1
        return np.append(ends, len(data)) if stop > start else ends
    return np.flatnonzero(~blank[:-1] & blank[1:]) + start + 1


def _points(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes: all but continuation bytes begin one."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


class UnitIndex:
    """Counts the units of UTF-8 bytes and finds where the first ``u`` of them end."""

    def __init__(self, text: bytes, every: int = EVERY, block: int = BLOCK):
        self.data, self.every, self.block = np.frombuffer(text, np.uint8), every, block
        #: units, bytes and code points before each checkpoint
        self.units, self.bytes, self.points = [0], [0], [0]
        self.n = 0
        for start in range(0, len(text), block):
            ends = _ends(self.data, start, min(start + block, len(text)))
            for i in range(every - 1 - self.n % every, len(ends), every):
                at = int(ends[i])
                self.points.append(self.points[-1] + _points(self.data[self.bytes[-1] : at]))
                self.units.append(self.n + i + 1)
                self.bytes.append(at)
            self.n += len(ends)

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points that the first ``units`` units take."""
        k = bisect_right(self.units, units) - 1
        at, left, step = self.bytes[k], units - self.units[k], min(self.block, 4096)
        here = at
        while left:
            ends = _ends(self.data, here, min(here + step, len(self.data)))
            if len(ends) >= left:
                here = int(ends[left - 1])
                break
            left -= len(ends)
            here += step
        return here, self.points[k] + _points(self.data[at:here])


def rearranged(text: str, h1: int, h2: int, h3: int, h4: int, rate: int, spm: int, every: int = EVERY) -> tuple:
    """``n, form, prefix_chars, middle_chars, output`` of one text and its four numbers."""
    data = text.encode("utf-8", "replace")
    index = UnitIndex(data, every)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return index.n, "plain", None, None, text
    first, second = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    (a, before), (b, until) = index.cut(first), index.cut(second)
    prefix, middle, suffix = (part.decode() for part in (data[:a], data[a:b], data[b:]))
    if h4 % 100 < spm:
        return index.n, "spm", before, until - before, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return index.n, "psm", before, until - before, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, every: int = EVERY) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: each text, cut and rearranged.

    The numbers that choose cuts and form are the first four groups of eight digits of the
    sha256 of ``seed:doc_id``. ``form`` is plain for ``100 - rate`` texts of a hundred, for
    empty ones and for those that hold a mark; else spm for ``spm`` of a hundred, else psm.

    A null text counts as empty, a null id as an empty one; repeated rows each give their
    row; an empty table gives none; other columns are dropped, whatever their names.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit(""))), 256)
    number = lambda i: F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), digest.alias("digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]
        for b in slices(batches, 64):
            made = [rearranged(*row, rate, spm, every) for row in zip(*(b.column(i).to_pylist() for i in range(1, 6)))]
            columns = [pa.array(c, t) for c, t in zip(zip(*made), kinds)]
            columns[-1] = columns[-1].cast(pa.string())
            yield pa.record_batch([b.column(0), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.select("doc_id", "text", *(number(i) for i in range(4))).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that :func:`fill_in_middle` made ``output`` of.

    No part holds a mark, and no mark overlaps another, so the first of each is the one put in.
    """
    marks = {"spm": (SUFFIX, PREFIX), "psm": (PREFIX, SUFFIX)}

    def text(kind: str) -> Column:
        opening, between = marks[kind]
        body = F.substr(output, F.lit(len(opening) + 1))
        one = F.substring_index(body, between, 1)
        rest = F.substr(body, F.length(one) + len(between) + 1)
        two = F.substring_index(rest, MIDDLE, 1)
        middle = F.substr(rest, F.length(two) + len(MIDDLE) + 1)
        return F.concat(two, middle, one) if kind == "spm" else F.concat(one, middle, two)

    return F.when(form == "plain", output).when(form == "spm", text("spm")).otherwise(text("psm"))
