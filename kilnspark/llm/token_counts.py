"""Unigram token counts without producing tokens.

An Aho-Corasick automaton lists every vocabulary piece that occurs in a stretch of text;
dynamic programming carries the best score and the number of pieces to each position. The
tie rules are those of the unigram tokenizer: among equal scores the piece that starts
first wins; a character that no single-character piece covers costs ten less than the
lowest score of the vocabulary and counts as its UTF-8 bytes (byte fallback). Scores are
added in single precision, as there, but each stretch (below) starts anew from 0, where the
tokenizer goes on adding over the whole text; so ties within a stretch are decided without
the rounding that a long text before it would bring.

Blanks become the mark U+2581 and one is put before the text. No piece may hold the mark
after another character (checked), so the best path never crosses from a word into the
next mark: each stretch of marks and the word after it is solved on its own, and equal
stretches are solved once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def read_pieces(model_path: str, lift: bool = True) -> list[tuple[str, float]]:
    """The normal pieces and scores of a sentencepiece model file.

    Pieces that merges never make carry a score of about -1e9, beside which single
    precision cannot hold other scores; with ``lift`` they get the lowest other score, less
    one, without it the table is used as it is.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [
        (sp.id_to_piece(i), sp.get_score(i))
        for i in range(sp.get_piece_size())
        if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))
    ]
    lowest = min((s for _, s in pieces if s > -1e8), default=0.0)
    return [(p, s if s > -1e8 or not lift else lowest - 1) for p, s in pieces]


class Counter(dict):
    """(pieces, score) of stretches of marked text, solved when first asked for."""

    def __init__(self, pieces: list[tuple[str, float]], limit: int = 1_000_000):
        super().__init__()
        if crossing := [p for p, _ in pieces if re.search(f"[^{MARK}]{MARK}", p)]:
            raise ValueError(f"pieces that cross words: {crossing[:5]}")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = float(np.float32(min(s for _, s in pieces)) - np.float32(UNKNOWN_PENALTY))
        # sums of whole numbers below 2 ** 24 are the same in single and double precision
        scores = [self.unknown, *(s for _, s in pieces)]
        self.exact = 2**24 / max(map(abs, scores), default=1) if all(s == int(s) for s in scores) else 0
        self.stretches = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.limit = limit

    def solve(self, marked: str) -> tuple[int, float]:
        n = len(marked)
        single_precision = n >= self.exact
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        single = [False] * n
        for last, (length, score) in self.automaton.iter(marked):
            ending[last + 1].append((last + 1 - length, score))
            if length == 1:
                single[last] = True
        best = [0.0] * (n + 1)
        count = [0] * (n + 1)
        for end in range(1, n + 1):
            steps = ending[end]
            if len(steps) > 1:
                steps.sort()  # by start: no two pieces start and end alike
            top, pieces = -math.inf, 0
            for start, score in steps:
                total = best[start] + score
                if single_precision:
                    total = float(np.float32(total))
                if total > top:
                    top, pieces = total, count[start] + 1
            if not single[end - 1]:
                total = best[end - 1] + self.unknown
                if single_precision:
                    total = float(np.float32(total))
                if total > top:
                    top, pieces = total, count[end - 1] + len(marked[end - 1].encode())
            best[end], count[end] = top, pieces
        return count[n], best[n]

    def __missing__(self, stretch: str) -> tuple[int, float]:
        if len(self) >= self.limit:
            self.clear()
        found = self.solve(stretch)
        if len(stretch) <= 64:  # long ones hardly recur
            self[stretch] = found
        return found

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        found = list(map(self.__getitem__, self.stretches.findall(MARK + text.replace(" ", MARK))))
        return sum(n for n, _ in found), float(sum(s for _, s in found))


_COUNTERS: dict[tuple[str, bool], Counter] = {}


def count_tokens(docs: DataFrame, model_path: str, lift: bool = True) -> DataFrame:
    """``doc_id, n_tokens, score`` of every whole text; null or empty texts have no tokens.

    ``score`` is the sum of the piece scores of the best segmentation. Repeated rows are
    each counted. Other columns of ``docs`` play no part. ``lift``: see :func:`read_pieces`.
    One map stage, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (model_path, lift) not in _COUNTERS:
            _COUNTERS[model_path, lift] = Counter(read_pieces(model_path, lift))
        counter = _COUNTERS[model_path, lift]
        for b in slices(batches):
            found = [counter.count(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch(
                [b.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())],
                names=["doc_id", "n_tokens", "score"],
            )

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, score double")
