"""The chunkers as plain loops over one text: what the DataFrame versions are held against."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from kilnspark.functions.text import ANCHOR_LETTERS, DIACRITICS
from kilnspark.operators.chunking import BOUNDARY_HINTS, PREAMBLE, SECTION_KINDS, SIMPLE_ANCHORS

_MARKER = re.compile(r"\[PAGE\s*(\d+)\]\s*\n?")
_SENTENCE_END = re.compile(r"(?<!\d)[.؟!](?!\d)|:\s|\n{2,}")
_TOKEN = re.compile(r"\w+|[^\w\s]")

def count_tokens(text: str) -> int:
    """Words and punctuation marks; pass another counter where thresholds refer to one."""
    return len(_TOKEN.findall(text))


def strip_page_markers(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text without ``[PAGE N]`` markers, and (position, page) of each in what is left."""
    parts, pages, at, size = [], [], 0, 0
    for m in _MARKER.finditer(text):
        parts.append(text[at : m.start()])
        size += m.start() - at
        pages.append((size, int(m[1])))
        at = m.end()
    parts.append(text[at:])
    return "".join(parts), pages


def pages_of(start: int, end: int, pages: Sequence[tuple[int, int]]) -> list[int]:
    """The page in force at ``start`` (1 before any marker) and those that begin before ``end``."""
    current = 1
    found = set()
    for at, page in pages:
        if at <= start:
            current = page
        elif at < end:
            found.add(page)
    return sorted({current, *found})


def sentences(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Spans of sentences, each with its closing mark; together they are the whole span."""
    out, at = [], start
    for m in _SENTENCE_END.finditer(text, start, end):
        if m.end() > at:
            out.append((at, m.end()))
            at = m.end()
    return [*out, (at, end)] if at < end else out


_LETTERS = str.maketrans(*ANCHOR_LETTERS)
_MARKS = re.compile(DIACRITICS)


def anchor_view(text: str) -> tuple[str, Sequence[int]]:
    """The text as anchors are looked for in it (letters made alike, no marks), and the place
    in ``text`` of each of its characters and of its end."""
    alike = text.translate(_LETTERS)
    if not _MARKS.search(alike):
        return alike, range(len(text) + 1)
    places = [i for i, ch in enumerate(alike) if not _MARKS.match(ch)]
    return "".join(alike[i] for i in places), [*places, len(text)]


def anchors_in(pattern: re.Pattern | None, text: str) -> list[tuple[int, int]]:
    """Where anchors start and end in ``text``."""
    view, place = anchor_view(text)
    return [(place[m.start()], place[m.end() - 1] + 1) for m in pattern.finditer(view)] if pattern else []


@dataclass
class Chunk:
    start: int
    end: int
    title: str
    kind: str


class StructuralChunker:
    """Sections at anchors, packed into chunks of ``smallest`` to ``largest`` tokens."""

    def __init__(self, smallest: int = 150, largest: int = 400, overlap: int = 1, kinds=SECTION_KINDS, hints=BOUNDARY_HINTS, counter: Callable[[str], int] = count_tokens):
        if not 0 <= overlap or smallest > largest:
            raise ValueError("overlap must not be negative and smallest not above largest")
        self.smallest, self.largest, self.overlap, self.counter = smallest, largest, overlap, counter
        self.kinds = [(re.compile(p), k) for p, k in kinds]
        self.anchor = re.compile("|".join(p for p, _ in kinds)) if kinds else None
        self.hint = re.compile("|".join(hints)) if hints else None

    def sections(self, text: str) -> list[Chunk]:
        """From anchor to anchor; text before the first is a section without a title."""
        starts = [(a, text[a:b]) for a, b in anchors_in(self.anchor, text)]
        if not starts or text[: starts[0][0]].strip():
            starts.insert(0, (0, ""))
        else:
            starts[0] = (0, starts[0][1])
        ends = [s for s, _ in starts[1:]] + [len(text)]
        return [Chunk(s, e, t, self.kind(t)) for (s, t), e in zip(starts, ends)]

    def kind(self, title: str) -> str:
        view = anchor_view(title)[0]
        return next((k for p, k in self.kinds if view and p.search(view)), "text")

    def _pieces(self, text: str, section: Chunk) -> list[tuple[int, int]]:
        """Sentence spans, none longer than the limit, also cut before boundary hints."""
        cuts = {m.start() for m in self.hint.finditer(text, section.start, section.end)} if self.hint else set()
        out = []
        for s, e in sentences(text, section.start, section.end):
            edges = [s, *sorted(c for c in cuts if s < c < e), e]
            for a, b in zip(edges, edges[1:]):
                if self.counter(text[a:b]) <= self.largest:
                    out.append((a, b))
                    continue
                words = list(_TOKEN.finditer(text, a, b))
                for i in range(0, len(words), self.largest):
                    stop = words[i + self.largest].start() if i + self.largest < len(words) else b
                    out.append((a if i == 0 else words[i].start(), stop))
        return out

    def chunks(self, text: str) -> list[Chunk]:
        merged: list[Chunk] = []
        for section in self.sections(text):
            # a section below the minimum takes in what follows, up to the maximum
            if merged and self.counter(text[merged[-1].start : merged[-1].end]) < self.smallest and self.counter(text[merged[-1].start : section.end]) <= self.largest:
                merged[-1].end = section.end
            else:
                merged.append(section)
        out: list[Chunk] = []
        for section in merged:
            run: list[tuple[int, int]] = []
            size = 0
            for a, b in self._pieces(text, section):
                n = self.counter(text[a:b])
                hinted = self.hint is not None and self.hint.match(text, a)
                if run and (size + n > self.largest or (hinted and size >= self.smallest)):
                    out.append(Chunk(run[0][0], run[-1][1], section.title, section.kind))
                    back = run[len(run) - self.overlap :] if self.overlap and len(run) > self.overlap else []
                    while back and sum(self.counter(text[x:y]) for x, y in back) + n > self.largest:
                        back = back[1:]
                    run, size = list(back), sum(self.counter(text[x:y]) for x, y in back)
                run.append((a, b))
                size += n
            if run:
                out.append(Chunk(run[0][0], run[-1][1], section.title, section.kind))
        return [c for c in out if text[c.start : c.end].strip()]


class SimpleChunker:
    """The fallback: sections after each anchor, cut into windows of tokens."""

    def __init__(self, tokens: int = 400, overlap: int = 50, anchors=SIMPLE_ANCHORS):
        if not 0 <= overlap < tokens:
            raise ValueError("overlap must be below the window")
        self.tokens, self.overlap = tokens, overlap
        self.anchor = re.compile("|".join(anchors))

    def chunks(self, text: str) -> list[Chunk]:
        found = anchors_in(self.anchor, text)
        spans = [(0, found[0][0] if found else len(text), PREAMBLE)]
        spans += [(b, n[0] if n else len(text), text[a:b]) for (a, b), n in zip(found, [*found[1:], None])]
        out = []
        for start, end, title in spans:
            words = list(_TOKEN.finditer(text, start, end))
            step = self.tokens - self.overlap
            for i in range(0, max(1, len(words) - self.overlap), step):
                held = words[i : i + self.tokens]
                if held:
                    out.append(Chunk(held[0].start(), held[-1].end(), title, "text"))
        return out


def chunk_rows(chunker, text):
    """(index, content, start, end, pages, tokens, title, kind) of each chunk of a text."""
    text, pages = strip_page_markers(text or "")
    out = []
    for i, c in enumerate(chunker.chunks(text) if text.strip() else []):
        content = text[c.start : c.end]
        out.append((i, content, c.start, c.end, pages_of(c.start, c.end, pages), count_tokens(content), c.title, c.kind))
    return out
