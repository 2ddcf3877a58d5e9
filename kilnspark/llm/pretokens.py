"""Exact pre-token splitting for the byte-level vocabularies."""

from __future__ import annotations

import re

import regex

#: Only these characters: here the faster expression below equals the general pattern.
_OTHER = re.compile("[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ɏ]")
_LATIN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
)
_ASCII = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+",
    re.ASCII,
)


class Splitter:
    """``split(text)`` lists the matches of ``pattern``.

    Texts of ASCII or Latin letters take an equivalent expression of the standard
    library when ``pattern`` is the one those expressions were written for; all others
    take ``pattern`` itself.
    """

    KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, pattern: str = KNOWN):
        self.general = regex.compile(pattern)
        self.fast = pattern == self.KNOWN

    def split(self, text: str) -> list[str]:
        if self.fast and not _OTHER.search(text):
            return (_ASCII if text.isascii() else _LATIN).findall(text)
        return self.general.findall(text)
