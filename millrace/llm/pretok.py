"""Byte-level BPE pre-tokenisation shared by encoding and counting.

Splitting before a single space between two non-space characters never cuts a
pre-token: a pre-token takes at most one leading space and otherwise holds no
white space, or is white space only, and a lone space before a non-space
always opens the next pre-token.  Texts are therefore first cut at those
spaces, which is cheap, and the resulting segments (mostly single words) are
pre-tokenised one by one and remembered.
"""

from __future__ import annotations

import re

import regex

# The split pattern published with the 50k byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PRETOKEN = regex.compile(PATTERN)
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def segments(text: str) -> list[str]:
    """Cut a text before lone spaces; every element but the first lost one
    leading space.  Python counts more characters as white space than the
    pattern does, so doubtful places are simply not cut."""
    return _LONE_SPACE.split(text)


def boundaries(text: str) -> list[int]:
    """Start offset of every pre-token."""
    return [m.start() for m in PRETOKEN.finditer(text)]


class Memo(dict):
    """A dict that fills itself and forgets everything at ``limit`` entries."""

    def __init__(self, fill, limit: int = 200_000):
        super().__init__()
        self.fill, self.limit = fill, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self.fill(key)
        if len(key) <= 64:
            self[key] = value
        return value
