"""Splitting texts before byte-level BPE, with words numbered as they are met."""

from __future__ import annotations

import os
import re

import numpy as np
import regex
from public_tokenizers import PATTERN, path

FULL = regex.compile(PATTERN)
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def vocabulary(given: str | None, name: str) -> str:
    """The file given, or the installed public one of that name; looked up where it is read."""
    return given if given and os.path.exists(given) else path(name)


#: Where a text has only ASCII but U+001C to U+001F, and letters from U+00C0 to U+024F, letters are
#: the word characters that are neither digits nor the underscore, and the standard library's
#: faster engine splits alike.
UNUSUAL = re.compile("[^\\x00-\\x1b\\x20-\\x7f\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f]")
#: A space that white space or the end follows.
GAP = re.compile(r" (?:\s|\Z)")


def split(text: str) -> list[str]:
    return (FULL if UNUSUAL.search(text) else PLAIN).findall(text)


class Numbers(dict):
    """Numbers what it is asked for, with a common list of what the numbers stand for."""

    def __init__(self, listed: list[str], lead: str):
        self.listed, self.lead = listed, lead

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self.listed)
        self.listed.append(self.lead + piece)
        return n


class Words:
    """The distinct pieces of a chunk of texts, numbered as they are met.

    A text is cut before each space. No match of the pattern has a space after another character
    that isn't white space, and what stands before a cut is matched as at a text's end, unless white
    space or the end follows the space; then the text is cut by the pattern itself.
    """

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.plain, self.spaced = Numbers(self.pieces, ""), Numbers(self.pieces, " ")

    def of(self, text: str) -> np.ndarray:
        """The numbers of the text's pieces."""
        if GAP.search(text):
            found = split(text)
            return np.fromiter(map(self.plain.__getitem__, found), np.int32, len(found))
        first, *rest = text.split(" ")
        out = np.empty(1 + len(rest), np.int32)
        out[0] = self.plain[first]
        out[1:] = np.fromiter(map(self.spaced.__getitem__, rest), np.int32, len(rest))
        return out

    def words(self) -> tuple[list[str], list[list[int]]]:
        """The distinct words that the pattern makes of the pieces, and each piece's as numbers."""
        listed: list[str] = []
        numbers = Numbers(listed, "")
        return listed, [list(map(numbers.__getitem__, split(p))) for p in self.pieces]
