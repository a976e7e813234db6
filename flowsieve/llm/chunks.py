"""Cuts texts into chunks that a byte-level BPE encodes independently, and remembers their encodings.

The pre-token pattern never lets a token run over a space that follows a character other than white space or
that precedes one, so a text can be cut before each such space. Most chunks are words with a leading space,
which recur, so each worker keeps a bounded table from chunk to encoding. Whole texts are cut with
str.split; only texts with longer white space take a regular expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

_LONG_SPACE = re.compile(r"\s (?:\s|$)|^ \s| $")
_SPACE_AFTER = re.compile(r" (?:\s|$)")
_CUT = re.compile(r"(?<!\s)(?= )|(?= \S)")


def long_space(text: str) -> bool:
    """Whether a text has white space that can't be cut before each space."""
    return bool(_SPACE_AFTER.search(text) and _LONG_SPACE.search(text))


def chunks(text: str) -> list[str]:
    """The chunks of a text; joined they give the text."""
    if long_space(text):
        return [c for c in _CUT.split(text) if c]
    first, *rest = text.split(" ")
    rest = [" " + c for c in rest]
    return [first, *rest] if first else rest


class Memory:
    """Encodings of chunks. `encode` gets distinct chunks and returns one value for each.

    Chunks with a leading space are kept under the rest of them, which str.split gives without a copy; others have a
    table of their own. A table that is full is emptied. `limit` bounds the chunks and `longest` the length of one, so
    a table has at most some 80 MB; a task that is done calls `clear`.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable], limit: int = 200_000, longest: int = 64):
        self.encode, self.limit, self.longest = encode, limit, longest
        self.after_space: dict[str, object] = {}
        self.other: dict[str, object] = {}

    def clear(self) -> None:
        self.after_space.clear()
        self.other.clear()

    def _learn(self, table: dict, wanted: set[str], lead: str) -> dict:
        """A table that holds all wanted chunks; long ones are only in the returned one."""
        new = list(wanted.difference(table))
        if not new:
            return table
        found = dict(zip(new, self.encode([lead + c for c in new])))
        if len(table) + len(found) > self.limit:
            kept = {c: table[c] for c in wanted if c in table}
            table.clear()
            table.update(kept)
        long = [c for c in new if len(c) > self.longest]
        if not long:
            table.update(found)
            return table
        table.update((c, v) for c, v in found.items() if len(c) <= self.longest)
        return {c: table[c] if c in table else found[c] for c in wanted}

    def values(self, texts: list[str]) -> list[list]:
        """For every text the values of its chunks."""
        plain, odd = [], []
        for text in texts:
            if _SPACE_AFTER.search(text) and _LONG_SPACE.search(text):
                plain.append(())
                odd.append([c for c in _CUT.split(text) if c])
            else:
                pieces = text.split(" ")
                odd.append([pieces[0]] if pieces[0] else [])
                plain.append(pieces)
        after = self._learn(self.after_space, set().union(*[p[1:] for p in plain]), " ").__getitem__
        other = self._learn(self.other, set().union(*odd), "").__getitem__
        return [[*map(other, o), *map(after, p[1:])] for p, o in zip(plain, odd)]
