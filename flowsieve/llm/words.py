"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word is a run of bytes without the six ASCII space characters, so UTF-8 needs no decoding. A word's
hash is a polynomial over random byte values modulo 2^64, taken from running sums, then mixed. Two
different words or shingles get one hash with a probability of about 2^-64.
"""

from __future__ import annotations

import numpy as np

from flowsieve.llm.common import SPACE_BYTES, worker_memory

PIECE = 1 << 19
_RNG = np.random.default_rng(20260801)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_LOWER = _BYTE.copy()
_LOWER[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_BASE = int(_RNG.integers(0, 1 << 63)) | 1
_STEP = _RNG.integers(0, 1 << 64, 16, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits; a bijection of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    kept = worker_memory()
    if "powers" not in kept or len(kept["powers"][0]) < n:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(max(n, PIECE + (1 << 16)), base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        kept["powers"] = made
    return kept["powers"]


class Words:
    """The words of a list of texts (bytes): hash, text number, and per text the range of its words."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        self.raw = np.frombuffer(joined, np.uint8)
        self.space = _SPACE[self.raw]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.bounds = np.concatenate(([0], np.cumsum(sizes + 1)))
        # a word starts after a space and ends before one; the last byte of all is a space
        edge = np.flatnonzero(self.space[1:] != self.space[:-1]) + 1
        if len(edge) and self.space[edge[0]]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.hash = self._hashes(_LOWER if lower else _BYTE)
        self.first = np.searchsorted(self.starts, self.bounds)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def _hashes(self, values: np.ndarray) -> np.ndarray:
        """Word hashes, piece by piece, so that eight bytes per text byte exist for one piece only."""
        out = np.empty(len(self.starts), np.uint64)
        low = 0
        while low < len(self.starts):
            begin = int(self.starts[low])
            high = max(low + 1, int(np.searchsorted(self.ends, begin + PIECE, "right")))
            stop = int(self.ends[high - 1])
            power, inverse = _powers(stop - begin)
            run = np.empty(stop - begin + 1, np.uint64)
            run[0] = 0
            np.cumsum(values[self.raw[begin:stop]] * power[:stop - begin], out=run[1:])
            s, e = self.starts[low:high] - begin, self.ends[low:high] - begin
            out[low:high] = (run[e] - run[s]) * inverse[s] + (e - s).astype(np.uint64)
            low = high
        return mixed(out)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, number of its first word) of every n words in a row within one text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        total = np.zeros(m, np.uint64)
        for i in range(n):
            total += self.hash[i:i + m] * _STEP[i]
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1:])
        return mixed(total[at]), at

    def sequence(self, i: int) -> np.uint64:
        """Hash of all words of a text in order."""
        own = self.hash[self.first[i]:self.first[i + 1]]
        power = np.multiply.accumulate(np.full(len(own), _STEP[-1], np.uint64))
        return mixed(np.array([(own * power).sum(dtype=np.uint64) ^ _STEP[-2]], np.uint64))[0]

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """Number of marked bytes of every text."""
        run = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return run[self.bounds[1:] - 1] - run[self.bounds[:-1]]

    def per_text_words(self, mask: np.ndarray) -> np.ndarray:
        """Number of marked words of every text."""
        return np.bincount(self.doc[mask], minlength=len(self.count)).astype(np.int64)


def encoded(texts) -> list[bytes]:
    """UTF-8 of every text; a null text is empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
