"""Hashes of word windows, many texts at a time in numpy.

Texts are cut into pieces of bounded length that overlap by a window less one word, so that any window lies in exactly
one piece. The pieces of a chunk stand one after the other, their words parted by single spaces; a window's hash is
that of its bytes, taken from prefix sums of a polynomial modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from millrace.llm.simhash import word_pieces

CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


@dataclass
class Chunk:
    """Pieces of texts. text, number: of each piece, its text and the number of its first word there; the rest per word."""

    data: np.ndarray
    text: np.ndarray
    number: np.ndarray
    piece: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def hashes(self, width: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each window of ``width`` words; with ``whole`` also of texts that are shorter, as one window each."""
        n = len(self.start)
        first = np.arange(max(0, n - width + 1))
        first = first[self.piece[first] == self.piece[first + width - 1]]
        last = first + width - 1
        if whole:
            count = np.bincount(self.piece, minlength=len(self.text))
            begin = np.cumsum(count) - count
            short = np.flatnonzero((count < width) & (self.number == 0))
            first, last = np.concatenate([first, begin[short]]), np.concatenate([last, begin[short] + count[short] - 1])
        size = 1 << max(20, int(len(self.data)).bit_length())
        power, inverse = _powers(size)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)], out=sums[1:])
        h = (sums[self.end[last]] - sums[self.start[first]]) * inverse[self.start[first]]
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        return first, h


def chunks(texts: Iterable[bytes], overlap: int) -> Iterator[Chunk]:
    """The texts in chunks, in order; a text's later pieces repeat the last ``overlap`` words of the one before."""
    held: list[bytes] = []
    text: list[int] = []
    number: list[int] = []
    count: list[int] = []
    size = 0

    def made() -> Chunk:
        data = np.frombuffer(b"\n".join(held), np.uint8)
        cut = np.flatnonzero((data == 32) | (data == 10))
        return Chunk(
            data, np.array(text), np.array(number), np.repeat(np.arange(len(held)), count),
            np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(data)]]),
        )

    def hold(i: int, at: int, words: list[bytes]) -> None:
        nonlocal size
        held.append(b" ".join(words))
        text.append(i)
        number.append(at)
        count.append(len(words))
        size += len(held[-1])

    for i, data in enumerate(texts):
        at, short = 0, []
        for words in word_pieces(data, overlap, CHUNK):
            if len(words) <= overlap:  # no word beyond the carried ones, or too few so far: the next piece repeats them all
                short = words if not at else []
                continue
            hold(i, at, words)
            at, short = at + len(words) - overlap, []
            if size >= CHUNK:
                yield made()
                held, text, number, count, size = [], [], [], [], 0
        if short:
            hold(i, at, short)
            if size >= CHUNK:
                yield made()
                held, text, number, count, size = [], [], [], [], 0
    if held:
        yield made()
