"""Covering codes of 64 bits, for Hamming similarity joins by anchor points.

A code is put together from perfect codes over blocks of bits: two binary Golay codes of 23 bits (covering radius 3) and
two repetition codes of 9 bits (radius 4). In each block every word has exactly one code word within the radius, its home.
The whole code has 2**26 anchors and covering radius 14.

If x and y differ in at most t bits, the home of x lies within the radius of x, block by block, and in each block at
most the differing bits farther from y. So y meets x at an anchor whose blocks exceed their radii by no more than t bits
together: it is enough to replicate y to those, about 70 anchors for t = 2, and to compare them with the words at home there.

Anchors of a word are those whose difference from it has the same syndrome, so all difference patterns are tabled by
syndrome once, from the codes' parity checks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np

# Fixed value: the generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101


@dataclass(frozen=True)
class Block:
    """Difference patterns of a perfect code by syndrome, those of the least weight first."""

    width: int
    syndromes: np.ndarray  # of each value of the low and the high half of the block
    first: np.ndarray  # of each syndrome's patterns
    upto: np.ndarray  # for each syndrome and excess, how many patterns exceed the radius by no more
    patterns: np.ndarray
    excess: np.ndarray

    @property
    def half(self) -> int:
        return (self.width + 1) // 2

    def syndrome(self, value: np.ndarray) -> np.ndarray:
        return self.syndromes[0][value & ((1 << self.half) - 1)] ^ self.syndromes[1][value >> self.half]


def _block(columns: list[int], checks: int, radius: int, beyond: int) -> Block:
    """columns: each bit's syndrome, of ``checks`` bits."""
    width = len(columns)
    half = (width + 1) // 2
    halves = np.zeros((2, 1 << half), np.int64)
    for k in range(2):
        for i, c in enumerate(columns[k * half : (k + 1) * half]):
            halves[k, 1 << i : 2 << i] = halves[k, : 1 << i] ^ c
    found = [(0, 0, 0)]
    for weight in range(1, min(width, radius + beyond) + 1):
        for bits in combinations(range(width), weight):
            pattern = syndrome = 0
            for i in bits:
                pattern |= 1 << i
                syndrome ^= columns[i]
            found.append((syndrome, max(0, weight - radius), pattern))
    found.sort()
    syndrome, excess, pattern = (np.array(x, np.int64) for x in zip(*found, strict=True))
    first = np.searchsorted(syndrome, np.arange(1 << checks))
    upto = np.stack([np.bincount(syndrome[excess <= e], minlength=1 << checks) for e in range(beyond + 1)], axis=1)
    return Block(width, halves, first, upto, pattern.astype(np.uint64), excess)


def golay(beyond: int) -> Block:
    columns, x = [], 1
    for _ in range(23):
        columns.append(x)
        x <<= 1
        if x >> 11:
            x ^= GOLAY
    return _block(columns, 11, 3, beyond)


def repetition(width: int, beyond: int) -> Block:
    """width: odd."""
    return _block([*(1 << i for i in range(width - 1)), (1 << (width - 1)) - 1], width - 1, width // 2, beyond)


@cache
def blocks(beyond: int) -> tuple[Block, ...]:
    g, r = golay(beyond), repetition(9, beyond)
    return g, g, r, r


def anchors(words: np.ndarray, beyond: int) -> tuple[np.ndarray, np.ndarray]:
    """For uint64 words: the index of a word and an anchor, for each anchor that exceeds the blocks' radii by at
    most ``beyond`` bits; 0 gives each word's home."""
    index = np.arange(len(words))
    anchor, left, at = words.copy(), np.full(len(words), beyond), 0
    for block in blocks(beyond):
        value = (words[index] >> np.uint64(at)) & np.uint64((1 << block.width) - 1)
        syndrome = block.syndrome(value.astype(np.int64))
        n = block.upto[syndrome, left]
        where = np.repeat(block.first[syndrome] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        anchor = np.repeat(anchor, n) ^ (block.patterns[where] << np.uint64(at))
        left = np.repeat(left, n) - block.excess[where]
        index = np.repeat(index, n)
        at += block.width
    return index, anchor
