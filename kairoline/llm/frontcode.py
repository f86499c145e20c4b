"""Sorted runs of byte strings, front-coded, and their merge by a loser tree that knows common prefixes.

A run keeps of each string only what differs from the one before it: the length of the common prefix and the rest.
The merge keeps, for each run's next string, the length of the prefix it shares with the string last put out. Of two such
strings the one that shares more comes first, without looking at a byte; if they share as much, the comparison starts
behind that prefix. No byte of a known prefix is compared again, and the merge puts out each string's common prefix
with the one before it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

Item = tuple[bytes, bytes]  # the string, and what goes with it, of one length in all runs
_HEAD = struct.Struct("<HHH")  # common prefix, length of the rest, length of what goes with it
_LONGEST = 0xFFFF


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, of which ``start`` is known."""
    most = min(len(a), len(b))
    if a[start:most] == b[start:most]:
        return most
    at, step = start, 16
    while a[at : at + step] == b[at : at + step]:
        at += step
    differ = int.from_bytes(a[at : at + step].ljust(step, b"\0"), "big") ^ int.from_bytes(b[at : at + step].ljust(step, b"\0"), "big")
    return min(most, at + step - (differ.bit_length() + 7) // 8)


def encode(items: list[Item]) -> bytes:
    """A run of items in order; strings are shorter than 65536 bytes."""
    out, last = [], b""
    for key, own in items:
        if len(key) > _LONGEST:
            raise ValueError("a string is too long for a run")
        n = common_prefix(last, key)
        out.append(_HEAD.pack(n, len(key) - n, len(own)))
        out.append(key[n:])
        out.append(own)
        last = key
    return b"".join(out)


def decode(run: bytes) -> Iterator[tuple[bytes, int, bytes]]:
    """String, common prefix with the one before, and what goes with it."""
    at, key, end = 0, b"", len(run)
    while at < end:
        n, rest, own = _HEAD.unpack_from(run, at)
        at += _HEAD.size
        key = key[:n] + run[at : at + rest]
        at += rest
        yield key, n, run[at : at + own]
        at += own


def merge(runs: list[bytes]) -> Iterator[tuple[bytes, int, bytes]]:
    """All runs' items in order: string, common prefix with the one before, and what goes with it."""
    sources = [decode(r) for r in runs]
    n = len(sources)
    if n == 1:
        yield from sources[0]
    if n < 2:
        return
    keys: list[bytes | None] = [None] * n
    shared = [-1] * n  # with the string last put out; -1 once a run is over
    owns = [b""] * n
    left = n

    def advance(i: int) -> None:
        nonlocal left
        got = next(sources[i], None)
        if got is None:
            keys[i], shared[i] = None, -1
            left -= 1
        else:
            keys[i], shared[i], owns[i] = got

    def loses(i: int, j: int) -> bool:
        """Whether i comes after j. The later one then shares with the earlier one what its mark says."""
        a, b = shared[i], shared[j]
        if a != b:
            return a < b
        if a < 0:
            return True
        x, y = keys[i], keys[j]
        m = common_prefix(x, y, a)
        later = x[m:] > y[m:] or x == y and i > j
        shared[i if later else j] = m
        return later

    for i in range(n):
        advance(i)
        if keys[i] is not None:
            shared[i] = 0
    # losers of the inner nodes 1 .. n-1; leaf i hangs below node (n + i) // 2
    tree = [-1] * n
    winners = [*[-1] * n, *range(n)]
    for node in range(n - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        lost = loses(a, b)
        winners[node], tree[node] = (b, a) if lost else (a, b)
    best = winners[1]
    while left:
        yield keys[best], shared[best], owns[best]
        advance(best)
        node = (n + best) // 2
        while node:
            if loses(best, tree[node]):
                best, tree[node] = tree[node], best
            node //= 2
