"""Elias-Fano lists: growing sequences of numbers in about 2 + log2(range / count) bits each, with access to any one.

A number's low bits are stored as they are, its high part as the distance to the one before, in unary.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np

_HEAD = struct.Struct("<qB")
_LOT = 4096


def encode(parts: Iterable[np.ndarray], count: int, last: int) -> bytes:
    """``count`` numbers from 0 to ``last`` that never fall, given in parts."""
    low = max(0, (last // count).bit_length() - 1) if count else 0
    upper = np.zeros((last >> low) + count + 1 if count else 0, bool)
    lows = np.zeros(count * low, bool)
    at = 0
    for part in parts:
        values = part.astype(np.int64)
        here = np.arange(at, at + len(values))
        upper[(values >> low) + here] = True
        for k in range(low):
            lows[here * low + k] = values >> k & 1
        at += len(values)
    if at != count:
        raise ValueError(f"{at} numbers, not {count}")
    return _HEAD.pack(count, low) + np.packbits(lows, bitorder="little").tobytes() + np.packbits(upper, bitorder="little").tobytes()


def count(code: bytes) -> int:
    return _HEAD.unpack_from(code)[0]


def select(code: bytes, indices: Iterable[int]) -> list[int]:
    """The numbers at the indices, from 0."""
    n, low = _HEAD.unpack_from(code)
    start = _HEAD.size
    packed = (n * low + 7) // 8
    lows = np.frombuffer(code, np.uint8, packed, start)
    upper = np.frombuffer(code, np.uint8, -1, start + packed)
    # ones before each lot of bytes, then before each byte of the lot
    lots = np.add.reduceat(np.bitwise_count(upper), np.arange(0, len(upper), _LOT), dtype=np.int64) if len(upper) else np.zeros(0, np.int64)
    upto = np.cumsum(lots)
    out = []
    for i in indices:
        if not 0 <= i < n:
            raise IndexError(i)
        lot = int(np.searchsorted(upto, i, "right"))
        left = i - (int(upto[lot - 1]) if lot else 0)
        own = upper[lot * _LOT : (lot + 1) * _LOT]
        within = np.cumsum(np.bitwise_count(own), dtype=np.int64)
        byte = int(np.searchsorted(within, left, "right"))
        left -= int(within[byte - 1]) if byte else 0
        bit = int(np.flatnonzero(np.unpackbits(own[byte : byte + 1], bitorder="little"))[left])
        value = (lot * _LOT + byte) * 8 + bit - i << low
        for k in range(low):
            at = i * low + k
            value |= (int(lows[at >> 3]) >> (at & 7) & 1) << k
        out.append(value)
    return out
