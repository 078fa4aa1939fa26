"""Draws of a bootstrap by hash, worked out in blocks inside tasks: no row stands for a draw.

A draw is the first 32 bits of the MD5 of "resample:slot", modulo the number of units.
Slots that differ in their last four digits only share all of a message but one or two
words, so numpy hashes ten thousand of them together.  What leaves a task is how often
each unit of a chunk was drawn, one byte a unit, compressed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

#: Units of a chunk, slots of a block, and slots that differ in their last digits only.
CHUNK, BLOCK, DIGITS = 1 << 16, 1 << 24, 4
_SHIFT = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINE = [int(abs(np.sin(np.float64(i + 1))) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MASK = 0xFFFFFFFF


def _tables() -> list[np.ndarray]:
    """The last k digits of all numbers that have k of them, leading zeros included, as bytes (place x number)."""
    out = []
    for k in range(1, DIGITS + 1):
        n = np.arange(10**k)
        out.append(np.stack([n // 10 ** (k - 1 - i) % 10 + 48 for i in range(k)]).astype(np.uint32))
    return out


TABLES = _tables()


def md5_heads(prefix: bytes, digits: np.ndarray) -> np.ndarray:
    """First 32 bits (big-endian) of the MD5 of ``prefix`` and each column of ``digits``; 55 bytes at most."""
    places, count = digits.shape
    size = len(prefix) + places
    fixed = bytearray(64)
    fixed[: len(prefix)] = prefix
    fixed[size] = 0x80
    fixed[56:64] = (8 * size).to_bytes(8, "little")
    words: list = np.frombuffer(bytes(fixed), "<u4").tolist()
    for i in range(places):
        at = len(prefix) + i
        part = digits[i] << np.uint32(8 * (at % 4))
        words[at // 4] = part | np.uint32(words[at // 4]) if isinstance(words[at // 4], int) else words[at // 4] | part
    a, b, c, d = (np.full(count, x, np.uint32) for x in _START)
    t = np.empty(count, np.uint32)
    for i in range(61):  # the last three steps leave the first word as it is
        f = np.empty(count, np.uint32) if i == 0 else spare
        turn, k = divmod(i, 16)
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            k = (5 * i + 1) % 16
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            k = (3 * i + 5) % 16
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
            k = 7 * i % 16
        f += a
        word = words[k]
        if isinstance(word, int):
            f += np.uint32((word + _SINE[i]) & _MASK)
        else:
            f += word
            f += np.uint32(_SINE[i])
        s = _SHIFT[turn][i % 4]
        np.right_shift(f, np.uint32(32 - s), out=t)
        f <<= np.uint32(s)
        f |= t
        f += b
        spare = a
        a, d, c, b = d, c, b, f
    return (b + np.uint32(_START[0])).byteswap()


def heads(resample: int, first: int, last: int) -> Iterator[np.ndarray]:
    """The hashes of the slots from ``first`` to ``last`` (both included, from 1) of a resample, in pieces."""
    whole = 10**DIGITS
    at = first
    while at <= last:
        if at < whole:  # numbers of one length at a time
            k = len(str(at))
            low, high, prefix, table = 0, 10**k - 1, f"{resample}:", TABLES[k - 1]
        else:
            low = at // whole * whole
            high, prefix, table = low + whole - 1, f"{resample}:{at // whole}", TABLES[-1]
        stop = min(high, last)
        yield md5_heads(prefix.encode(), table[:, at - low : stop + 1 - low])
        at = stop + 1


def drawn(resample: int, first: int, last: int, units: int) -> Iterator[tuple[int, bytes]]:
    """(chunk, how often each of its units was drawn) over the slots of a block."""
    at = np.concatenate(list(heads(resample, first, last)))
    if units <= _MASK:
        at %= np.uint32(units)
    at.sort()
    chunks = at >> np.uint32(16)
    cut = np.r_[0, np.flatnonzero(np.diff(chunks)) + 1, len(at)].tolist()
    for lo, hi in zip(cut, cut[1:], strict=False):
        n = np.bincount(at[lo:hi] & np.uint32(CHUNK - 1))
        n = n.astype(np.uint8) if n.max() < 256 else n.astype(np.uint32)
        yield int(chunks[lo]), bytes([n.itemsize]) + zlib.compress(n.tobytes(), 1)


def counts(packed: bytes) -> np.ndarray:
    """How often each unit of a chunk was drawn, from drawn(); units after the last one drawn are left out."""
    return np.frombuffer(zlib.decompress(packed[1:]), np.uint8 if packed[0] == 1 else np.uint32)
