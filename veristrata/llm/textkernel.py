"""Vectorised text primitives over Arrow string columns.

All Python-side operators of this subpackage see text as one UTF-8 byte buffer
per block of rows.  Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``;
those separators are ASCII, so byte runs and code-point runs coincide.  Word
identity is a 64-bit hash of the bytes (A-Z lower-cased when asked).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = 1 << 20
WORDS_AT_ONCE = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64); bijective, so it adds no collisions."""
    x = x + U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BYTE = mix(np.arange(256, dtype=U64))
_MULT = U64(0x9DDFEA08EB382D69)


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _MULT, U64)
    p[0] = U64(1)
    return np.multiply.accumulate(p)


_POW = _powers(64)


def text_blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``limit`` bytes.

    A null text is empty.  One row longer than ``limit`` forms a block alone, so
    texts are never cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # pragma: no cover - zero chunks
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, offs_buf, data_buf = column.buffers()
    offs = np.frombuffer(offs_buf, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    if column.null_count:
        valid = np.asarray(column.is_valid())
        if (np.diff(offs)[~valid] != 0).any():  # bytes under a null: compact them away
            yield from text_blocks(column.fill_null(""), limit)
            return
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """Words of a block: start and end byte, row, and first word of every row."""

    __slots__ = ("starts", "ends", "row", "first", "n_rows")

    def __init__(self, buf: np.ndarray, offs: np.ndarray, sep: np.ndarray = _SEP):
        n, self.n_rows = len(buf), len(offs) - 1
        inside = ~sep[buf]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        prev = np.empty(n, bool)
        nxt = np.empty(n, bool)
        if n:
            prev[0], nxt[-1] = False, False
            prev[1:], nxt[:-1] = inside[:-1], inside[1:]
        self.starts = np.flatnonzero(inside & (~prev | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~nxt | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offs)
        self.row = np.repeat(np.arange(self.n_rows), np.diff(self.first))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def word_hashes(buf: np.ndarray, words: Words, lower: bool = True) -> np.ndarray:
    """64-bit hash of every word's bytes; some thousand words at once, so that what is worked on stays near."""
    table = _BYTE[_LOWER] if lower else _BYTE
    out = np.empty(len(words.starts), U64)
    for lo in range(0, len(out), WORDS_AT_ONCE):
        starts = words.starts[lo : lo + WORDS_AT_ONCE]
        lens = words.ends[lo : lo + WORDS_AT_ONCE] - starts
        longest = int(lens.max())
        power = _POW if longest <= len(_POW) else _powers(longest)
        begin = np.cumsum(lens) - lens
        at = np.arange(int(lens.sum()))
        v = table[buf[at + np.repeat(starts - begin, lens)]]
        at -= np.repeat(begin, lens)
        v *= power[at]
        out[lo : lo + WORDS_AT_ONCE] = mix(np.add.reduceat(v, begin) ^ (lens.astype(U64) * U64(0xD6E8FEB86659FD93)))
    return out


def crc32_of_ids(ids: np.ndarray) -> np.ndarray:
    """crc32 of each id's decimal text."""
    import zlib

    return np.fromiter((zlib.crc32(b"%d" % i) for i in ids.tolist()), np.int64, len(ids))


def string_at(buf: np.ndarray, lo: int, hi: int) -> str:
    return buf[lo:hi].tobytes().decode("utf-8", "replace")
