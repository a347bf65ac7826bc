"""Words of Arrow string columns, found and hashed with array operations.

A column's UTF-8 bytes are walked in pieces of STEP bytes, so that memory does not follow a text's length: some 40 times
as much for a piece, and 16 times for tables that stay with the worker.
Pieces end at a row's end or at a byte that belongs to no word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

STEP = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def members(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Which of the 256 bytes lie in one of the ranges (ends included)."""
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Digits, a-z and all that is not ASCII.
ALNUM = members([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
#: All but the ASCII white space.
NOT_SPACE = ~members([(0x20, 0x20), (0x09, 0x0D)])
#: a-z and all that is not ASCII.
LETTERS = members([(0x61, 0x7A), (0x80, 0xFF)])


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_cache: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > STEP + 1:
        return _powers(_BASE, n), _powers(_BASE_INVERSE, n)
    if "up" not in _cache:
        _cache["up"], _cache["down"] = _powers(_BASE, STEP + 1), _powers(_BASE_INVERSE, STEP + 1)
    return _cache["up"], _cache["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its rows' offsets in them; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def _cut(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, pos: int, end: int) -> int:
    target = pos + STEP
    if target >= end:
        return end
    row_end = offsets[np.searchsorted(offsets, target, "right") - 1]
    if row_end > pos:
        return int(row_end)
    gaps = np.flatnonzero(~member[LOWER[data[pos:target]]])
    if len(gaps):
        return int(pos + gaps[-1] + 1)
    row_end = int(offsets[np.searchsorted(offsets, target, "right")])
    while target < row_end:
        gaps = np.flatnonzero(~member[LOWER[data[target : min(target + STEP, row_end)]]])
        if len(gaps):
            return int(target + gaps[0] + 1)
        target += STEP
    return row_end


def hash_words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, spans: bool = False, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """64-bit hashes of all words with A-Z lower-cased, and each row's number of words.

    With spans, also where each word begins in data, and its length in bytes. With prefixes, then the hashes of so many
    first bytes of each word, an array for each; a shorter word's is its own.
    """
    pos, end = int(offsets[0]), int(offsets[-1])
    heads: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in prefixes]
    hashes, begins, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while pos < end:
        stop = _cut(data, offsets, member, pos, end)
        low = LOWER[data[pos:stop]]
        inside = member[low]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        rows = offsets[np.searchsorted(offsets, pos, "right") : np.searchsorted(offsets, stop, "left")] - pos
        first[rows] = inside[rows]
        last[rows - 1] = inside[rows - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _tables(len(low) + 1)
        sums = np.zeros(len(low) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * down[s]))
        for out, size in zip(heads, prefixes, strict=True):
            out.append(mix((sums[np.minimum(e, s + size)] - sums[s]) * down[s]))
        begins.append(s + pos)
        lengths.append(e - s)
        pos = stop
    begin = np.concatenate(begins)
    counts = np.diff(np.searchsorted(begin, offsets))
    out = (np.concatenate(hashes), counts)
    if spans:
        out = (*out, begin, np.concatenate(lengths))
    return (*out, *(np.concatenate(h) for h in heads))


def row_blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes together; a longer row is alone."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)
