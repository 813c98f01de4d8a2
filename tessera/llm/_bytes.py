"""Vectorised helpers over the UTF-8 bytes of an Arrow string column.

Every helper works on one slice of rows at a time and keeps no state, so the
Spark tasks that call it stay bounded by ``MAX_BYTES`` plus one document.
Nulls are read as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once; a single longer document is handled alone.
MAX_BYTES = 1 << 18

#: Fixed odd base of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

#: The white space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def lookup(members: bytes) -> np.ndarray:
    """A 256-entry table that is true at the given bytes."""
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


IS_SPACE = lookup(SPACES)

#: A-Z to a-z, other bytes unchanged.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
#: One fixed random value for each byte: the alphabet of the polynomial hash.
ALPHABET = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Odd multipliers that combine the words of an n-gram.
MULTIPLIERS = _rng.integers(1, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def slices(column: pa.Array | pa.ChunkedArray, most: int = MAX_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, one past the last row, bytes, row offsets into these bytes)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, at, body = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64, count=n + 1, offset=column.offset * 8)
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last, 0), first + 60_000)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that are no separators and stay in one row: (start, end, row)."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none
    inside = ~separators[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1]
    before[edges[edges < len(data)]] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    edges = offsets[1:] - 1
    after[edges[edges >= 0]] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64; kept while they are short."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, MAX_BYTES + 1)
        up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 8 * MAX_BYTES:
            return up, down
        _powers.update(up=up, down=down)
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums: entry i covers the first i bytes."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(ALPHABET[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal ranges of bytes have equal hashes."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def ngram_hash(words: np.ndarray, row: np.ndarray, n: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words in a row, and their rows.

    A row with fewer words, but not none, has its whole sequence as one n-gram.
    """
    count = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    if len(words) >= n:
        whole = row[: len(row) - n + 1] == row[n - 1 :]
        total = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            total += words[k : len(words) - n + 1 + k] * MULTIPLIERS[k]
        grams, owner = mix(total[whole]), row[: len(row) - n + 1][whole]
    else:
        grams, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        total = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            total[has] += words[first[short[has]] + k] * MULTIPLIERS[k]
        grams = np.concatenate((grams, mix(total + count[short].astype(np.uint64))))
        owner = np.concatenate((owner, short))
    return grams, owner


def by_row(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row in ascending order, and row offsets into them."""
    order = np.argsort(values)
    values, row = values[order], row[order].astype(np.uint16)
    order = np.argsort(row, kind="stable")
    values, row = values[order], row[order]
    if len(values):
        new = np.empty(len(values), bool)
        new[0] = True
        new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
        values, row = values[new], row[new]
    return values, np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows))))
