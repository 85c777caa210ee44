"""Words and word n-grams of whole Arrow text columns as 64-bit numbers, without a Python object for each word.

Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, over UTF-8 bytes. Words that nobody built for it get the same number
with a chance of 1 in 2^64 a pair; long words can be built so (a polynomial modulo 2^64), and would count as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h = h * U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_letters = mix(np.arange(1, 257, dtype=U) * ODD)[_lower]
_blank = np.zeros(256, bool)
_blank[[0x20, *range(0x09, 0x0E)]] = True
_base = U(0xD1342543DE82EF95)
_inverse = U(pow(int(_base), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = 1 << max(20, int(n).bit_length())
        for name, base in (("up", _base), ("down", _inverse)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def slices(column: pa.Array, most_bytes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about so many bytes, one row at least. Nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most_bytes, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word, row of each word)."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    inside = ~_blank[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, U)
    np.cumsum(_letters[data] * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), np.searchsorted(offsets, starts, "right") - 1


def shingles(word: np.ndarray, row: np.ndarray, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, row) of the distinct shingles of so many words, sorted by row and number; fewer words: all of them as one."""
    counts = np.bincount(row, minlength=rows)
    firsts = np.cumsum(counts) - counts
    g = np.full(max(0, len(word) - size + 1), size, U)
    for k in range(size):
        g = mix(g * ODD + word[k : len(word) - size + 1 + k])
    whole = row[: len(g)] == row[size - 1 :] if len(g) else np.zeros(0, bool)
    numbers, owners = [g[whole]], [row[: len(g)][whole]]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        h = np.full(len(short), n, U)
        for k in range(n):
            h = mix(h * ODD + word[firsts[short] + k])
        numbers.append(h)
        owners.append(short)
    g, owner = np.concatenate(numbers), np.concatenate(owners)
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    return g[new], owner[new]
