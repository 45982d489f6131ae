"""Words, shingles and their 64-bit hashes, computed with numpy on whole Arrow batches.

A hash of a word is a polynomial over its bytes modulo 2^64, read off two prefix sums, then mixed; it depends on the
bytes alone. Texts are handled in blocks of about BLOCK bytes (a longer text is a block of its own), so memory is
bounded by the block, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK = 1 << 19
_BASE = 0xA0761D6478BD642F
_BASE_INV = pow(_BASE, -1, 1 << 64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2545F4914F6CDD1D, 0xA24BAED4963EE407, 0x9FB21C651E98DF25], dtype=U64)
_powers: dict[str, np.ndarray] = {}

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Everything but the six ASCII white-space characters.
NON_SPACE = ~byte_table((0x20, 0x20), (0x09, 0x0D))
#: Digits, a-z (after lower-casing) and all code points from U+0080.
ALNUM = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "inv" if inverse else "pow"
    if (have := _powers.get(key)) is None or len(have) < n:
        steps = np.full(max(n, BLOCK), _BASE_INV if inverse else _BASE, dtype=U64)
        steps[0] = 1
        _powers[key] = have = np.cumprod(steps)
    return have[:n]


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of row ranges with at most limit bytes, or one longer row. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def find_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word of a block; a row's end ends a word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = is_word[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before[edge] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span."""
    if not len(start):
        return np.zeros(0, U64)
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data)), out=total[1:])
    return mix((total[end] - total[start]) * powers(len(data) + 1, True)[start])


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every lower-cased word of a block."""
    low = LOWER[data]
    start, end, row = find_words(low, offsets, is_word)
    return span_hashes(low, start, end), row


def shingles(words: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of k words, in rows' order; a row of fewer words, but not none, gives its whole sequence."""
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    at = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :]) if len(row) >= k else np.zeros(0, np.int64)
    h = np.zeros(len(at), U64)
    for j in range(k):
        h += words[at + j] * _ODD[j]
    h, owner = mix(h), row[at]
    if len(short := np.flatnonzero((count > 0) & (count < k))):
        s = count[short].astype(U64) * U64(0xD1342543DE82EF95)
        for j in range(k - 1):
            here = count[short] > j
            s[here] += words[first[short[here]] + j] * _ODD[j]
        h, owner = np.concatenate([h, mix(s)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    return h, owner


def distinct_per_row(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row, ascending within the row. row: ascending."""
    if not len(h):
        return h, row
    h = h.copy()
    edges = [0, *(np.flatnonzero(row[1:] != row[:-1]) + 1).tolist(), len(row)]
    for a, b in zip(edges, edges[1:], strict=False):
        h[a:b].sort()
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], row[keep]


def row_bounds(row: np.ndarray, rows: int) -> np.ndarray:
    """Where each row begins in a row-sorted array, and the end."""
    return np.searchsorted(row, np.arange(rows + 1), "left")
