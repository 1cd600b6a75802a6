"""Hashes of words and shingles of many texts at once, in numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` over UTF-8 bytes. A hash is a polynomial over random 64-bit letters, so that every word's
comes out of one running sum; hashes are 64 bits wide and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_FOLDED = _LETTERS.copy()
_FOLDED[65:91] = _LETTERS[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Bytes that are hashed at once.
BLOCK = 1 << 19
_SHINGLE = [U(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK + 1), base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 4 * BLOCK:
            _powers[base] = have
    return have[:n]


def inverse_powers(n: int) -> np.ndarray:
    return powers(n, _INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


def running_sum(data: np.ndarray, fold: bool) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_FOLDED if fold else _LETTERS)[data] * powers(len(data), _BASE), out=out[1:], dtype=np.uint64)
    return out


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of each window of so many bytes, by its start."""
    if len(data) < length:
        return np.zeros(0, dtype=np.uint64)
    s = running_sum(data, False)
    return mix((s[length:] - s[:-length]) * powers(len(data) - length + 1, _INVERSE))


def _words(data: np.ndarray, starts_of_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, its start); a document's start ends the word before it."""
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    space = _SPACE[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = starts_of_docs[(starts_of_docs > 0) & (starts_of_docs < len(data))]
    before[inner] = True
    after[inner - 1] = True
    solid = ~space
    starts, ends = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    s = running_sum(data, True)
    return mix((s[ends] - s[starts]) * powers(len(data), _INVERSE)[starts]), starts


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces of about BLOCK bytes, cut at white space."""
    at = 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data):
            gap = np.flatnonzero(_SPACE[data[end : end + 65536]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(data), end + 65536)
        yield data[at:end]
        at = end


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """From a binary column: (first row, hashes of the words of some rows, bounds of each row's words)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1)
        j = min(j, n)
        part = data[offsets[i] : offsets[j]]
        if j == i + 1 and len(part) > 2 * BLOCK:
            h = np.concatenate([_words(p, np.zeros(0, np.int64))[0] for p in _pieces(part)])
            yield i, h, np.array([0, len(h)])
        else:
            at = offsets[i : j + 1] - offsets[i]
            h, starts = _words(part, at[:-1])
            yield i, h, np.searchsorted(starts, at)
        i = j


def shingles(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of each row's shingles, repeats included; a row of fewer words has one of all its words."""
    n, counts = len(words), np.diff(bounds)
    short = (counts > 0) & (counts < size)
    full = np.zeros(max(0, n - size + 1), dtype=np.uint64)
    for k in range(size if len(full) else 0):
        full += words[k : k + len(full)] * _SHINGLE[k]
    full = mix(full)
    per_row = np.where(short, 1, np.maximum(0, counts - size + 1))
    out_bounds = np.concatenate([[0], np.cumsum(per_row)])
    row = np.repeat(np.arange(len(counts)), per_row)
    at = np.arange(out_bounds[-1]) - out_bounds[:-1][row] + bounds[:-1][row]
    if not short.any():
        return full[at], out_bounds
    out = np.zeros(len(at), dtype=np.uint64)
    is_short = short[row]
    out[~is_short] = full[at[~is_short]]
    for r in np.flatnonzero(short):
        h = U(int(counts[r]))
        for k, w in enumerate(words[bounds[r] : bounds[r + 1]]):
            h = U((int(h) + int(w) * int(_SHINGLE[k])) & 0xFFFFFFFFFFFFFFFF)
        out[out_bounds[r]] = mix(np.array([h ^ U(0x5851F42D4C957F2D)], dtype=np.uint64))[0]
    return out, out_bounds
