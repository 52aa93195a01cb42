"""Words of whole texts as flat numpy arrays, straight from Arrow string buffers.

A word is a maximal run of word bytes; all bytes of non-ASCII characters are word bytes, so cutting UTF-8 bytes
is the same as cutting characters. A word's hash is a 64-bit polynomial of its bytes, equal on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C55)  # odd, so that powers can be divided out again
INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
SLICE_BYTES = 1 << 20

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def spaced() -> np.ndarray:
    """Word bytes of [^\\x20\\x09-\\x0D]+."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def alphanumeric() -> np.ndarray:
    """Word bytes of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ once A-Z are lower-cased."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


class Words(NamedTuple):
    hashes: np.ndarray  # uint64 per word
    doc: np.ndarray     # int64 per word: row in the slice
    first: np.ndarray   # int64 per row: its first word
    count: np.ndarray   # int64 per row


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about so many text bytes; a longer text stands alone."""
    ends = _offsets(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + size, side="right")) - 1)
        yield lo, min(hi, len(texts))
        lo = hi


def words(texts: pa.Array, table: np.ndarray) -> Words:
    """Hashes of the A-Z-lower-cased words of every text; null is an empty text."""
    ends = _offsets(texts)
    n = len(texts)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]] if n and ends[-1] > ends[0] else np.empty(0, np.uint8)
    starts = ends[:-1] - ends[0]
    size = np.diff(ends)
    inside = table[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[starts] = True
    edge[-1] = True
    left = inside.copy()
    left[1:] &= ~inside[:-1] | edge[1:-1]
    right = inside.copy()
    right[:-1] &= ~inside[1:] | edge[1:-1]
    begin, end = np.flatnonzero(left), np.flatnonzero(right) + 1
    lower = raw.astype(np.uint64)
    lower[(raw >= 65) & (raw <= 90)] += np.uint64(32)
    up, down = _power("up", BASE, len(raw) + 1), _power("down", INVERSE, len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((lower + np.uint64(1)) * up[:len(raw)], out=total[1:])
        hashes = mix((total[end] - total[begin]) * down[begin])
    row = np.searchsorted(starts + size, begin, side="right")
    count = np.bincount(row, minlength=n).astype(np.int64)
    return Words(hashes, row.astype(np.int64), np.cumsum(count) - count, count)


def hash_words(items: list[str]) -> np.ndarray:
    """Hashes of single words, as words() gives them."""
    return words(pa.array(items, pa.string()), np.ones(256, bool)).hashes if items else np.empty(0, np.uint64)


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every n-word shingle; a row of fewer words, if it has any, is one shingle."""
    step = np.uint64(0x2545F4914F6CDD1D)
    total = max(len(w.hashes) - n + 1, 0)
    with np.errstate(over="ignore"):
        acc = np.zeros(total, np.uint64)
        for k in range(n):
            acc = acc * step + w.hashes[k:k + total]
        full = np.flatnonzero(w.doc[:total] == w.doc[n - 1:]) if total else np.empty(0, np.int64)
        short = np.flatnonzero((w.count > 0) & (w.count < n))
        rest = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = w.count[short] > k
            rest[has] = rest[has] * step + w.hashes[w.first[short][has] + k]
        return mix(np.concatenate([acc[full], rest + np.uint64(n)])), np.concatenate([w.doc[full], short])


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers[name]
    if len(have) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, 2 * SLICE_BYTES), base, np.uint64)
            steps[0] = 1
            have = _powers[name] = np.cumprod(steps)
    return have
