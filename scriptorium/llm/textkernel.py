"""Vectorised UTF-8 kernels shared by the corpus operators.

Everything works on the raw value buffer of an Arrow string column, so the
cost is a few numpy passes over the bytes and no Python object per word.

A *word* is a maximal run of ASCII letters, ASCII digits, underscores and
non-ASCII bytes. ASCII and Latin-1 capitals count as their lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_WORD = np.zeros(256, dtype=bool)
for _r in (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789_", bytes(range(128, 256))):
    _WORD[list(_r)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C55
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]

#: Bytes of text that one numpy pass takes; a longer text is one pass by itself.
PASS_BYTES = 1 << 20


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, PASS_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every output bit depends on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; a null is an empty text."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32, count=len(column) + column.offset + 1)
    off = off[column.offset :].astype(np.int64)
    values = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return values[off[0] : off[-1]], off - off[0]


def passes(column: pa.Array, limit: int = PASS_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of rows: first row, row past the last, bytes, offsets."""
    data, off = utf8(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters, byte for byte."""
    low = _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    if len(lead):
        tail = low[lead]
        up = (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)
        low[lead[up]] = tail[up] + 0x20
    return low


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word; none crosses a text's border."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    inside = _WORD[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = offsets[:-1]
    before[cut[cut < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by prefix sums of a polynomial modulo 2**64."""
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _power_tables(len(low) + 1)
    total = np.empty(len(low) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


class Words:
    """The words of one pass: spans, hashes, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.low = fold(data)
        self.starts, self.ends = word_spans(data, offsets)
        self.hashes = span_hashes(self.low, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def next_in_text(self) -> np.ndarray:
        """Whether the word at i and the one at i + 1 stand in the same text."""
        same = np.ones(max(0, len(self.starts) - 1), dtype=bool)
        inner = self.first[1:-1]
        same[inner[(inner > 0) & (inner < len(self.starts))] - 1] = False
        return same


class HashTable:
    """Static map from distinct 64-bit keys to their row; probing is vectorised."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.asarray(keys, dtype=np.uint64)
        bits = max(4, int(len(self.keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        left = np.arange(len(self.keys))
        at = (self.keys >> self.shift).astype(np.int64)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is absent."""
        out = np.full(len(keys), -1, dtype=np.int32)
        if not len(self.keys):
            return out
        at = (keys >> self.shift).astype(np.int64)
        row = self.slots[at]
        hit = row >= 0
        good = hit & (self.keys[row] == keys)
        out[good] = row[good]
        left = np.flatnonzero(hit & ~good)
        at = at[left]
        for _ in range(self.probes - 1):
            if not len(left):
                break
            at = (at + 1) & (len(self.slots) - 1)
            row = self.slots[at]
            good = (row >= 0) & (self.keys[row] == keys[left])
            out[left[good]] = row[good]
            more = (row >= 0) & ~good
            left, at = left[more], at[more]
        return out
