"""Vectorised words and word hashes over the UTF-8 buffers of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts are hashed in slices of about this many bytes; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C17)  # odd, and base - 1 is 2 mod 4
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C17, -1, 2**64))
_STEP = _rng.integers(1, 2**63, 64, dtype=U64) * U64(2) + U64(1)
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(is_word) -> np.ndarray:
    return np.array([bool(is_word(b)) for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser (two xor-shift-multiply rounds)."""
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(29))) * U64(0xA0761D6478BD642F)
    return h ^ (h >> U64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        made = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(n, base, U64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if n > 4 * SLICE_BYTES:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def text_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; nulls are empty texts."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32) if len(column) else np.zeros(1, np.int32)
    offsets = raw[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2] if len(column) else None
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Words:
    """The words of a slice of texts: byte ranges, owning text, 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, lower: bool = True):
        self.data, self.texts = LOWER[data] if lower else data, len(offsets) - 1
        inside = word_bytes[self.data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        filled = offsets[:-1] < offsets[1:]
        before[offsets[:-1][filled]] = False
        after[offsets[1:][filled] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.text, minlength=self.texts).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count)))

    def hashes(self) -> np.ndarray:
        """Word hashes, window by window: the working memory is that of a slice, however long a text is
        (a word longer than a slice makes a window of its own)."""
        out = np.zeros(len(self.start), U64)
        i = 0
        while i < len(out):
            low = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.start, low + SLICE_BYTES)))
            data, start, end = self.data[low : self.end[j - 1]], self.start[i:j] - low, self.end[i:j] - low
            power, inverse = _powers(len(data) + 1)
            sums = np.zeros(len(data) + 1, U64)
            np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
            h = (sums[end] - sums[start]) * inverse[start]
            out[i:j] = mix(h + (end - start).astype(U64) * _STEP[63])
            i = j
        return out

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last eight bytes of each word, as numbers (shorter words: all of it, twice)."""
        padded = np.concatenate((self.data, np.zeros(8, np.uint8)))
        eight = np.ndarray((len(self.data) + 1,), "<u8", padded, 0, (1,))
        size = np.minimum(self.end - self.start, 8)
        mask = U64(2**64 - 1) >> (U64(64) - U64(8) * size.astype(U64))
        return eight[self.start] & mask, eight[self.end - size] & mask

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def strings(self, at: list[int]) -> list[str]:
        raw = memoryview(self.data)
        return [str(raw[a:b], "utf-8") for a, b in zip(self.start[at].tolist(), self.end[at].tolist(), strict=True)]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive words, those that cross texts included."""
    if len(h) < k:
        return np.zeros(0, U64)
    n = len(h) - k + 1
    g = np.full(n, U64(k), U64)
    for j in range(k):
        g += h[j : j + n] * _STEP[j]
    return mix(g)
