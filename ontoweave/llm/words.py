"""Words of whole texts as numpy columns, straight from Arrow buffers.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. Its 64-bit hash comes
from prefix sums of a polynomial over the bytes, so a block of texts needs a few
vectorised passes and no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20  # texts are handled in blocks of about this many bytes; a longer text is a block of its own

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_LOWER = _PLAIN.copy()
_LOWER[65:91] += 32
_BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(_BASE))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        step = np.full(max(n, 1 << 16), _U(_BASE if kind == "up" else _INVERSE))
        step[0] = 1
        _powers[kind] = np.cumprod(step, dtype=_U)
    return _powers[kind][:n]


@dataclass
class Texts:
    """Consecutive texts of a batch: rows ``first``.. , UTF-8 bytes and offsets."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as large strings, null as empty text."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()).fill_null("")


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Texts]:
    n = len(column)
    if n == 0:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        lo, hi = int(offsets[at]), int(offsets[to])
        yield Texts(at, data[lo:hi], offsets[at : to + 1] - lo)
        at = to


@dataclass
class Words:
    """``start``, ``end`` and ``hash`` per word; words of text i are ``bounds[i]:bounds[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def hashed_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes give equal hashes wherever they stand."""
    n = len(data)
    sums = np.zeros(n + 1, _U)
    if n:
        np.cumsum(_BYTE[(_LOWER if lower else _PLAIN)[data]] * _power("up", n), out=sums[1:])
    return mix64((sums[end] - sums[start]) * _power("down", n + 1)[start])


def words_of(texts: Texts, lower: bool = False) -> Words:
    data, n = texts.data, len(texts.data)
    word = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[texts.offsets] = True
    begins, ends = word.copy(), word
    if n:
        begins[1:] &= ~word[:-1] | edge[1:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(start, end, hashed_spans(data, start, end, lower), np.searchsorted(start, texts.offsets))


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every window of ``size`` words that stays inside one text."""
    h, n = words.hash, len(words.hash)
    m = n - size + 1
    if m <= 0:
        return np.empty(0, _U), np.empty(0, np.int64)
    total = np.zeros(m, _U)
    for k in range(size):
        total += h[k : k + m] * _U(pow(_BASE, k + 1, 1 << 64))
    text = words.text_of()
    first = np.flatnonzero(text[:m] == text[size - 1 :])
    return mix64(total[first]), first
