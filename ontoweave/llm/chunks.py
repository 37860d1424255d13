"""Token ids of whole texts by way of their distinct blank-free chunks.

The tokenizers handled here drop white space and never look across it, so a text's ids
are those of its chunks in order; each distinct chunk is encoded once per worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa

# A full stop or comma after a plain word is a chunk of its own: no tokenizer here joins it to letters.
_CHUNK = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[.,]?(?:[ \t\n\r]|$))|[.,](?=[ \t\n\r]|$)|[^ \t\n\r]+").findall
KNOWN = 1 << 19  # chunks remembered before the memory starts anew
KNOWN_CHARS = 1 << 23  # and characters in them
BLOCK = 1 << 21  # characters encoded together


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class _Numbered(dict):
    """Numbers each new key as it is asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class ChunkEncoder:
    """``encode_new`` gives the ids of distinct chunks, all in one array, and the bounds of each."""

    def __init__(self, encode_new: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], known: int = KNOWN, chars: int = KNOWN_CHARS):
        self._encode_new, self._most, self._most_chars = encode_new, known, chars
        self._forget()

    def _forget(self) -> None:
        self._index = _Numbered()
        self._chars = 0
        self._ids = np.empty(0, np.uint32)
        self._start = np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the bounds of each text in them."""
        if len(self._index) > self._most or self._chars > self._most_chars:
            self._forget()
        cut = [_CHUNK(t) for t in texts]
        chunks = [c for text in cut for c in text]
        known = len(self._index)
        at = np.fromiter(map(self._index.__getitem__, chunks), np.int64, len(chunks))
        new = list(islice(self._index, known, None))
        if new:
            self._chars += sum(map(len, new))
            ids, bounds = self._encode_new(new)
            self._ids = np.concatenate([self._ids, ids.astype(np.uint32)])
            self._start = np.concatenate([self._start, self._start[-1] + bounds[1:]])
        length = self._start[at + 1] - self._start[at]
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = self._ids[np.repeat(self._start[at] - ends[:-1], length) + np.arange(ends[-1])]
        return ids, ends[np.cumsum([0, *map(len, cut)])]


_kept: dict[tuple[str, str], object] = {}


def kept_in_worker(kind: str, path: str, make: Callable[[str], object]):
    """One encoder for a file in each Python worker, so that tasks share what it has learnt."""
    if (kind, path) not in _kept:
        _kept[kind, path] = make(path)
    return _kept[kind, path]


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in blocks of bounded size; null is an empty text."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text.as_py() or ""
        if held and size + len(text) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held
