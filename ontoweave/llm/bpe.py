"""Byte-pair encoding with a pair occurrence index, and decoding.

The distinct chunks of a task are laid out as one linked sequence of symbols. The index
maps each mergeable pair to all positions where it stands; the active ranks are taken in
ascending order, every occurrence of a rank is merged at once, and only the lists of the
pairs to the left and right of a merge change.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ontoweave.llm.base import query, table
from ontoweave.llm.chunks import ChunkEncoder, blocks, tokenizer_path


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next free code from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    names = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}
    return [names[b] for b in range(256)]


class PairMerger:
    """Merges of a byte-pair vocabulary over many words at once."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        """``merges``: (left id, right id, merged id) by ascending rank."""
        table = np.array(merges, np.int64).reshape(-1, 3)
        made = np.full(int(table.max(initial=0)) + 1, -1, np.int64)
        made[table[:, 2]] = np.arange(len(table))
        if len(table) and (np.maximum(made[table[:, 0]], made[table[:, 1]]) >= np.arange(len(table))).any():
            raise ValueError("a merge uses a symbol that only a later merge makes")
        self.left, self.right, self.merged = table.T.astype(np.int32)
        code = table[:, 0] << 32 | table[:, 1]
        self._order = np.argsort(code, kind="stable")
        self._code = code[self._order]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it does not merge."""
        code = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self._code, code), len(self._code) - 1)
        return np.where(self._code[at] == code, self._order[at], -1)

    def merge(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols and bounds of the words ``symbols[bounds[i]:bounds[i + 1]]``."""
        sym, n = symbols.astype(np.int32).copy(), len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        filled = bounds[1:][np.diff(bounds) > 0]
        after[filled - 1] = -1
        before[filled[:-1]] = -1
        if n:
            before[0] = -1
        alive = np.ones(n, bool)
        lists: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def index(at: np.ndarray) -> None:
            at = at[after[at] >= 0]
            rank = self._rank(sym[at], sym[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for part, first in zip(np.split(at, cuts), rank[np.r_[0, cuts]] if len(rank) else []):
                if (r := int(first)) not in lists:
                    lists[r] = []
                    heapq.heappush(ranks, r)
                lists[r].append(part)

        if len(self._code) and n:
            index(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            found = lists.pop(r)
            at = np.unique(np.concatenate(found))
            left, right = self.left[r], self.right[r]
            nxt = after[at]
            at = at[alive[at] & (sym[at] == left) & (nxt >= 0) & (sym[nxt] == right)]
            if left == right and len(at) > 1:  # in a run only every other occurrence merges
                new_run = np.r_[True, after[at[:-1]] != at[1:]]
                start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            sym[at] = self.merged[r]
            alive[gone] = False
            after[at] = beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            ahead = before[at]
            index(np.concatenate([ahead[ahead >= 0], at]))
        kept = np.concatenate([[0], np.cumsum(alive)])
        return sym[alive], kept[bounds]


class BpeTokenizer:
    """A lower-casing word-end byte-level vocabulary, read from its public JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or spec["decoder"]:
            raise ValueError("another kind of tokenizer than this class reads")
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self._pieces = regex.compile(pattern).findall
        reader = Tokenizer.from_file(path)
        self._rare = re.compile("[^\u0000-\u024f]").search
        self._rare_pieces = lambda text: [p for p, _ in reader.pre_tokenizer.pre_tokenize_str(reader.normalizer.normalize_str(text))]
        self._specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        names = byte_symbols()
        byte_of = {c: b for b, c in enumerate(names)}
        self._bytes = lambda piece: bytes(map(byte_of.__getitem__, piece))
        self._inner = np.array([self.vocab[c] for c in names], np.int32)
        self._last = np.array([self.vocab[c + self.end] for c in names], np.int32)
        self._merger = PairMerger([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in map(tuple, model["merges"])])
        self._chunks = ChunkEncoder(self._encode_chunks)

    def _cut(self, chunk: str) -> list[str | bytes]:
        """Pieces as bytes, special tokens as text."""
        if "<|" in chunk:
            return [p for part in self._specials(chunk) for p in ([part] if part in self.special else self._normal(part))]
        return self._normal(chunk)

    def _normal(self, text: str) -> list[bytes]:
        if self._rare(text):  # which letters are known there depends on the Unicode version: the library cuts these
            return [self._bytes(p) for p in self._rare_pieces(text)]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return [p.encode() for p in self._pieces(text.lower())]

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [self._cut(c) for c in chunks]
        number = {p: k for k, p in enumerate(dict.fromkeys(p for pieces in cut for p in pieces))}
        plain = [p if isinstance(p, bytes) else b"" for p in number]
        bounds = np.cumsum([0, *map(len, plain)])
        data = np.frombuffer(b"".join(plain), np.uint8)
        symbols = self._inner[data]
        ends = bounds[1:][np.diff(bounds) > 0] - 1
        symbols[ends] = self._last[data[ends]]
        merged, at = self._merger.merge(symbols, bounds)
        for p, k in number.items():
            if not plain[k]:
                special = np.array([self.special[p]], np.int32)
                merged, at = np.concatenate([merged[: at[k]], special, merged[at[k] :]]), at + (np.arange(len(at)) > k)
        pieces = np.fromiter((number[p] for piece in cut for p in piece), np.int64)
        length = np.diff(at)[pieces]
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = merged[np.repeat(at[:-1][pieces] - ends[:-1], length) + np.arange(ends[-1])]
        return ids, ends[np.cumsum([0, *map(len, cut)])]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and the bounds of each text in them."""
        return self._chunks.encode(texts)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens with a blank between them, as a vocabulary without a decoder is read; unknown ids are left out."""
        return " ".join(t for t in map(self.tokens.get, ids.tolist()) if t is not None)


def encode_documents(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` and the token ids of the whole text as ``ids`` (replacing a column of that name).

    Null and blank texts have no ids; any row is kept, repeated rows too.
    """
    kept = [c for c in docs.columns if c != "ids"]

    def run(batches):
        tokenizer = BpeTokenizer(path)
        for batch in batches:
            for first, texts in blocks(batch.column(batch.schema.get_field_index("__whole_text"))):
                ids, bounds = tokenizer.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                rows = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(kept))), lists], [*kept, "ids"])

    frame = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).alias("__whole_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept)
    return frame.mapInArrow(run, f"{kinds}, ids array<int>")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode each whole text, decode its ids, and digest both.

    A null text is empty; a row without an id stays with a null id.
    """

    def run(batches):
        tokenizer = BpeTokenizer(path)
        for batch in batches:
            for first, texts in blocks(batch.column(1)):
                ids, bounds = tokenizer.encode(texts)
                n, a, b = [], [], []
                for lo, hi in zip(bounds[:-1], bounds[1:]):
                    own = ids[lo:hi]
                    n.append(len(own))
                    a.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    b.append(hashlib.sha256(tokenizer.decode(own).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op1_bpe_round_trip")
def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path())
