"""Language identification with interpolated Kneser-Ney character models.

One model a language, all in sorted arrays of 64-bit n-gram hashes: an n-gram's row holds
its discounted share and, as a history, its back-off weight. A text gets the language with
the lowest cross-entropy per character. What the winner's own held-in texts show of that
cross-entropy, and of its lead on the second language, calibrates the rejection.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoweave.llm.base import query, table
from ontoweave.llm.words import Texts, mix64, text_blocks, text_column

ORDER = 4  # characters in the longest n-gram
SAMPLE = 1000  # training texts a language at most, by the hash of their id: the bound of what a model can hold
LANGUAGES = 1000  # with the most labelled rows
UNKNOWN = "und"
_U = np.uint64
_EDGE = 0  # symbol before and after a run of letters

_LETTERS = np.zeros(0x110000, bool)
_FOLD = np.arange(0x110000, dtype=np.uint32)


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and their lower case where that is one code point."""
    if not _LETTERS[97]:
        text = "".join(map(chr, range(0x110000)))
        _LETTERS[:] = np.fromiter(map(str.isalpha, text), bool, 0x110000)
        low = [c.lower() for c in text]
        _FOLD[:] = np.fromiter((ord(x) if len(x) == 1 else ord(c) for x, c in zip(low, text)), np.uint32, 0x110000)
    return _LETTERS, _FOLD


def symbols(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, text of each): lower-cased letters of words, with one edge symbol between and around words."""
    letters, fold = _letters()
    data = texts.data.tobytes().decode("utf-8", "replace")
    codes = np.frombuffer(data.encode("utf-32-le", "replace"), np.uint32)
    begins = (texts.data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(begins)])[texts.offsets]
    text = np.repeat(np.arange(len(texts)), np.diff(chars))
    out = np.where(letters[codes], fold[codes], _EDGE)
    same = np.zeros(len(out), bool)
    same[1:] = (out[1:] == _EDGE) & (out[:-1] == _EDGE) & (text[1:] == text[:-1])
    return out[~same], text[~same]


def grams(symbol: np.ndarray, text: np.ndarray, at: np.ndarray, longest: int = ORDER) -> list[np.ndarray]:
    """Hashes of the n-grams of 1, 2, .. symbols that end at each place; 0 where one would reach out of its text."""
    h, out = np.zeros(len(at), _U), []
    for back in range(longest):
        place = np.maximum(at - back, 0)
        inside = (at >= back) & (text[place] == text[np.maximum(at, 0)])
        h = np.where(inside, mix64(h * _U(0x9E3779B97F4A7C15) + symbol[place] + _U(1)), _U(0))
        out.append(h)
    return out


def distinct_places(symbol: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct longest n-gram, which of them stands at each place)."""
    kinds, own = np.unique(symbol, return_inverse=True)
    base, n = len(kinds) + 1, len(symbol)  # the extra code stands for what lies before a text
    code = np.zeros(n, np.int64)
    for back in range(ORDER):
        digit = np.full(n, base - 1, np.int64)
        if back < n:
            digit[back:] = np.where(text[: n - back] == text[back:], own[: n - back], base - 1)
        code = code * base + digit
    if base**ORDER > 1 << 25:  # a large alphabet: sort instead of a table of all codes
        _, place, kind = np.unique(code, return_index=True, return_inverse=True)
        return place, kind
    place_of = np.full(base**ORDER, -1, np.int32)
    place_of[code] = np.arange(n, dtype=np.int32)
    seen = np.flatnonzero(place_of >= 0)
    place = place_of[seen].astype(np.int64)
    place_of[seen] = np.arange(len(seen), dtype=np.int32)
    return place, place_of[code]


def _count(batches) -> Iterator[pa.RecordBatch]:
    """(lang, order, gram, history, suffix, n) over the texts of a batch."""
    for batch in batches:
        langs = np.array(batch.column(batch.schema.get_field_index("lang")).to_pylist(), object)
        for texts in text_blocks(text_column(batch, "text")):
            sym, text = symbols(texts)
            own = langs[texts.first : texts.first + len(texts)]
            levels = grams(sym, text, np.arange(len(sym)))
            for lang in dict.fromkeys(own.tolist()):
                mine = (own == lang)[text]
                for k in range(1, ORDER + 1):
                    at = np.flatnonzero(mine & (levels[k - 1] != 0))
                    if not len(at):
                        continue
                    found, first, n = np.unique(levels[k - 1][at], return_index=True, return_counts=True)
                    end = at[first]
                    history = levels[k - 2][end - 1] if k > 1 else np.zeros(len(end), _U)
                    suffix = levels[k - 2][end] if k > 1 else np.zeros(len(end), _U)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(end)), pa.array(np.full(len(end), k, np.int32)), *(pa.array(x.view(np.int64)) for x in (found, history, suffix)), pa.array(n)],
                        ["lang", "k", "gram", "history", "suffix", "n"],
                    )


@dataclass
class Level:
    """N-grams of one order of one language, sorted by hash."""

    gram: np.ndarray
    share: np.ndarray  # (count - discount) / count of the history
    backoff: np.ndarray  # weight of the shorter model when this n-gram is the history

    def find(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.gram, h), len(self.gram) - 1)
        return np.where(self.gram[at] == h, at, -1)


class CharacterModel:
    def __init__(self, counts: pd.DataFrame):
        """``counts``: k, gram, history, suffix, n of one language (hashes as unsigned)."""
        self.levels: list[Level] = []
        for k in range(1, ORDER + 1):
            own = counts[counts["k"] == k].sort_values("gram")
            gram, history = own["gram"].to_numpy(_U), own["history"].to_numpy(_U)
            if k == ORDER:
                n = own["n"].to_numpy(np.float64)
            else:  # below the top: in how many different longer n-grams it is the suffix
                longer = counts[counts["k"] == k + 1]["suffix"].to_numpy(_U)
                kinds, many = np.unique(longer, return_counts=True)
                at = np.minimum(np.searchsorted(kinds, gram), max(len(kinds) - 1, 0))
                n = np.where(kinds[at] == gram, many[at], 1).astype(np.float64) if len(kinds) else own["n"].to_numpy(np.float64)
            once, twice = float((n == 1).sum()), float((n == 2).sum())
            discount = once / (once + 2 * twice) if once + twice else 0.5
            groups, where = np.unique(history, return_inverse=True)
            total = np.bincount(where, n, len(groups))
            kinds = np.bincount(where, minlength=len(groups))
            self.levels.append(Level(gram, np.maximum(n - discount, 0) / total[where], np.ones(len(gram))))
            weight = discount * kinds / total
            if k == 1:
                self.floor_weight = float(weight[0]) if len(weight) else 1.0
            else:
                lower = self.levels[k - 2]
                at = lower.find(groups)
                lower.backoff[at[at >= 0]] = weight[at >= 0]
        self.floor = 1.0 / (len(self.levels[0].gram) + 1)

    def log2(self, levels: list[np.ndarray], histories: list[np.ndarray]) -> np.ndarray:
        """log2 probability of the last symbol of n-grams, from their hashes and those of what stands before it."""
        p = np.full(len(levels[0]), self.floor * self.floor_weight)
        for k, level in enumerate(self.levels, 1):
            found = level.find(levels[k - 1])
            share = np.where((found >= 0) & (levels[k - 1] != 0), level.share[found], 0.0)
            if k > 1:
                seen = self.levels[k - 2].find(histories[k - 2])
                p = p * np.where((seen >= 0) & (histories[k - 2] != 0), self.levels[k - 2].backoff[seen], 1.0)
            p = share + p
        return np.log2(p)


@dataclass
class LanguageModel:
    names: list[str]
    models: list[CharacterModel]
    typical: np.ndarray  # mean cross-entropy of a language's own texts, and its spread
    spread: np.ndarray

    def entropies(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per symbol of each text under each language, letters in each text)."""
        sym, text = symbols(texts)
        n_letters = np.bincount(text[sym != _EDGE], minlength=len(texts))
        place, kind = distinct_places(sym, text)  # each distinct n-gram of the block is scored once
        levels = grams(sym, text, place)
        before = np.where((place > 0) & (text[np.maximum(place - 1, 0)] == text[place]), place - 1, -ORDER)
        histories = grams(sym, text, before, ORDER - 1)
        length = np.maximum(np.bincount(text, minlength=len(texts)), 1)
        bits = [np.bincount(text, -m.log2(levels, histories)[kind], len(texts)) / length for m in self.models]
        return np.stack(bits, axis=1), n_letters

    def judge(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language or -1, score in 0..1, accepted) of each text."""
        bits, letters = self.entropies(texts)
        best = bits.argmin(axis=1)
        rows = np.arange(len(bits))
        low = bits[rows, best]
        others = bits.copy()
        others[rows, best] = np.inf
        lead = np.minimum(others.min(axis=1), 64) - low if bits.shape[1] > 1 else np.full(len(bits), 64.0)
        evidence = np.clip(lead * np.sqrt(np.maximum(letters, 1)), 0, 60)
        room = self.typical[best] + 6 * self.spread[best] + 3 / np.sqrt(np.maximum(letters, 1))  # short texts vary more
        fit = np.clip((room - low) / (3 * self.spread[best]), -60, 60)
        score = 1 / (1 + np.exp(-fit)) * (1 - np.exp(-evidence))
        known = letters > 0
        return np.where(known, best, -1), np.where(known, score, 0.0), known & (score >= 0.5)


def train(labelled: DataFrame) -> LanguageModel | None:
    """Model from ``labelled`` (id, text, lang), at most SAMPLE different texts a language; None without any letter.

    Of each language those with the smallest hashes of id and text are taken. Its number of rows gives a hash under
    which about twice as many lie, so what meets in one task does not grow with the input, however often a row stands.
    """
    from pyspark.sql import Window

    pick = labelled.filter("text is not null and lang is not null").select("lang", "text", F.xxhash64("id", "text").alias("h"))
    rows = {r["lang"]: r["n"] for r in pick.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    share = (F.col("h") / F.lit(2.0**64)) + 0.5
    under = F.lit(False)
    for lang, n in rows.items():
        under = F.when(F.col("lang") == lang, share < 2.0 * SAMPLE / n).otherwise(under)
    few = pick.filter(under).dropDuplicates(["lang", "h"])
    sample = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("n") <= SAMPLE).select("lang", "text")
    sample = sample.persist()
    counted = (
        sample.select("lang", "text").mapInArrow(_count, "lang string, k int, gram long, history long, suffix long, n long")
        .groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"), F.min("history").alias("history"), F.min("suffix").alias("suffix")).toPandas()
    )  # bounded by the sample
    if counted.empty:
        sample.unpersist()
        return None
    for c in ("gram", "history", "suffix"):
        counted[c] = counted[c].to_numpy(np.int64).view(_U)
    names = sorted(counted["lang"].unique())
    parts = dict(list(counted.groupby("lang")))
    model = LanguageModel(names, [CharacterModel(parts[n]) for n in names], np.zeros(len(names)), np.ones(len(names)))
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def own_bits(batches):
        for batch in batches:
            langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
            for texts in text_blocks(text_column(batch, "text")):
                bits, letters = shared.value.entropies(texts)
                at = [names.index(x) for x in langs[texts.first : texts.first + len(texts)]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int32()), pa.array(bits[np.arange(len(at)), at]), pa.array(letters)], ["at", "bits", "letters"]
                )

    seen = sample.select("lang", "text").mapInArrow(own_bits, "at int, bits double, letters long").filter("letters > 0").toPandas()
    sample.unpersist()
    shared.destroy()
    for k, part in seen.groupby("at"):
        middle = float(part["bits"].median())
        model.typical[k] = middle
        model.spread[k] = max(1.4826 * float((part["bits"] - middle).abs().median()), 0.02)
    return model


def identify(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and accepted (replacing columns of those names); only the text is read.

    A null text, or one without a letter, is ``und`` with score 0 and is rejected. Rows are judged
    one by one, so repeated rows and null ids stay.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for texts in text_blocks(text_column(batch, "__whole_text")):
                n = len(texts)
                if shared.value is None:
                    at, score, ok = np.full(n, -1), np.zeros(n), np.zeros(n, bool)
                else:
                    at, score, ok = shared.value.judge(texts)
                rows = batch.slice(texts.first, n)
                pred = [UNKNOWN if k < 0 else shared.value.names[k] for k in at]
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(i) for i in range(len(kept))), pa.array(pred, pa.string()), pa.array(score), pa.array(ok)], [*kept, "lang_pred", "score", "accepted"]
                )

    frame = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).alias("__whole_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept)
    return frame.mapInArrow(run, f"{kinds}, lang_pred string, score double, accepted boolean")


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(False))


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = docs.filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text", "lang")
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(rows, train(labelled)).drop("text")
