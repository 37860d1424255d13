"""Words one edit apart, by composing a vocabulary acceptor with a one-edit transducer and the acceptor again.

Two words one edit apart agree before and after a segment that holds the edit. Each word is
cut at the middle (for its own length, and for that of a word one letter shorter), which
gives two such segments; words that agree outside a segment start from one initial state.
Each initial state has a minimised acceptor of the segments alone, and the accepted pairs of
acceptor, edit and acceptor are enumerated there. An initial state with very many words is
split: its segment is halved until each part is small, so no hot prefix stays in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoweave.llm.base import query, sql_crc32, stored, table
from ontoweave.llm.words import _LOWER, Texts, hashed_spans, text_blocks, text_column

LEAST_LENGTH = 5  # code points of a word
LEAST_COUNT = 3
DAMAGED = 97  # one run in so many loses a code point
DOMINANT = 2  # a form stands this many times as often as the word
LARGEST_STATE = 5_000  # words of an initial state beyond which its segment is halved

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LEAD = 0xC3  # first byte of U+00C0 to U+00FF, and of nothing else
_SHORT = 64  # bytes of a run up to which checksums are combined by column


def _crc_table() -> np.ndarray:
    """The byte table of the CRC-32 polynomial."""
    rows = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rows = np.where(rows & 1, rows >> 1 ^ np.uint32(0xEDB88320), rows >> 1).astype(np.uint32)
    return rows


_CRC = _crc_table()


def _runs(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of each maximal run of letters."""
    data, n = texts.data, len(texts.data)
    lead = data == _LEAD
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(n + 1, bool)
    edge[texts.offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(texts.offsets, start, "right") - 1


def _checksums(ids: list[str], text: np.ndarray, length: np.ndarray, own: np.ndarray) -> np.ndarray:
    """CRC-32 of ``<id>:<run>`` from that of the id's part and of the run: the first is moved on by the run's length."""
    moved = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    out = np.zeros(len(text), np.uint32)
    order = np.argsort(length, kind="stable")
    cuts = np.searchsorted(length[order], np.arange(1, _SHORT + 2))
    for n in range(1, _SHORT + 1):
        moved = moved >> np.uint32(8) ^ _CRC[moved & np.uint32(255)]
        at = order[cuts[n - 1] : cuts[n]]
        out[at] = moved[text[at]] ^ own[at]
    return out


def block_counts(texts: Texts, ids: list[str]) -> tuple[list[bytes], list[int]]:
    """Words of a block of texts after the damage, and how often each stands there."""
    start, end, text = _runs(texts)
    if not len(start):
        return [], []
    lowered = _LOWER[texts.data].tobytes()
    _, first, number = np.unique(hashed_spans(texts.data, start, end, lower=True), return_index=True, return_inverse=True)
    spans = list(zip(start[first].tolist(), end[first].tolist()))
    words = [lowered[a:b] for a, b in spans]
    length = end - start
    own = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))[number]
    sums = _checksums(ids, text, length, own)
    for k in np.flatnonzero(length > _SHORT).tolist():
        sums[k] = zlib.crc32(f"{ids[text[k]]}:".encode() + words[number[k]])
    hit = sums % DAMAGED == 0
    counts = np.bincount(number[~hit], minlength=len(words))
    leads = np.concatenate([[0], np.cumsum(texts.data == _LEAD)])
    points = (length - (leads[end] - leads[start]))[first]
    kept = np.flatnonzero((counts > 0) & (points >= LEAST_LENGTH)).tolist()
    out, n = [words[k] for k in kept], counts[kept].tolist()
    for k in np.flatnonzero(hit).tolist():
        word = words[number[k]].decode()
        at = int(sums[k]) % len(word)
        if len(word) > LEAST_LENGTH:
            out.append((word[:at] + word[at + 1 :]).encode())
            n.append(1)
    return out, n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).fill_null("").to_pylist()
        for block in text_blocks(text_column(batch, "text"), 1 << 21):
            words, n = block_counts(block, ids[block.first : block.first + len(block)])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters of whole texts, lower-cased in A-Z, damaged by their checksum, of at least 5 code points and 3 occurrences."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


class Acceptor:
    """The minimised acceptor of sorted distinct strings; every arc knows how many strings are accepted before it."""

    def __init__(self, strings: list[str]):
        arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        self.arcs: dict[int, dict[str, tuple[int, int]]] = {}  # of settled states: letter -> (target, strings before it)
        count: dict[int, int] = {}
        known: dict[tuple, int] = {}
        path: list[tuple[int, str, int]] = []  # arcs of the last string whose targets may still change

        def number(state: int) -> None:
            before, own = int(self.final[state]), {}
            for letter, target in arcs[state].items():
                own[letter] = (target, before)
                before += count[target]
            self.arcs[state], count[state] = own, before

        def settle(keep: int) -> None:
            while len(path) > keep:
                state, letter, target = path.pop()
                key = (self.final[target], *arcs[target].items())
                if key not in known:
                    known[key] = target
                    number(target)
                arcs[state][letter] = known[key]

        last = ""
        for s in strings:
            n, m = 0, min(len(s), len(last))
            while n < m and s[n] == last[n]:
                n += 1
            settle(n)
            state = path[-1][2] if path else 0
            for letter in s[n:]:
                arcs.append({})
                self.final.append(False)
                arcs[state][letter] = len(arcs) - 1
                path.append((state, letter, len(arcs) - 1))
                state = len(arcs) - 1
            self.final[state] = True
            last = s
        settle(0)
        number(0)

    def one_edit_pairs(self) -> Iterator[tuple[int, int, bool]]:
        """(rank, rank, replaced) of every accepted pair of strings one replaced or one inserted letter apart, each once.

        Composed states are (state of one string, edit made, state of the other, their ranks).
        Before the edit both states are the same. An inserted letter is taken where the strings
        first differ, so the letter after it must be another.
        """
        arcs, final = self.arcs, self.final
        equal = [(0, 0)]
        while equal:
            state, rank = equal.pop()
            out = list(arcs[state].items())
            edited = []
            for k, (letter, (x, before)) in enumerate(out):
                equal.append((x, rank + before))
                for _, (y, other) in out[k + 1 :]:
                    edited.append((x, y, rank + before, rank + other, True))
                # the letter is the longer string's alone
                if final[x] and final[state]:
                    yield rank + before, rank, False
                ahead = arcs[x]
                for other, (y, past) in out:
                    if other != letter and other in ahead:
                        z, more = ahead[other]
                        edited.append((z, y, rank + before + more, rank + past, False))
            while edited:
                x, y, a, b, replaced = edited.pop()
                if final[x] and final[y]:
                    yield a, b, replaced
                other = arcs[y]
                for letter, (z, more) in arcs[x].items():
                    if letter in other:
                        w, past = other[letter]
                        edited.append((z, w, a + more, b + past, replaced))


def near_pairs(segments: list[str], width: int, closing: bool) -> Iterator[tuple[int, int]]:
    """Positions of the segments of one initial state that are one edit apart.

    ``segments`` are sorted and distinct, of ``width`` letters or one more. Two of the longer
    ones are no pair here (they meet at their own length), and a letter after the whole
    segment belongs to the next segment unless this one closes the word.
    """
    for a, b, replaced in Acceptor(segments).one_edit_pairs():
        if replaced:
            if len(segments[a]) == width:
                yield a, b
        elif closing or not segments[a].startswith(segments[b]):
            yield a, b


def _enumerate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, best, form) of each initial state's words; rows come sorted by state and segment."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in range(7)))

    found: list[tuple[str, int, int, str]] = []
    for (size, lo, hi, head, tail), group in groupby(rows(), key=lambda r: r[:5]):
        group = list(group)
        if len(group) < 2 or min(len(r[5]) for r in group) > hi - lo:
            continue
        segments, n = [r[5] for r in group], [r[6] for r in group]
        near: dict[int, list] = {}
        for a, b in near_pairs(segments, hi - lo, hi == size):
            for own, other in ((a, b), (b, a)):
                if (best := near.get(own)) is None:
                    near[own] = [1, other]
                else:
                    best[0] += 1
                    if (-n[other], segments[other]) < (-n[best[1]], segments[best[1]]):
                        best[1] = other
        found += [(head + segments[k] + tail, count, n[best], head + segments[best] + tail) for k, (count, best) in near.items()]
        if len(found) > 10_000:
            yield _near_rows(found)
            found = []
    if found:
        yield _near_rows(found)


def _near_rows(found: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
    word, count, best, form = zip(*found)
    return pa.RecordBatch.from_arrays(
        [pa.array(word, pa.string()), pa.array(count, pa.int64()), pa.array(best, pa.int64()), pa.array(form, pa.string())], ["word", "n_near", "best", "form"]
    )


STATE = ["size", "lo", "hi", "head", "tail"]


def _segment(word: Column, size: Column, lo: Column, hi: Column) -> list[Column]:
    """What stands before the segment, after it, and in it, in a word of ``size`` letters or one more."""
    after = size - hi
    return [
        F.substr(word, F.lit(1), lo).alias("head"),
        F.substr(word, F.char_length(word) - after + F.lit(1), after).alias("tail"),
        F.substr(word, lo + F.lit(1), F.char_length(word) - after - lo).alias("segment"),
    ]


def initial_states(words: DataFrame) -> DataFrame:
    """(size, lo, hi, head, tail, segment, n): each word at the initial states where it may have near words."""
    size = F.explode(F.array(F.char_length("word"), F.char_length("word") - F.lit(1))).alias("size")
    cut = F.floor(F.col("size") / 2).cast("int")
    bounds = F.explode(F.array(F.struct(F.lit(0).alias("lo"), cut.alias("hi")), F.struct(cut.alias("lo"), F.col("size").alias("hi")))).alias("b")
    rows = words.select("word", "n", size).select("word", "n", "size", bounds).select("word", "n", "size", "b.lo", "b.hi")
    return rows.select("size", "lo", "hi", *_segment(F.col("word"), F.col("size"), F.col("lo"), F.col("hi")), "n")


def _halved(rows: DataFrame) -> DataFrame:
    """Rows of a segment as rows of its two halves."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    bounds = F.explode(F.array(F.struct(F.col("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi")))).alias("b")
    word = rows.select(F.concat("head", "segment", "tail").alias("word"), "n", "size", bounds).select("word", "n", "size", "b.lo", "b.hi")
    return word.select("size", "lo", "hi", *_segment(F.col("word"), F.col("size"), F.col("lo"), F.col("hi")), "n")


def near_words(words: DataFrame, largest: int = LARGEST_STATE) -> DataFrame:
    """(word, n_near, best, form): number of near words, the largest n among them, and the first word with it.

    A state of more than ``largest`` words is split by halving its segment; one letter is the
    least segment, which holds at most the letters' pairs.
    """
    rows = initial_states(words)
    while True:
        full = rows.filter("hi - lo > 1").groupBy(*STATE).count().filter(F.col("count") > largest).select(*STATE, F.lit(True).alias("full"))
        full = stored(full, "full_states")
        if full.isEmpty():
            break
        marked = rows.join(full, STATE, "left")
        rows = stored(marked.filter("full is null").select(rows.columns).unionByName(_halved(marked.filter("full"))), "states")
    dealt = rows.repartition(*STATE).sortWithinPartitions(*STATE, "segment").select(*STATE, "segment", "n")
    parts = dealt.mapInArrow(_enumerate, "word string, n_near long, best long, form string")
    best = F.min(F.struct((-F.col("best")).alias("less"), "form")).alias("b")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.less")).alias("best"), "b.form")


def group_variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a vocabulary (word, n).

    The form is the near word of the largest n (of several the first in code-point order) if
    it stands at least twice as often; the root is the last word that forms lead to. n doubles
    with each form, so chains end. An empty vocabulary gives no rows.
    """
    words = stored(words, "vocabulary")
    near = near_words(words)
    own = F.col("best") >= DOMINANT * F.col("n")
    rows = stored(
        words.join(near, "word", "left").select(
            "word", F.when(own, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(own, F.col("best")).alias("form_n")
        ),
        "forms",
    )
    links = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the length of the chain that is followed
        links = stored(links, "roots")
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        if links.join(ahead, "root", "left_semi").isEmpty():
            break
        links = links.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"))
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


OP12_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), counted AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key, run, count(*) AS n FROM runs GROUP BY ALL
), summed AS (
  SELECT run, n, {sql_crc32("key")} AS h FROM counted
), damaged AS (
  SELECT CASE WHEN h % {DAMAGED} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM summed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
), holes AS (
  SELECT word, n, substr(word, 1, pos) AS head, substr(word, pos + 2) AS tail FROM (SELECT word, n, unnest(range(0, length(word))) AS pos FROM words)
), pairs AS (
  SELECT a.word, b.word AS near, b.n FROM holes a JOIN holes b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM holes a JOIN words b ON b.word = a.head || a.tail
  UNION
  SELECT b.word, a.word, a.n FROM holes a JOIN words b ON b.word = a.head || a.tail
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS top FROM pairs GROUP BY word
), first_best AS (
  SELECT p.word, min(p.near) AS form FROM pairs p JOIN best b ON b.word = p.word AND b.top = p.n GROUP BY p.word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= {DOMINANT} * w.n THEN f.form END AS form,
    CASE WHEN b.top >= {DOMINANT} * w.n THEN b.top END AS form_n
  FROM words w LEFT JOIN best b USING (word) LEFT JOIN first_best f USING (word)
), chain AS (
  SELECT word, word AS last FROM forms
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.last WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.last AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c USING (word) JOIN forms e ON e.word = c.last AND e.form IS NULL
"""


@query("op12_spelling_variants", OP12_SQL)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(vocabulary(table(spark, sf_dir, "documents")))
