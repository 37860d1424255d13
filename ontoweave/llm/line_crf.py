"""Quality rules by line labelling: Viterbi decoding of a linear-chain CRF marks content and boilerplate.

Each line with a word gets one bucket of every feature group. The chain is trained here, by
gradient ascent on its conditional likelihood over weakly labelled lines of a bounded
sample; a document is kept when enough of its word characters stand in content lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoweave.llm.base import query, table
from ontoweave.llm.words import Texts, hashed_spans, mix64, text_blocks, text_column, windows, words_of

WINDOW = 8
SAMPLE = 2000  # training documents at most, by the hash of their id
SAMPLE_BYTES = 100_000  # longer texts are not trained on; every text is judged
SHARE = 0.5  # of word characters in content lines, to be kept
_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True

# inner bucket edges of each feature group
EDGES = {
    "words": [3, 6, 12, 25],
    "symbols": [0.001, 0.05, 0.2, 0.5],
    "upper": [0.1, 0.3, 0.6],
    "digits": [0.05, 0.2],
    "ending": [0.5, 1.5],
    "copy": [0.5],
    "repeated": [0.01, 0.3, 0.6],
    "shouts": [0.01, 0.2],
    "place": [0.5, 1.5],
    "length": [3, 5, 8, 12],
    "echo": [0.02, 0.2, 0.4],
}
STARTS = np.cumsum([0] + [len(e) + 1 for e in EDGES.values()])
N_FEATURES = int(STARTS[-1])


@dataclass
class Measures:
    """Counts of each text, and its lines with a word in order."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_text: np.ndarray
    line_chars: np.ndarray
    values: dict[str, np.ndarray]

    def features(self) -> np.ndarray:
        """(lines, groups): the active feature of each group."""
        return np.stack([STARTS[k] + np.searchsorted(e, self.values[g], "right") for k, (g, e) in enumerate(EDGES.items())], axis=1)

    def weak_labels(self) -> np.ndarray:
        """1 for content. Any sign of decoration, shouting, copying or echoed words marks boilerplate."""
        v = self.values
        bad = (v["symbols"] >= 0.2) | (v["upper"] >= 0.6) & (v["words"] >= 3) | (v["shouts"] >= 0.2) | (v["repeated"] >= 0.6) | (v["copy"] > 0) | (v["echo"] >= 0.4)
        return (~bad).astype(np.int64)


def _prefix(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x)])


def measure(texts: Texts) -> Measures:
    data, n = texts.data, len(texts)
    words = words_of(texts)
    text = words.text_of()
    chars = _prefix((data & 0xC0) != 0x80)
    own_chars = _prefix(chars[words.end] - chars[words.start])
    symbols = _prefix(_SYMBOL[data])

    hashes, first = windows(words, WINDOW)
    key = mix64(hashes ^ mix64(text[first].astype(_U) + _U(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(text) + 1, np.int64)
    np.add.at(cover, first[again], 1)
    np.add.at(cover, first[again] + WINDOW, -1)
    repeated = _prefix(np.cumsum(cover[:-1]) > 0)

    echo = np.zeros(len(text), bool)
    echo[1:] = (words.hash[1:] == words.hash[:-1]) & (text[1:] == text[:-1])
    echoes = _prefix(echo)

    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, words.start) + text
    lead = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.empty(0, np.int64)
    stop = np.append(lead[1:], len(line)).astype(np.int64)
    line_text = text[lead]
    at = np.searchsorted(breaks, words.start[lead])
    begin = np.maximum(np.append(breaks, 0)[at - 1] + 1, texts.offsets[line_text]) if len(breaks) else texts.offsets[line_text]
    begin = np.where(at > 0, begin, texts.offsets[line_text])
    end = np.minimum(np.append(breaks, len(data))[at], texts.offsets[line_text + 1])
    line_key = mix64(hashed_spans(data, begin, end) ^ mix64(line_text.astype(_U) + _U(1)))
    copy = np.ones(len(lead), bool)
    copy[np.unique(line_key, return_index=True)[1]] = False

    def per_text(prefix):
        return prefix[words.bounds[1:]] - prefix[words.bounds[:-1]]

    n_lines = stop - lead
    letters, upper, digits = _prefix(_LETTER[data]), _prefix(_UPPER[data]), _prefix(_DIGIT[data])
    shouts = _prefix(data == 33)
    last = data[words.end[stop - 1] - 1] if len(lead) else np.empty(0, np.uint8)
    line_chars = own_chars[stop] - own_chars[lead]
    span = lambda p: p[end] - p[begin]
    edge = np.ones(len(lead))
    if len(lead):
        edge[np.r_[True, line_text[1:] != line_text[:-1]]] = 0
        edge[np.r_[line_text[1:] != line_text[:-1], True]] = 2
    values = {
        "words": n_lines,
        "symbols": span(symbols) / np.maximum(n_lines, 1),
        "upper": span(upper) / np.maximum(span(letters), 1),
        "digits": span(digits) / np.maximum(line_chars, 1),
        "ending": np.where(np.isin(last, list(b".?!")), 2, np.where(np.isin(last, list(b",;:")), 1, 0)),
        "copy": copy.astype(float),
        "repeated": (repeated[stop] - repeated[lead]) / np.maximum(n_lines, 1),
        "shouts": span(shouts) / np.maximum(n_lines, 1),
        "place": edge,
        "length": line_chars / np.maximum(n_lines, 1),
        "echo": (echoes[stop] - echoes[lead]) / np.maximum(n_lines, 1),
    }
    return Measures(
        np.diff(words.bounds), per_text(own_chars), symbols[texts.offsets[1:]] - symbols[texts.offsets[:-1]],
        np.bincount(line_text[copy], minlength=n), per_text(repeated), line_text, line_chars, values,
    )


@dataclass
class Chain:
    """Two-label chain: label 1 is content."""

    emit: np.ndarray  # (features, 2)
    move: np.ndarray  # (2, 2)
    begin: np.ndarray  # (2,)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.emit[features].sum(axis=1)

    def viterbi(self, scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Best labels of the chains ``scores[bounds[i]:bounds[i + 1]]``, all chains one step at a time."""
        labels = np.zeros(len(scores), np.int64)
        length = np.diff(bounds)
        order = np.argsort(-length, kind="stable")
        start, length = bounds[:-1][order], length[order]
        back = np.zeros((len(scores), 2), np.int8)
        best = None
        final = np.zeros((len(order), 2))
        for t in range(int(length.max(initial=0))):
            k = int(np.searchsorted(-length, -t))  # chains longer than t
            at = start[:k] + t
            if t == 0:
                best = scores[at] + self.begin
            else:
                step = best[:k, :, None] + self.move
                back[at] = step.argmax(axis=1)
                best = step.max(axis=1) + scores[at]
            final[:k] = best
        for t in range(int(length.max(initial=0)) - 1, -1, -1):
            k = int(np.searchsorted(-length, -t))
            at = start[:k] + t
            ends = length[:k] == t + 1
            labels[at[ends]] = final[:k][ends].argmax(axis=1)
            on = at[~ends]
            labels[on] = back[on + 1, labels[on + 1]]
        return labels

    def expectations(self, scores: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(label marginals, summed transition marginals, summed first-label marginals) by forward and backward sums."""
        length = np.diff(bounds)
        order = np.argsort(-length, kind="stable")
        start, length = bounds[:-1][order], length[order]
        steps = int(length.max(initial=0))
        forward, backward = np.zeros_like(scores), np.zeros_like(scores)
        for t in range(steps):
            k = int(np.searchsorted(-length, -t))
            at = start[:k] + t
            forward[at] = scores[at] + (self.begin if t == 0 else np.logaddexp.reduce(forward[at - 1][:, :, None] + self.move, axis=1))
        pairs = np.zeros((2, 2))
        total = np.zeros(len(scores))
        for t in range(steps - 1, -1, -1):
            k = int(np.searchsorted(-length, -t))
            at = start[:k] + t
            on = at[length[:k] > t + 1]
            ends = at[length[:k] == t + 1]
            total[ends] = np.logaddexp.reduce(forward[ends], axis=1)
            if len(on):
                ahead = scores[on + 1] + backward[on + 1]
                backward[on] = np.logaddexp.reduce(self.move + ahead[:, None, :], axis=2)
                total[on] = total[on + 1]
                pairs += np.exp(forward[on][:, :, None] + self.move + ahead[:, None, :] - total[on][:, None, None]).sum(axis=0)
        marginal = np.exp(forward + backward - total[:, None])
        return marginal, pairs, marginal[start[length > 0]].sum(axis=0)


def fit_chain(features: np.ndarray, labels: np.ndarray, bounds: np.ndarray, rounds: int = 120, rate: float = 0.2, shrink: float = 1e-3) -> Chain:
    """Adam on the mean conditional log-likelihood."""
    one_hot = np.eye(2)[labels]
    chain = Chain(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2))
    inner = np.ones(len(labels), bool)
    inner[bounds[:-1][np.diff(bounds) > 0]] = False
    follow = np.flatnonzero(inner)
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (labels[follow - 1], labels[follow]), 1)
    seen_first = one_hot[~inner].sum(axis=0)
    n, state = max(len(labels), 1), {}
    for step in range(1, rounds + 1):
        marginal, pairs, begins = chain.expectations(chain.scores(features), bounds)
        gap = one_hot - marginal
        emit = np.stack([sum(np.bincount(features[:, g], gap[:, y], N_FEATURES) for g in range(features.shape[1])) for y in range(2)], axis=1)
        for name, slope in (("emit", emit), ("move", seen_pairs - pairs), ("begin", seen_first - begins)):
            value = getattr(chain, name)
            slope = slope / n - shrink * value
            m, v = state.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            state[name] = (m, v)
            setattr(chain, name, value + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
    return chain


def train_chain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """A chain from the weak labels of at most SAMPLE documents. Without any line, one that calls every line content."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    short = texts.filter((F.octet_length("text") <= SAMPLE_BYTES) & (F.octet_length("text") > 0))
    ids = short.select("id", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(SAMPLE).select("id").distinct()

    def lines(batches):
        for batch in batches:
            for block in text_blocks(text_column(batch, "text")):
                m = measure(block)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m.line_text + block.first, pa.int64()), pa.array(list(m.features()), pa.list_(pa.int64())), pa.array(m.weak_labels())], ["text", "features", "label"]
                )

    rows = short.join(F.broadcast(ids), "id", "left_semi").select("text").mapInArrow(lines, "text long, features array<long>, label long")
    rows = rows.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "*").toPandas().sort_values("at")
    if rows.empty:
        return Chain(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.array([0.0, 1.0]))
    doc = rows["part"].to_numpy(np.int64) << 40 | rows["text"].to_numpy(np.int64)
    bounds = np.append(np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]), len(doc))
    return fit_chain(np.stack(rows["features"].to_numpy()), rows["label"].to_numpy(np.int64), bounds)


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def judge_quality(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` with the counts, ``content_share`` and the verdict (replacing columns of those names).

    Null and blank texts have no words and fail. Each row is judged by itself.
    """
    names = [f.split()[0] for f in RESULT.split(", ")]
    kept = [c for c in docs.columns if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(text_column(batch, "__whole_text")):
                m = measure(block)
                n = len(block)
                bounds = np.searchsorted(m.line_text, np.arange(n + 1))
                label = shared.value.viterbi(shared.value.scores(m.features()), bounds)
                content = np.bincount(m.line_text, m.line_chars * label, n)
                share = content / np.maximum(m.word_chars, 1)
                failed = (m.n_words < 20) | (100 * m.n_repeat_words > 30 * m.n_words)
                rows = batch.slice(block.first, n)
                counts = (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(i) for i in range(len(kept))), *(pa.array(c, pa.int64()) for c in counts), pa.array(failed), pa.array(share), pa.array(~failed & (share >= SHARE))],
                    [*kept, *names],
                )

    frame = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).alias("__whole_text"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name in kept)
    return frame.mapInArrow(run, kinds + RESULT)


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge_quality(docs.select("doc_id", "text"), train_chain(docs)).drop("text")
