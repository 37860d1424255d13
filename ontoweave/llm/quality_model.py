"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document. Expectation
maximisation over the counts of all vote patterns of the corpus estimates how each
labeller votes on good and on bad documents; the posterior labels it gives then train a
hashed linear scorer, which rates every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoweave.llm.base import query, table
from ontoweave.llm.hashed import Softmax, Sparse, fit_softmax, joined, word_features
from ontoweave.llm.line_crf import measure
from ontoweave.llm.words import Texts, text_blocks, text_column

SAMPLE = 3000  # documents the scorer is trained on at most, by the hash of their id
SAMPLE_BYTES = 100_000
TRUST = 1e-3  # a labeller calls at most this share of good documents bad
NONE, BAD, GOOD = 0, 1, 2


def votes(texts: Texts) -> np.ndarray:
    """(texts, labellers): what each labeller says. Texts without words get bad votes only from the length labeller."""
    m = measure(texts)
    n = np.maximum(m.n_words, 1)

    def mean(name):  # of a line value, weighted by the words of the line
        weight = m.values["words"]
        return np.bincount(m.line_text, m.values[name] * weight, len(texts)) / n

    def two_sided(x, good, bad):
        return np.where(x <= good, GOOD, np.where(x >= bad, BAD, NONE))

    short = np.where(m.n_words < 20, BAD, np.where(m.n_words >= 60, GOOD, NONE))
    length = m.word_chars / n
    rules = [
        two_sided(m.n_symbols / n, 0.02, 0.15),
        two_sided(mean("upper"), 0.25, 0.5),
        two_sided(m.n_repeat_words / n, 0.1, 0.3),
        two_sided(mean("echo"), 0.03, 0.2),
        two_sided(mean("shouts"), 0.02, 0.2),
        two_sided(m.n_dup_lines / np.maximum(np.bincount(m.line_text, minlength=len(texts)), 1), 0.05, 0.3),
        np.where((length >= 2.5) & (length <= 9), GOOD, np.where((length < 2) | (length > 14), BAD, NONE)),
    ]
    empty = m.n_words == 0
    return np.stack([np.where(empty, NONE, r) for r in rules] + [short], axis=1)


LABELLERS = 8


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def unpack(code: np.ndarray) -> np.ndarray:
    return code[:, None] // 3 ** np.arange(LABELLERS) % 3


@dataclass
class LabelModel:
    prior: np.ndarray  # of bad and good
    say: np.ndarray  # (2, labellers, 3): how often each vote is given on bad and good documents

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of good, for each row of votes."""
        z = np.log(self.prior) + sum(np.log(self.say[:, k, v[:, k]]).T for k in range(v.shape[1]))
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -700, 700)))


def fit_labels(v: np.ndarray, n: np.ndarray, rounds: int = 100) -> LabelModel:
    """EM from: any bad vote makes a document bad. ``n``: documents with each row of votes.

    Each kind of junk is seen by one labeller only, so the share of good documents that a
    labeller may call bad is bounded (TRUST); without it a lone bad vote would be outvoted.
    """
    good, bad = (v == GOOD).sum(axis=1), (v == BAD).sum(axis=1)
    p = np.where(bad > 0, 0.05, np.where(good > 0, 0.95, 0.5))
    model = LabelModel(np.array([0.5, 0.5]), np.full((2, v.shape[1], 3), 1 / 3))
    for _ in range(rounds):
        mass = np.stack([(1 - p) * n, p * n])
        model.prior = (mass.sum(axis=1) + 1) / (n.sum() + 2)
        for k in range(v.shape[1]):
            for y in range(2):
                model.say[y, k] = np.bincount(v[:, k], mass[y], 3) + 0.1
        model.say /= model.say.sum(axis=2, keepdims=True)
        model.say[1, :, BAD] = np.minimum(model.say[1, :, BAD], TRUST)
        before, p = p, model.posterior(v)
        if np.abs(p - before).max(initial=0) < 1e-6:
            break
    return model


def _vote_counts(batches):
    for batch in batches:
        for block in text_blocks(text_column(batch, "text")):
            code, n = np.unique(pattern(votes(block)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])


def _sampled(labels: LabelModel):
    def run(batches):
        for batch in batches:
            for block in text_blocks(text_column(batch, "text")):
                sparse, _ = word_features(block)
                lists = pa.ListArray.from_arrays(pa.array(sparse.bounds, pa.int32()), pa.array(sparse.ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([lists, pa.array(labels.posterior(votes(block)))], ["ids", "good"])

    return run


def train_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[LabelModel, Softmax]:
    """(label model from the votes on all documents, scorer from at most SAMPLE of them)."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = texts.mapInArrow(_vote_counts, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toPandas()
    labels = fit_labels(unpack(counts["code"].to_numpy(np.int64)), counts["n"].to_numpy(np.float64))  # at most 3^8 patterns
    short = texts.filter((F.octet_length("text") <= SAMPLE_BYTES) & F.col("id").isNotNull())
    ids = short.select("id", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(SAMPLE).select("id").distinct()
    rows = short.join(F.broadcast(ids), "id", "left_semi").mapInArrow(_sampled(labels), "ids array<int>, good double").toPandas()
    parts = [np.asarray(x, np.int64) for x in rows["ids"]]
    features = joined([Sparse(x, np.array([0, len(x)])) for x in parts])
    good = rows["good"].to_numpy(np.float64)
    if not len(good):
        return labels, Softmax(np.zeros((1 << 16, 2)), np.zeros(2))
    return labels, fit_softmax(features, np.stack([1 - good, good], axis=1))


def rate_quality(docs: DataFrame, labels: LabelModel, scorer: Softmax, text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` with ``weak_good`` (posterior of the votes), ``score`` and ``kept`` (replacing columns of those names).

    Null and blank texts score 0 and are not kept. Each row is rated by itself.
    """
    names = ["weak_good", "score", "kept"]
    kept = [c for c in docs.columns if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast((labels, scorer))

    def run(batches):
        own_labels, own_scorer = shared.value
        for batch in batches:
            for block in text_blocks(text_column(batch, "__whole_text")):
                sparse, n_words = word_features(block)
                good = np.where(n_words > 0, own_scorer.posteriors(sparse)[:, 1], 0.0)
                rows = batch.slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(i) for i in range(len(kept))), pa.array(own_labels.posterior(votes(block))), pa.array(good), pa.array(good >= 0.5)], [*kept, *names]
                )

    frame = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).alias("__whole_text"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name in kept)
    return frame.mapInArrow(run, kinds + "weak_good double, score double, kept boolean")


@query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rate_quality(docs, *train_quality(docs)).drop("text")
