"""Mixing to target weights with soft membership.

A classifier trained on the labelled documents gives every document a posterior over
domains. Distributed least squares then finds a nonnegative rate for each document so that
the expected tokens of each domain match their targets: of all such rates those nearest to
one. Such a rate is max(0, 1 - mass . g) with one vector g for all documents, which Newton
steps find. Each pass over the documents sums up, for a few lengths of the step, the tokens
of the domains and the second moments of the documents whose rate is still positive.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoweave.llm.base import query, stored, table
from ontoweave.llm.hashed import Softmax, Sparse, fit_softmax, joined, word_features
from ontoweave.llm.words import text_blocks, text_column

SAMPLE = 4000  # labelled documents the classifier is trained on at most, by the hash of their id
SAMPLE_BYTES = 100_000
DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.85, "low": 0.1, "toxic": 0.05}
ROUNDS = 40  # Newton steps at most with one damping; a fit that needs more of them fails
CLOSE = 1e-4  # of the total: the gap of a domain, or the distance from the least gap, at which the steps stop
DAMPINGS = (1e-8, 1e-10, 1e-12)  # of the trace of the moments, the next where the last leaves the least gap open
LENGTHS = 0.25 ** np.arange(16)  # of a step, tried in one pass


def domain_of(quality: Column, toxic: Column) -> Column:
    """Index in DOMAINS of a labelled document, null where it is not labelled."""
    return F.when(toxic == 1, 2).when(quality == 0, 1).when(quality == 1, 0)


def _features(batches):
    for batch in batches:
        domains = np.array(batch.column(batch.schema.get_field_index("domain")).to_pylist(), np.int64)
        for block in text_blocks(text_column(batch, "text")):
            sparse, _ = word_features(block)
            lists = pa.ListArray.from_arrays(pa.array(sparse.bounds, pa.int32()), pa.array(sparse.ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([lists, pa.array(domains[block.first : block.first + len(block)])], ["ids", "domain"])


def train_domains(docs: DataFrame, labels: DataFrame) -> Softmax:
    """Classifier of (doc_id, text) by the labels (doc_id, quality, toxic); without any labelled text, a uniform one."""
    known = labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain")).dropna().dropDuplicates(["doc_id"])
    texts = docs.select("doc_id", "text").filter((F.octet_length("text") <= SAMPLE_BYTES) & F.col("doc_id").isNotNull())
    ids = texts.select("doc_id").join(known, "doc_id").select("doc_id", "domain", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(SAMPLE)
    ids = ids.select("doc_id", "domain").distinct()
    rows = texts.join(F.broadcast(ids), "doc_id").select("text", "domain").mapInArrow(_features, "ids array<int>, domain long").toPandas()
    if rows.empty:
        return Softmax(np.zeros((1 << 16, len(DOMAINS))), np.zeros(len(DOMAINS)))
    features = joined([Sparse(np.asarray(x, np.int64), np.array([0, len(x)])) for x in rows["ids"]])
    return fit_softmax(features, np.eye(len(DOMAINS))[rows["domain"].to_numpy(np.int64)])


def memberships(docs: DataFrame, model: Softmax, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, p): words of the whole text and domain posteriors of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for block in text_blocks(text_column(batch, "text")):
                sparse, n_words = word_features(block)
                p = shared.value.posteriors(sparse)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                rows = batch.slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n_words, pa.int64()), lists], ["doc_id", "n_tokens", "p"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, p array<double>")


@dataclass
class Rates:
    """Step vectors g: the rate of a document with mass a starts at 1 and becomes max(0, rate - a . g) at each."""

    steps: list[np.ndarray]
    scale: float  # of the masses, so that sums stay near one
    gap: np.ndarray | None = None  # share of each domain less its target; above CLOSE only where no rates come nearer

    def of(self, n_tokens: np.ndarray, p: np.ndarray) -> np.ndarray:
        mass = p * (n_tokens / self.scale)[:, None]
        rate = np.ones(len(mass))
        for step in self.steps:
            rate = np.maximum(0, rate - mass @ step)
        return rate


def _arrays(batch) -> tuple[np.ndarray, np.ndarray]:
    n = batch.column(batch.schema.get_field_index("n_tokens")).to_numpy(zero_copy_only=False).astype(np.float64)
    flat = batch.column(batch.schema.get_field_index("p")).flatten().to_numpy(zero_copy_only=False)
    return n, flat.reshape(len(n), -1)


@dataclass
class Look:
    """Sums over the documents at one point g."""

    tokens: np.ndarray  # of each domain
    squares: float  # of the rates
    moments: np.ndarray  # mass mass' of documents with a positive rate
    edge: float  # least cosine of a document's posteriors with g


def _looks(members: DataFrame, scale: float, points: np.ndarray) -> list[Look]:
    """The sums at each point, from one pass."""
    n_points, k = points.shape
    norms = np.linalg.norm(points, axis=1)
    norms[norms == 0] = 1

    def run(batches):
        sums, edges = np.zeros((n_points, k + 1 + k * k)), np.ones(n_points)
        for batch in batches:
            n, p = _arrays(batch)
            n, p = n[n > 0], p[n > 0]
            if not len(n):
                continue
            mass = p * (n / scale)[:, None]
            for i, point in enumerate(points):
                rate = np.maximum(0, 1 - mass @ point)
                left = mass[rate > 0]
                sums[i] += np.concatenate([rate @ mass, [rate @ rate], (left.T @ left).ravel()])
                edges[i] = min(edges[i], ((p @ point) / np.linalg.norm(p, axis=1)).min() / norms[i])
        x = np.concatenate([sums.ravel(), edges])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(x)], ["i", "x"])

    rows = members.select("n_tokens", "p").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x"), F.min("x").alias("low")).orderBy("i").collect()
    sums = np.array([r["x"] for r in rows[:-n_points]]).reshape(n_points, -1)
    edges = [r["low"] for r in rows[-n_points:]]
    return [Look(x[:k], x[k], x[k + 1 :].reshape(k, k), edge) for x, edge in zip(sums, edges)]


def _least_gap(edge: float, point: np.ndarray, targets: np.ndarray) -> float:
    """A length that the gap of no nonnegative rates falls below.

    With u along g and every mass at least ``edge`` times its length along u, the domains'
    tokens x have x . u >= min(edge, 0) sum(x), so x cannot come near targets far on the other side.
    """
    length = np.linalg.norm(point)
    if not length:
        return 0.0
    short = max(0.0, -edge)
    return float(max(0.0, -(targets @ point) / length - short * targets.sum()) / (1 + short * np.sqrt(len(targets))))


def fit_rates(members: DataFrame, targets: np.ndarray) -> Rates:
    """Rates whose expected domain tokens are the shares ``targets`` of all tokens, as near as nonnegative rates come.

    Ends when every gap is within CLOSE, or when the gap is proved to be within CLOSE of the
    least one; otherwise it raises. ``gap`` of the result is what is left.
    """
    total = float(members.agg(F.sum("n_tokens")).first()[0] or 0)
    if not total:
        return Rates([], 1.0)
    point = np.zeros(len(targets))
    look = _looks(members, total, point[None])[0]
    size = np.trace(look.moments)
    for damping in DAMPINGS:
        soft = damping * size

        def height(at: np.ndarray, seen: Look) -> float:
            return seen.squares / 2 + targets @ at + soft * (at @ at) / 2

        for _ in range(ROUNDS):
            gap = look.tokens - targets
            slope = soft * point - gap
            if np.abs(gap).max() <= CLOSE or np.linalg.norm(gap) - _least_gap(look.edge, point, targets) <= CLOSE:
                if np.abs(gap).max() > CLOSE:
                    warnings.warn(f"no rates meet the targets: gap {gap.tolist()} of all tokens", stacklevel=2)
                return Rates([point], total, gap)
            if np.abs(slope).max() <= CLOSE / 1000:
                break
            step = np.linalg.solve(look.moments + soft * np.eye(len(point)), -slope)
            points = point + LENGTHS[:, None] * step
            looks = _looks(members, total, points)
            heights = np.array([height(x, seen) for x, seen in zip(points, looks)])
            now = height(point, look)
            best = 0 if heights[0] <= now + 1e-4 * (slope @ step) + 1e-13 * abs(now) else int(heights.argmin())
            point, look = points[best], looks[best]
    raise RuntimeError(f"rates not fitted after {ROUNDS} steps with each damping: gap {(look.tokens - targets).tolist()} of all tokens")


def _luck(id_: Column) -> Column:
    """A number in [0, 1) that only the id decides."""
    return F.pmod(F.xxhash64(id_), F.lit(1 << 30)) / F.lit(float(1 << 30))


def with_rates(members: DataFrame, rates: Rates, domains: tuple[str, ...] = DOMAINS) -> DataFrame:
    """(doc_id, n_tokens, domain, p_<domain>, rate, copies): ``copies`` is the rate rounded up or down by a hash of the id."""

    def run(batches):
        for batch in batches:
            n, p = _arrays(batch)
            rate = rates.of(n, p)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(p.argmax(axis=1), pa.int32()), pa.array(rate)], ["doc_id", "n_tokens", "p", "best", "rate"]
            )

    found = members.mapInArrow(run, "doc_id long, n_tokens long, p array<double>, best int, rate double")
    names = F.array(*[F.lit(d) for d in domains])
    return found.select(
        "doc_id", "n_tokens", F.get(names, "best").alias("domain"), *[F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(domains)], "rate",
        F.floor(F.col("rate") + _luck(F.col("doc_id"))).alias("copies"),
    )


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """(doc_id, n_tokens, domain, p_.., rate, copies) of every row.

    A token is a word here. Null and blank texts have no tokens, keep the rate 1 and weigh
    nothing; a null id is rounded like any other. Repeated rows count each time.
    """
    members = stored(memberships(docs, train_domains(docs, labels)), "memberships")
    return with_rates(members, fit_rates(members, np.array([targets[d] for d in DOMAINS])))


def mixed_documents(docs: DataFrame, model: Softmax, rates: Rates, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in their columns, each as often as its rounded rate says; one with rate 0 goes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches):
        for batch in batches:
            for block in text_blocks(text_column(batch, "__whole_text")):
                sparse, n_words = word_features(block)
                rows = batch.slice(block.first, len(block))
                luck = rows.column(len(columns)).to_numpy(zero_copy_only=False)
                copies = np.floor(rates.of(n_words, shared.value.posteriors(sparse)) + luck).astype(np.int64)
                yield rows.select(columns).take(pa.array(np.repeat(np.arange(len(block)), copies)))

    frame = docs.select("*", _luck(F.col(id_col)).alias("__luck"), F.col(text_col).alias("__whole_text"))
    return frame.mapInArrow(run, docs.schema)


@query("op4_mixing_target_weights")
def op4_mixing_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
