"""From documents to token ids: rules, language, near duplicates, mixing, encoding.

Each stage takes all that its predecessor kept; what it returns is written to the shared
folder as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoweave.llm.base import bounded_batches, stored, table
from ontoweave.llm.bpe import encode_documents
from ontoweave.llm.chunks import tokenizer_path
from ontoweave.llm.kneser_ney import held_out, identify, train
from ontoweave.llm.line_crf import judge_quality, train_chain
from ontoweave.llm.mixing import DOMAINS, TARGETS, fit_rates, memberships, mixed_documents, train_domains
from ontoweave.llm.ngram_join import jaccard_classes

ORACLE_SQL = None  # the rules, language models, mixing and encoding have no SQL; tests/llm compares the run with a plain one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with enough content lines stay."""
    bounded_batches(spark)
    return judge_quality(docs, train_chain(docs)).filter("kept").select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the models know stay."""
    bounded_batches(spark)
    labelled = docs.filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text", "lang")
    return identify(docs, train(labelled)).filter("accepted").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text with the smallest id of each class stays, once; documents without an id stay as they are.

    Different texts that share an id are rows of their own, each in its own class.
    """
    bounded_batches(spark)
    rows = docs.filter("doc_id is not null").withColumn("__text", F.xxhash64("text"))
    shared = stored(_keys_of_shared_ids(rows), "shared_ids")
    if shared.isEmpty():
        first = jaccard_classes(docs).filter("doc_id = component_id").select("doc_id").distinct()
        kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    else:
        rows = rows.join(shared, ["doc_id", "__text"], "left").withColumn("__key", F.coalesce("__key", "doc_id"))
        classes = jaccard_classes(rows, id_col="__key").select(F.col("doc_id").alias("__key"), "component_id").distinct()
        known = classes.join(shared, "__key", "left").select(
            "component_id", F.struct(F.coalesce("doc_id", "__key").alias("doc_id"), F.coalesce("__text", F.lit(0)).alias("text"), "__key").alias("row")
        )
        first = known.groupBy("component_id").agg(F.min("row").alias("row")).select("row.__key")
        kept = rows.join(first, "__key", "left_semi").dropDuplicates(["__key"]).select(docs.columns)
    return kept.unionByName(docs.filter("doc_id is null")).select(docs.columns)


def _keys_of_shared_ids(rows: DataFrame) -> DataFrame:
    """(doc_id, __text, __key): a number that is no id for each of the texts that share an id."""
    several = rows.groupBy("doc_id").agg(F.min("__text").alias("low"), F.max("__text").alias("high")).filter("low < high").select("doc_id")
    texts = rows.select("doc_id", "__text").join(several, "doc_id", "left_semi").distinct()
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    key = F.monotonically_increasing_id()
    if high is not None and high >= 1 << 62:
        if low <= -(1 << 62):
            raise ValueError("ids fill the whole range of a long")
        return texts.withColumn("__key", F.lit(low - 1) - key)
    return texts.withColumn("__key", F.lit((high or 0) + 1).cast("long") + key)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or dropped by their fitted rate."""
    bounded_batches(spark)
    model = train_domains(docs, table(spark, sf_dir, "labels"))
    members = stored(memberships(docs, model), "memberships")
    rates = fit_rates(members, np.array([TARGETS[d] for d in DOMAINS]))
    return mixed_documents(docs, model, rates)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens, ids) of each document left."""
    bounded_batches(spark)
    ids = encode_documents(docs.select("doc_id", "source", "lang", "text"), tokenizer_path())
    return ids.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing to target weights", target_mix),
    ("BPE encoding", bpe_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
