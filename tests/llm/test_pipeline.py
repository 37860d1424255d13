"""The pipeline's rows against plain versions of its stages."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ontoweave.llm import kneser_ney, line_crf, mixing
from ontoweave.llm.chunks import tokenizer_path
from tests.llm.test_operators import plain_classes

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = line_crf.judge_quality(docs, line_crf.train_chain(docs)).filter("kept").select(docs.columns)
    labelled = good.filter("crc32(cast(doc_id as string)) % 4 <> 2").select(F.col("doc_id").alias("id"), "text", "lang")
    known = kneser_ney.identify(good, kneser_ney.train(labelled)).filter("accepted")
    texts = {r["doc_id"]: r["text"] for r in known.select("doc_id", "text").collect()}
    first = {i for i, (_, root) in plain_classes(texts).items() if i == root}
    left = good.filter(F.col("doc_id").isin(list(first)))
    mixed = mixing.mix(left, spark.read.parquet(f"{SF}/labels.parquet")).select("doc_id", "copies").collect()
    want = Counter({r["doc_id"]: r["copies"] for r in mixed if r["copies"] > 0})

    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in rows) == want
    library = Tokenizer.from_file(tokenizer_path())
    for r in rows:
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
    assert 0 < len(first) < len(texts) <= docs.count()


def test_stages_take_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], docs.schema)
    for frame in (docs.limit(30).unionByName(odd), docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= 2 * frame.count(), name
    assert np.array([len(corpus_pipeline.STAGES)]) == 5


def test_different_texts_of_one_id_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    one, other, third = (" ".join(f"{w}{i}" for i in range(60)) for w in ("apple", "brick", "cloud"))
    rows = [(5, one, "en", "s", len(one)), (5, other, "en", "s", len(other)), (5, one, "en", "s", len(one)), (7, other, "en", "s", len(other)), (8, third, "en", "s", len(third))]
    frame = spark.createDataFrame(rows, docs.schema)
    kept = corpus_pipeline.near_duplicates(spark, frame, SF)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(5, one), (5, other), (8, third)]
