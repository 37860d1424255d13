"""The posting store: pruned reads, changes of single documents, and failures half way."""

import re

import pytest
from pyspark.sql import functions as F

from ontoweave.operators import retrieval
from ontoweave.operators.postings import PostingStore

TEXTS = {"a": "red apple, red brick", "b": "Apple pie", "c": "brick wall", "d": None, "e": "apple apple apple wall"}


def rows(spark, texts):
    return spark.createDataFrame([(k, k, v) for k, v in texts.items()], "row_id string, document_id string, text string")


def same_scores(spark, store, texts, terms):
    whole = retrieval.bm25(rows(spark, texts), "text", terms).filter("bm25 > 0")
    want = {r["row_id"]: round(r["bm25"], 9) for r in whole.collect()}
    return {r["row_id"]: round(r["bm25"], 9) for r in store.bm25(terms).collect()} == want


def test_store_follows_its_documents(spark, tmp_path):
    store = PostingStore(spark, f"file://{tmp_path}/s", "text string", "text", buckets=8)
    assert store.bm25(["apple"]).count() == 0
    assert {r["action"] for r in store.sync(rows(spark, TEXTS)).collect()} == {"add"}
    assert same_scores(spark, store, TEXTS, ["apple", "wall"])
    assert {r["action"] for r in store.sync(rows(spark, TEXTS)).collect()} == {"keep"} and store.versions() == [1]

    changed = {"a": "green pear", "b": "Apple pie", "d": "apple", "e": "apple apple apple wall", "f": "a wall of apple"}
    got = {r["document_id"]: r["action"] for r in store.sync(rows(spark, changed)).collect()}
    assert got == {"a": "update", "b": "keep", "c": "delete", "d": "update", "e": "keep", "f": "add"}
    written = spark.read.parquet(f"file://{tmp_path}/s/postings/version=2").select("document_id").distinct()
    assert {r["document_id"] for r in written.collect()} == {"a", "d", "f"}  # only what changed is indexed again
    for terms in (["apple", "wall"], ["red"], ["brick", "pear", "apple"]):
        assert same_scores(spark, store, changed, terms)

    store.remove(spark.createDataFrame([("e",)], "document_id string"))
    store.upsert(rows(spark, {"g": "wall wall", "b": "pie"}))
    now = {k: v for k, v in changed.items() if k != "e"} | {"g": "wall wall", "b": "pie"}
    assert same_scores(spark, store, now, ["apple", "wall", "pie"])
    assert {r["row_id"]: r["text"] for r in store.live("rows").collect()} == now
    with pytest.raises(ValueError):
        store.sync(rows(spark, {None: "x"}))


def test_searches_read_only_the_folders_of_their_terms(spark, tmp_path):
    store = PostingStore(spark, f"file://{tmp_path}/s", "text string", "text", buckets=32)
    store.sync(rows(spark, {f"d{i}": " ".join(f"w{i * 7 % 211 + j}" for j in range(40)) for i in range(80)}))
    asked = store.postings(["w3", "w100"])
    plan = asked._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and re.search(r"ReadSchema: struct<term", plan)
    used = asked.select(F.input_file_name().alias("f")).distinct().collect()
    assert 1 <= len({re.search(r"bucket=(\d+)", r["f"])[1] for r in used}) <= 2
    assert {r["term"] for r in asked.collect()} == {"w3", "w100"}


def test_a_change_that_failed_is_not_seen(spark, tmp_path, monkeypatch):
    store = PostingStore(spark, f"file://{tmp_path}/s", "text string", "text", buckets=4)
    store.sync(rows(spark, TEXTS))
    write = PostingStore._write

    def failing(self, name, *more, **named):
        if name == "published":
            raise OSError("lost")
        return write(self, name, *more, **named)

    monkeypatch.setattr(PostingStore, "_write", failing)
    with pytest.raises(OSError):
        store.sync(rows(spark, {"z": "apple"}))
    assert same_scores(spark, store, TEXTS, ["apple", "wall"])
    monkeypatch.undo()
    store.sync(rows(spark, {"z": "apple", "a": TEXTS["a"]}))
    assert store.versions() == [1, 2] and same_scores(spark, store, {"z": "apple", "a": TEXTS["a"]}, ["apple", "red"])


CHUNK = "title string, path string, category string, heading string, content string, hay string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_dealt_once_and_postings_not_at_all(spark, tmp_path, monkeypatch):
    plans, write = {}, PostingStore._write

    def seen(self, name, version, rows, by=None):
        plans.setdefault((name, version), plan_of(rows))
        return write(self, name, version, rows, by)

    monkeypatch.setattr(PostingStore, "_write", seen)
    store = PostingStore(spark, f"file://{tmp_path}/s", "text string", "text", buckets=4)
    store.sync(rows(spark, TEXTS))
    store.sync(rows(spark, TEXTS | {"a": "green pear"}))
    assert "Exchange" not in plans["rows", 1] and "left_semi" not in plans["rows", 1].lower()
    for version in (1, 2):  # terms are counted where the texts of a document lie
        assert re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", re.sub(r"#\d+", "", plans["postings", version])) == ["document_id"]
    assert same_scores(spark, store, TEXTS | {"a": "green pear"}, ["apple", "pear"])


def test_repeated_rows_are_one_row_with_the_words_of_all(spark, tmp_path):
    store = PostingStore(spark, f"file://{tmp_path}/s", "text string", "text", buckets=4)
    twice = [("1", "a", "Red_apple, \u00c4pfel"), ("1", "a", "\u00e4pfel 7!"), ("2", "a", None), ("3", "b", " -- ")]
    store.sync(spark.createDataFrame(twice, "row_id string, document_id string, text string").repartition(4))
    got = {(r["term"], r["row_id"], r["document_id"]): r["count"] for r in store.live("postings").collect()}
    assert got == {("red_apple", "1", "a"): 1, ("\u00e4pfel", "1", "a"): 2, ("7", "1", "a"): 1}
    sizes = {r["document_id"]: (r["rows"], r["length"]) for r in store.live("documents").collect()}
    assert sizes == {"a": (3, 4), "b": (1, 0)}


def test_recall_shuffles_only_texts_it_can_return(spark, tmp_path):
    texts = ["the motion of water", "The motion", "the thation", "thation then", "calm water", None]
    data = spark.createDataFrame(
        [(f"d{i}#1", f"d{i}", f"t{i}", "p", "c", "", t) for i, t in enumerate(texts)],
        "row_id string, document_id string, title string, path string, category string, heading string, content string",
    ).withColumn("hay", F.concat_ws(" ", "title", "path", "category", "heading", "content"))
    store = PostingStore(spark, f"file://{tmp_path}/s", CHUNK, "hay", buckets=4)
    store.sync(data)
    for query, tokens in (("the thation", ["the", "thation"]), ("water", ["water"]), ("the motion", ["the", "motion", "water"])):
        found = store.recall(query, tokens, tokens)
        want = retrieval.recall(data.withColumnRenamed("row_id", "chunk_id"), query, tokens, tokens)
        key = lambda r: (r[0], round(r["score"], 9), r["recall_sources"])
        got = {key(r) for r in found.select("row_id", "score", "recall_sources").collect()}
        assert got and got == {key(r) for r in want.select("chunk_id", "score", "recall_sources").collect()}
    scan = [x for x in plan_of(found).split("FileScan") if "/rows/" in x or "hay" in x]
    assert scan and all("Contains(hay" in x or "Contains(hay#" in x or "StringContains(hay" in x for x in scan)
