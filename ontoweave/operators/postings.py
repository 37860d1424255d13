"""An inverted index kept as tables: postings by term bucket, changed document by document.

A store is a folder of Parquet tables. Every change is a version: the postings, rows and
states of the documents it adds or rewrites, and the ids of those it takes away. A version
counts once its row in ``published`` is written, which happens last, so a change that fails
half way is not seen and is written again under the same number. A row is live unless its
document was taken away by a later version. Postings lie in folders by version and by the
hash of their term: a search reads only the folders of its terms.

    postings   version, bucket | term, row_id, document_id, count, length
    vocabulary version         | term
    rows       version, shelf  | row_id, document_id, and the columns of the rows
    documents  version         | document_id, signature, rows, length
    removed    version         | document_id
    published  version         | rows and words added and taken away
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ontoweave.functions import text as tx
from ontoweave.functions.numeric import computed_once
from ontoweave.operators.reconcile import sync_actions
from ontoweave.operators.retrieval import K1, B, accepted, recall_ranked
from ontoweave.session import cut_lineage

POSTINGS = "version int, bucket int, term string, row_id string, document_id string, count int, length int"
VOCABULARY = "version int, term string"
DOCUMENTS = "version int, document_id string, signature string, rows bigint, length bigint"
REMOVED = "version int, document_id string"
PUBLISHED = "version int, rows bigint, length bigint"
INDEX_TASK_BYTES = 32 << 20  # of row files: what one task turns into postings


def words(text: Column) -> Column:
    """Lower-cased words of a text, in order."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), tx.NON_WORD), "")


def _holds(tokens: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col("term").contains(t.lower()) for t in tokens], F.lit(False))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class PostingStore:
    """Rows of documents with an inverted index over one text of each row.

    ``columns``: DDL of what a row carries beside row_id and document_id, with the indexed
    text among them. Ids are texts. A null text has no words; rows with a null id or a null
    document are refused. Rows that repeat a row_id within a document are one row with the
    words of all. ``buckets`` must be the same for every use of a folder.
    """

    def __init__(self, spark: SparkSession, root: str, columns: str, text: str, buckets: int = 64):
        self.spark, self.root, self.buckets, self.text = spark, root.rstrip("/"), buckets, text
        self.columns = StructType.fromDDL(columns).fieldNames()
        self._schemas = {
            "postings": POSTINGS, "vocabulary": VOCABULARY, "documents": DOCUMENTS, "removed": REMOVED, "published": PUBLISHED,
            "rows": f"version int, shelf int, row_id string, document_id string, {columns}",
        }

    # --- reading ---------------------------------------------------------------------

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def _empty(self, name: str) -> DataFrame:
        fields = StructType.fromDDL(self._schemas[name]).fields
        return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])

    def published(self) -> DataFrame:
        path = f"{self.root}/published"
        if not self._exists(path):
            return self._empty("published")
        return self.spark.read.schema(PUBLISHED).parquet(path)

    def versions(self) -> list[int]:
        """Numbers of the changes made so far (one row each)."""
        return sorted(r["version"] for r in self.published().select("version").collect())

    def _all(self, name: str, versions: list[int]) -> DataFrame:
        """The table over the asked versions, as a scan whose folders are pruned."""
        if not versions:
            return self._empty(name)
        path = f"{self.root}/{name}"
        return self.spark.read.schema(self._schemas[name]).option("basePath", path).parquet(*[f"{path}/version={v}" for v in versions])

    def live(self, name: str, where: Column | None = None) -> DataFrame:
        """Rows of a table whose document no later version took away."""
        versions = self.versions()
        rows = self._all(name, versions)
        if where is not None:
            rows = rows.filter(where)
        if len(versions) < 2:
            return rows
        gone = self._all("removed", versions).groupBy("document_id").agg(F.max("version").alias("_gone"))
        return rows.join(gone, "document_id", "left").filter(F.col("_gone").isNull() | (F.col("_gone") <= F.col("version"))).drop("_gone")

    def postings(self, terms: list[str] | DataFrame) -> DataFrame:
        """Live (term, row_id, document_id, count, length) of the asked terms, read from their folders alone."""
        if isinstance(terms, DataFrame):
            asked = cut_lineage(terms.select("term").distinct())
            found = [r["b"] for r in asked.select(bucket_of(F.col("term"), self.buckets).alias("b")).distinct().collect()]  # at most all buckets
            rows = self.live("postings", F.col("bucket").isin(found)).join(asked, "term", "left_semi")
        else:
            terms = sorted({t.lower() for t in terms})
            found = self.spark.range(1).select(F.array_distinct(F.array(*[bucket_of(F.lit(t), self.buckets) for t in terms]))).first()[0]
            rows = self.live("postings", F.col("bucket").isin(found) & F.col("term").isin(terms))
        return rows.select("term", "row_id", "document_id", "count", "length")

    def terms_containing(self, tokens: list[str]) -> DataFrame:
        """Terms of the vocabulary with any of the tokens inside."""
        return self._all("vocabulary", self.versions()).filter(_holds(tokens)).select("term").distinct()

    def size(self) -> DataFrame:
        """One row: live rows and their words, from the published counts."""
        return self.published().agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"))

    def rows_of(self, ids: DataFrame) -> DataFrame:
        """The live rows with the asked row_id and document_id; only the shelves that hold them are read."""
        asked = cut_lineage(ids.select("row_id", "document_id").distinct())
        shelves = [r["s"] for r in asked.select(bucket_of(F.col("document_id"), self.buckets).alias("s")).distinct().collect()]
        return self.live("rows", F.col("shelf").isin(shelves)).join(asked, ["row_id", "document_id"], "left_semi").drop("version", "shelf")

    def bm25(self, terms: list[str], name: str = "bm25") -> DataFrame:
        """(row_id, document_id, score) of the rows that hold a term: Okapi BM25 as over the whole corpus."""
        found = self.postings(terms)
        return self._scored(self._counted(found, terms), found, terms, name)

    @staticmethod
    def _counted(found: DataFrame, terms: list[str]) -> DataFrame:
        """One row for each row of the postings, with its counts of the terms."""
        own = list(dict.fromkeys(t.lower() for t in terms))
        return found.groupBy("row_id", "document_id").agg(
            F.first("length").alias("length"), *[F.coalesce(F.sum(F.when(F.col("term") == t, F.col("count"))), F.lit(0)).alias(f"_tf_{i}") for i, t in enumerate(own)]
        )

    def _scored(self, per_row: DataFrame, found: DataFrame, terms: list[str], name: str) -> DataFrame:
        """BM25 of counted rows; ``found``: the postings of the terms, which say how many rows hold each."""
        own = list(dict.fromkeys(t.lower() for t in terms))
        times = {t: sum(x.lower() == t for x in terms) for t in own}
        size = self.size().select(F.struct("rows", (F.col("length") / F.col("rows")).alias("mean")).alias("s")).scalar()
        holders = found.agg(F.struct(*[F.count(F.when(F.col("term") == t, 1)).alias(f"df_{i}") for i, t in enumerate(own)])).scalar()
        scored = per_row.withColumn("_s", size).withColumn("_h", holders)
        score = F.lit(0.0)
        for i, t in enumerate(own):
            df, tf = F.col(f"_h.df_{i}"), F.col(f"_tf_{i}")
            raw = F.log((F.col("_s.rows") - df + 0.5) / (df + 0.5))
            weight = F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)
            part = weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("_s.mean")))
            for _ in range(times[t]):
                score = score + part
        return scored.select("row_id", "document_id", score.alias(name))

    def recall(self, query: str, tokens: list[str], anchors: list[str]) -> DataFrame:
        """``retrieval.recall`` over the rows that can match, found by the vocabulary: terms with a token inside, then their postings.

        The rows carry title, path, category, heading and content, and the indexed text joins them with blanks.
        The postings are read once for candidates and counts. A row whose text cannot be accepted is dropped
        where it is read, so only texts that the recall returns are shuffled.
        """
        parts = [w for t in tokens for w in re.findall(r"\w+", t)]
        if not parts:
            raise ValueError("the tokens hold no word")
        folders = self.terms_containing(parts).select(bucket_of(F.col("term"), self.buckets).alias("b")).distinct()
        found = self.live("postings", F.col("bucket").isin([r["b"] for r in folders.collect()]) & _holds(parts))
        candidates = cut_lineage(self._counted(found, tokens))
        scores = self._scored(candidates, self.postings(tokens), tokens, "_bm25")
        shelves = [r["s"] for r in candidates.select(bucket_of(F.col("document_id"), self.buckets).alias("s")).distinct().collect()]
        rows = self.live("rows", F.col("shelf").isin(shelves) & accepted(F.col(self.text), query, tokens)).drop("version", "shelf")
        return recall_ranked(rows.join(scores, ["row_id", "document_id"]).withColumn("_hay", F.col(self.text)), query, tokens, anchors)

    # --- changing --------------------------------------------------------------------

    def _write(self, name: str, version: int, rows: DataFrame, by: str | None = None) -> None:
        """Each task writes its share of every folder, so no row is shuffled for them."""
        out = rows.write.mode("overwrite")
        (out if by is None else out.partitionBy(by)).parquet(f"{self.root}/{name}/version={version}")

    def _counted_words(self, own: DataFrame) -> DataFrame:
        """(term, row_id, document_id, count, length) of stored rows: their texts are dealt by document, their terms stay in the task."""
        size = int(own._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-size // INDEX_TASK_BYTES))
        dealt = own.select("row_id", "document_id", F.col(self.text).alias("_text")).repartition(tasks, "document_id")
        split = computed_once(dealt, _words=words(F.col("_text")))
        terms = split.select("row_id", "document_id", F.size("_words").alias("length"), F.explode("_words").alias("term"))
        return terms.groupBy("term", "row_id", "document_id").agg(F.count("*").cast("int").alias("count"), F.max("length").alias("length"))

    def sync(self, rows: DataFrame) -> DataFrame:
        """Make the store hold exactly ``rows`` (row_id, document_id, columns); (document_id, action) of every document.

        Documents are told apart by a signature over their rows. Only those that are new or
        differ are indexed, and only those that differ or are missing are taken away.
        """
        rows = rows.select(F.col("row_id").cast("string").alias("row_id"), F.col("document_id").cast("string").alias("document_id"), *self.columns)
        carried = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in self.columns]
        mark = F.xxhash64("row_id", *carried).cast("decimal(38,0)")
        signed = cut_lineage(rows.groupBy("document_id").agg(
            F.concat_ws(":", F.count("*"), F.sum(mark), F.sum(F.hash("row_id", *carried).cast("bigint"))).alias("signature"),
            F.count("*").alias("rows"), F.count("row_id").alias("_named"),
        ))
        if not signed.filter(F.col("document_id").isNull() | (F.col("rows") > F.col("_named"))).isEmpty():
            raise ValueError("rows need an id and a document")
        versions = self.versions()
        stored = self.live("documents").select("document_id", "signature", "rows", "length")
        actions = cut_lineage(sync_actions(stored.select("document_id", "signature"), signed, ["document_id"], "signature"))
        fresh = actions.filter(F.col("action").isin("add", "update")).select("document_id")
        gone = actions.filter(F.col("action").isin("update", "delete")).select("document_id")
        if fresh.isEmpty() and gone.isEmpty():
            return actions
        version = max(versions, default=0) + 1

        own = rows.join(fresh, "document_id", "left_semi") if versions else rows  # a new store takes every document
        kept = ["row_id", "document_id", *self.columns]
        self._write("rows", version, own.select(*kept, bucket_of(F.col("document_id"), self.buckets).alias("shelf")), "shelf")
        counted = self._counted_words(self._all("rows", [version]))
        self._write("postings", version, counted.withColumn("bucket", bucket_of(F.col("term"), self.buckets)), "bucket")
        self._write("vocabulary", version, self._all("postings", [version]).select("term").distinct())
        lengths = self._all("postings", [version]).groupBy("document_id").agg(F.sum("count").alias("length"))
        sized = signed.join(fresh, "document_id", "left_semi").join(lengths, "document_id", "left")
        self._write("documents", version, sized.select("document_id", "signature", "rows", F.coalesce("length", F.lit(0)).cast("bigint").alias("length")))
        self._write("removed", version, gone)

        sums = [F.coalesce(F.sum("rows"), F.lit(0)).alias("r"), F.coalesce(F.sum("length"), F.lit(0)).alias("l")]
        added = self._all("documents", [version]).agg(*sums).first()
        lost = stored.join(gone, "document_id", "left_semi").agg(*sums).first()
        change = self.spark.range(1).select(*[F.lit(added[c] - lost[c]).cast("bigint").alias(n) for c, n in (("r", "rows"), ("l", "length"))])
        self._write("published", version, change)
        return actions

    def upsert(self, rows: DataFrame) -> DataFrame:
        """Add the documents of ``rows`` or rewrite them; all others stay."""
        others = self.live("rows").join(rows.select(F.col("document_id").cast("string").alias("document_id")).distinct(), "document_id", "left_anti")
        return self.sync(others.select("row_id", "document_id", *self.columns).unionByName(rows.select("row_id", "document_id", *self.columns)))

    def remove(self, documents: DataFrame) -> DataFrame:
        """Take away the documents (document_id) with their rows and postings."""
        left = self.live("rows").join(documents.select(F.col("document_id").cast("string").alias("document_id")), "document_id", "left_anti")
        return self.sync(left.select("row_id", "document_id", *self.columns))
