"""Near-duplicate classes by Jaccard similarity of word shingles: a size-aware heavy-light join.

Light sets (up to a size chosen by cost) are joined on enumerated fixed-size subsets of
their leading elements; heavy sets scan the inverted lists of their leading elements. The
order behind "leading" puts frequent shingles last, so passages shared by many documents
open no list. A list is first compared with its hub only; pairs that are in one class
already are never formed, and the others pass a bound on their symmetric difference before
their sets are fetched and compared exactly. Equal sets are one element throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ontoweave.llm.base import query, stored, table
from ontoweave.llm.words import mix64, text_blocks, text_column, windows, words_of
from ontoweave.operators.graph import connected_components

SIZE = 5  # words in a shingle
SUBSET = 2  # elements of an enumerated subset
BITS = 512  # of a set's parity bitmap
HEAVY_SHINGLES = 1 << 22  # at most so many shingles are listed as frequent: 32 MB, whatever the input
FEW = 8  # a shingle in fewer documents is never listed as frequent

_U = np.uint64


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of 1 to 4 words is one shingle."""
    for texts in text_blocks(column):
        words = words_of(texts, lower=True)
        hashes, first = windows(words, SIZE)
        at = np.searchsorted(first, words.bounds)
        for i in range(len(texts)):
            lo, hi = words.bounds[i], words.bounds[i + 1]
            if 0 < hi - lo < SIZE:
                yield _whole(words.hash[lo:hi])
            else:
                yield np.unique(hashes[at[i] : at[i + 1]])


def _whole(words: np.ndarray) -> np.ndarray:
    h = _U(len(words))
    for w in words:
        h = mix64(np.array([h ^ w], _U))[0]
    return np.array([h], _U)


def least_overlap(n: Column | int, percent: int) -> Column | int:
    """Elements that a set of ``n`` shares with any partner: ceil(percent * n / 100)."""
    if isinstance(n, int):
        return -(-percent * n // 100)
    return F.ceil(F.lit(percent) * n / 100)


def parity_map(s: np.ndarray, size: int) -> np.ndarray:
    """Bit k is the parity of the number of elements that fall on it; ``size`` is a power of two."""
    return (np.bincount((mix64(s) & _U(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The parity map of ``size`` bits that belongs to a longer one."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def _signatures(batches):
    """Size, 128-bit signature and parity bitmaps of each set: a short one for the JVM, and one that grows with the set."""
    for batch in batches:
        n, a, b, bits, wide = [], [], [], [], []
        for s in shingle_sets(text_column(batch, "text")):
            n.append(len(s))
            a.append(mix64(s).sum(dtype=_U))
            b.append(mix64(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U))
            long_map = parity_map(s, max(BITS, 2 << len(s).bit_length()))
            wide.append(np.packbits(long_map, bitorder="little").tobytes())
            bits.append(np.packbits(folded(long_map, BITS), bitorder="little").view(np.int64))
        maps = pa.ListArray.from_arrays(
            pa.array(np.arange(len(n) + 1, dtype=np.int32) * (BITS // 64)), pa.array(np.concatenate(bits) if bits else np.empty(0, np.int64))
        )
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), _longs(np.array(a, _U)), _longs(np.array(b, _U)), maps, pa.array(wide, pa.binary())],
            ["id", "n", "sig_a", "sig_b", "bits", "wide"],
        )


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _key_blobs(bucket_bits: int):
    """Per bucket the 32-bit keys of all shingles of some documents, sorted."""

    def flush(held):
        keys = np.sort(np.concatenate(held) >> _U(32 - bucket_bits))
        cut = np.searchsorted((keys >> _U(32)).astype(np.int64), np.arange((1 << bucket_bits) + 1))
        low = keys.astype(np.uint32)
        full = np.flatnonzero(np.diff(cut))
        blobs = [low[cut[k] : cut[k + 1]].tobytes() for k in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "keys"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for s in shingle_sets(text_column(batch, "text")):
                held.append(s)
                size += len(s)
                if size >= 1 << 21:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def frequent_shingles(texts: DataFrame, least: int, bucket_bits: int) -> np.ndarray:
    """Sorted keys (the leading 32 + bucket_bits bits) of the shingles that at least ``least`` documents hold."""

    def frequent(key, frame):
        keys, n = np.unique(np.concatenate([np.frombuffer(blob, np.uint32) for blob in frame["keys"]]), return_counts=True)
        return pd.DataFrame({"k": (np.int64(key[0]) << 32) + keys[n >= least].astype(np.int64)})

    blobs = texts.select("text").mapInArrow(_key_blobs(bucket_bits), "bucket long, keys binary")
    found = blobs.groupBy("bucket").applyInPandas(frequent, "k long").toPandas()
    return np.sort(found["k"].to_numpy(np.int64)).astype(_U)


def choose_boundary(sizes: dict[int, int], scan: float, percent: int) -> int:
    """The size up to which subsets are cheaper than lists, from the number of sets of each size.

    A subset costs one row. A list entry costs a row and ``scan`` comparisons.
    """
    best, at, gain = 0.0, 1, 0.0
    for n in sorted(k for k in sizes if 2 <= k <= 200):
        lead = n - least_overlap(n, percent)
        gain += sizes[n] * ((lead + 1) * (1 + scan) - comb(lead + SUBSET, SUBSET))
        if gain > best:
            best, at = gain, n
    return at


def _list_keys(heavy, bucket_bits: int, boundary: int, percent: int):
    """Keys of the lists a set stands in; the last bit tells subsets from single elements."""

    def keys_of(s: np.ndarray) -> np.ndarray:
        n, known = len(s), heavy.value
        lead = n - least_overlap(n, percent)
        if n and len(known):
            key = s >> _U(32 - bucket_bits)
            frequent = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
            s = np.concatenate([s[~frequent], s[frequent]])
        single = s[: lead + 1] if n > 0 and n >= least_overlap(boundary + 1, percent) else s[:0]
        head = s[: lead + SUBSET] if SUBSET <= n <= boundary else s[:0]
        i, j = np.triu_indices(len(head), 1)
        pair = mix64(mix64(np.minimum(head[i], head[j])) ^ (np.maximum(head[i], head[j]) * _U(3)))
        return np.concatenate([single & ~_U(1), pair | _U(1)])

    def run(batches):
        for batch in batches:
            keys = [keys_of(s) for s in shingle_sets(text_column(batch, "text"))]
            offsets = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), _longs(np.concatenate(keys) if keys else np.empty(0, _U)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "keys"])

    return run


def _marks(words: int):
    def run(batches):
        for batch in batches:
            h = mix64(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(_U))
            mask = (_U(1) << (h & _U(63))) | (_U(1) << ((h >> _U(6)) & _U(63)))
            yield pa.RecordBatch.from_arrays([_longs((h >> _U(12)) % _U(words)), _longs(mask)], ["word", "mask"])

    return run


def id_filter(ids: DataFrame) -> np.ndarray:
    """Bloom filter of the ids: 16 bits an id, and at most 2^23 words (64 MB) for any number of them."""
    words = 64
    n = ids.count()
    while words * 4 < n and words < 1 << 23:
        words *= 2
    rows = ids.mapInArrow(_marks(words), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    bits = np.zeros(words, _U)
    bits[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(_U)
    return bits


def _sets(wanted):
    """Sets of the texts whose id may be wanted; the rest is not even cut into words."""

    def run(batches):
        for batch in batches:
            bits = wanted.value
            h = mix64(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(_U))
            mask = (_U(1) << (h & _U(63))) | (_U(1) << ((h >> _U(6)) & _U(63)))
            batch = batch.filter(pa.array((bits[((h >> _U(12)) % _U(len(bits))).astype(np.int64)] & mask) == mask))
            blobs = [s.tobytes() for s in shingle_sets(text_column(batch, "text"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["id", "elements"])

    return run


def _linked(percent: int):
    def run(batches):
        for batch in batches:
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            keep = []
            for x, y in zip(get["set_a"], get["set_b"]):
                x, y = np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([get["src"].filter(mask), get["dst"].filter(mask)], ["src", "dst"])

    return run


def _map_allows(percent: int):
    """Drops pairs whose long bitmaps prove that too many elements differ."""

    def run(batches):
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            keep = []
            for x, y, total in zip(col["wide_src"], col["wide_dst"], (col["n_src"].to_numpy() + col["n_dst"].to_numpy()).tolist()):
                x = np.unpackbits(np.frombuffer(x.as_py(), np.uint8), bitorder="little")
                y = np.unpackbits(np.frombuffer(y.as_py(), np.uint8), bitorder="little")
                size = min(len(x), len(y))
                differing = int((folded(x, size) ^ folded(y, size)).sum())
                keep.append(differing * (100 + percent) <= total * (100 - percent))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([col["src"].filter(mask), col["dst"].filter(mask)], ["src", "dst"])

    return run


def _near_sizes(a: Column, b: Column, percent: int) -> Column:
    return (F.lit(100) * F.least(a, b)) >= (F.lit(percent) * F.greatest(a, b))


def _may_link(n_a: Column, n_b: Column, bits_a: Column, bits_b: Column, percent: int) -> Column:
    """False where the parity bitmaps prove that too many elements differ.

    Sets that link have n_a + n_b - 2 * overlap differing elements with overlap >= percent * (n_a + n_b) / (100 + percent),
    and each bit of the xor-ed bitmaps needs at least one of them.
    """
    differing = sum((F.bit_count(bits_a[k].bitwiseXOR(bits_b[k])) for k in range(BITS // 64)), F.lit(0))
    total = n_a + n_b
    return (differing * (100 + percent)) <= total * (100 - percent)


def _verified(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (src, dst) those that link: by their long bitmaps first, and what passes exactly."""
    src = sigs.select(F.col("id").alias("src"), F.col("n").alias("n_src"), F.col("wide").alias("wide_src"))
    dst = sigs.select(F.col("id").alias("dst"), F.col("n").alias("n_dst"), F.col("wide").alias("wide_dst"))
    pairs = stored(pairs.join(src, "src").join(dst, "dst").mapInArrow(_map_allows(percent), "src long, dst long").distinct(), "possible_pairs")
    ids = pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id"))).distinct()
    wanted = pairs.sparkSession.sparkContext.broadcast(id_filter(ids))
    sets = stored(texts.mapInArrow(_sets(wanted), "id long, elements binary"), "sets")
    wanted.destroy()  # the stored sets are read from here on
    one = sets.select(F.col("id").alias("src"), F.col("elements").alias("set_a"))
    other = sets.select(F.col("id").alias("dst"), F.col("elements").alias("set_b"))
    return pairs.join(one, "src").join(other, "dst").mapInArrow(_linked(percent), "src long, dst long").distinct()


def jaccard_classes(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): classes of texts linked by Jaccard similarity >= percent / 100.

    A null or blank text has an empty set and is linked with nothing. Each row counts:
    a repeated row is returned as often as it stands, and texts that share an id share
    its links. Rows without an id are left out. An empty table gives an empty result.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    sigs = stored(texts.mapInArrow(_signatures, "id long, n long, sig_a long, sig_b long, bits array<long>, wide binary"), "signatures")
    same = ["n", "sig_a", "sig_b"]
    classes = stored(sigs.filter("n > 0").groupBy(*same).agg(F.min("id").alias("rep")), "classes")

    total = sigs.agg(F.sum("n")).first()[0] or 0
    sizes = {r["n"]: r["c"] for r in classes.filter("n <= 200").groupBy("n").agg(F.count("*").alias("c")).collect()}
    least = max(FEW, -(-total // HEAVY_SHINGLES))
    bucket_bits = min(max(10, (total >> 22).bit_length()), 28)
    heavy = spark.sparkContext.broadcast(frequent_shingles(texts, least, bucket_bits))
    boundary = choose_boundary(sizes, least / 4, percent)

    reps = classes.select(F.col("rep").alias("id"), "n")
    lead = texts.mapInArrow(_list_keys(heavy, bucket_bits, boundary, percent), "id long, keys array<long>")
    by_key = Window.partitionBy("key")
    lists = (
        lead.join(reps, "id").select("id", "n", F.explode("keys").alias("key"))
        .withColumn("members", F.count("*").over(by_key)).withColumn("hub", F.min(F.struct("id", "n")).over(by_key))
        .filter("members > 1").drop("members")
    )
    lists = stored(lists, "lists")
    heavy.destroy()  # the stored lists are read from here on
    maps = sigs.select("id", "bits")

    hubs = (
        lists.filter((F.col("id") != F.col("hub.id")) & _near_sizes(F.col("n"), F.col("hub.n"), percent))
        .select(F.col("hub.id").alias("src"), F.col("id").alias("dst"), F.col("hub.n").alias("n_src"), F.col("n").alias("n_dst")).distinct()
    )
    src_bits = maps.select(F.col("id").alias("src"), F.col("bits").alias("bits_src"))
    dst_bits = maps.select(F.col("id").alias("dst"), F.col("bits").alias("bits_dst"))
    possible = _may_link(F.col("n_src"), F.col("n_dst"), F.col("bits_src"), F.col("bits_dst"), percent)
    hubs = stored(hubs.join(src_bits, "src").join(dst_bits, "dst").filter(possible).select("src", "dst"), "hub_pairs")
    first = stored(_verified(hubs, sigs, texts, percent), "hub_links")
    joined = stored(connected_components(first), "hub_classes").select(F.col("node").alias("id"), "component")

    open_lists = (
        lists.drop("hub").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
        .withColumn("low", F.min("component").over(by_key)).withColumn("high", F.max("component").over(by_key))
        .filter("low < high").drop("low", "high")
    )
    open_lists = stored(open_lists.join(maps, "id"), "open_lists")
    a, b = open_lists.alias("a"), open_lists.alias("b")
    subset = F.col("a.key").bitwiseAND(F.lit(1)) == 1
    cross = a.join(
        b,
        (F.col("a.key") == F.col("b.key")) & (F.col("a.component") < F.col("b.component"))
        & (subset | (F.greatest("a.n", "b.n") > boundary)) & _near_sizes(F.col("a.n"), F.col("b.n"), percent)
        & _may_link(F.col("a.n"), F.col("b.n"), F.col("a.bits"), F.col("b.bits"), percent),
    ).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst")).distinct()
    links = first.unionByName(_verified(stored(cross, "cross_pairs"), sigs, texts, percent))
    found = connected_components(stored(links, "links"))
    of_class = (
        classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select(*same, F.coalesce("component", "rep").alias("component_id"))
    )
    return sigs.join(of_class, same, "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )


OP3_SQL = r"""
WITH RECURSIVE texts AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM texts WHERE len(w) > 0)
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), arcs AS MATERIALIZED (SELECT x AS f, y AS t FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS root, doc_id AS node FROM documents
  UNION
  SELECT r.root, a.t FROM reach r JOIN arcs a ON a.f = r.node
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, m.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT root AS doc_id, min(node) AS component_id FROM reach GROUP BY root) m USING (doc_id)
"""


@query("op3_ngram_jaccard_join", OP3_SQL)
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))
