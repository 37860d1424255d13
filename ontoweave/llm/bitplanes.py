"""Token ids in a binary file format of shuffled planes.

A file holds the ids of consecutive documents. Blocks of a fixed number of ids are
transposed into byte planes (or bit planes), each plane is compressed with zstandard, and
an index at the end tells where each plane of each block lies and which ids belong to
which document:

    magic | planes of block 0 | planes of block 1 | ... | index | length of the index | magic

Files are rows of a Parquet table in the shared folder: Spark's commit protocol writes each
exactly once, whichever executors are lost.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ontoweave.llm.base import query, stored, table
from ontoweave.llm.chunks import ChunkEncoder, blocks, kept_in_worker, tokenizer_path

MAGIC = b"OWPLANE1"
BLOCK_IDS = 1 << 16  # ids in a transposed block
FILE_IDS = 1 << 22  # ids after which a file is closed (a longer document stays whole)
LEVEL = 3
KNOWN, KNOWN_CHARS = 5 << 18, 1 << 25  # chunks that a worker remembers, and characters in them
TEXT_BLOCK = 1 << 22  # characters encoded together


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block, lowest first; planes above the highest used one are left out."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max(initial=0)).bit_length()
    if not bits:
        return [raw[:, k].tobytes() for k in range((top + 7) // 8)]
    cells = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(cells[:, k], bitorder="little").tobytes() for k in range(top)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if not bits:
        raw = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            raw[:, k] = np.frombuffer(plane, np.uint8)
    else:
        cells = np.zeros((n, 32), np.uint8)
        for k, plane in enumerate(planes):
            cells[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
        raw = np.packbits(cells, axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4").astype(np.uint32)


def write_file(doc_ids: np.ndarray, bounds: np.ndarray, ids: np.ndarray, bits: bool = False, block_ids: int = BLOCK_IDS) -> bytes:
    """One file: ids of document i are ``ids[bounds[i]:bounds[i + 1]]``."""
    pack = zstandard.ZstdCompressor(level=LEVEL)
    body, at, index = [MAGIC], len(MAGIC), []
    for lo in range(0, len(ids), block_ids):
        block = ids[lo : lo + block_ids]
        planes = [pack.compress(p) for p in to_planes(block, bits)]
        index.append(struct.pack(f"<QIB{len(planes)}I", at, len(block), len(planes), *map(len, planes)))
        body += planes
        at += sum(map(len, planes))
    head = struct.pack("<BQQ", bits, len(index), len(doc_ids)) + b"".join(index)
    tail = pack.compress(head + doc_ids.astype("<i8").tobytes() + bounds.astype("<i8").tobytes())
    return b"".join([*body, tail, struct.pack("<Q", len(tail)), MAGIC])


def read_index(content: bytes) -> tuple[bool, list[tuple[int, int, list[int]]], np.ndarray, np.ndarray]:
    """(bit planes?, (offset, ids, plane lengths) of each block, doc ids, bounds)."""
    if content[: len(MAGIC)] != MAGIC or content[-len(MAGIC) :] != MAGIC:
        raise ValueError("not a plane file, or cut short")
    (n,) = struct.unpack_from("<Q", content, len(content) - 16)
    head = zstandard.ZstdDecompressor().decompress(content[len(content) - 16 - n : -16])
    bits, n_blocks, n_docs = struct.unpack_from("<BQQ", head)
    at, found = struct.calcsize("<BQQ"), []
    for _ in range(n_blocks):
        offset, count, planes = struct.unpack_from("<QIB", head, at)
        at += struct.calcsize("<QIB")
        found.append((offset, count, list(struct.unpack_from(f"<{planes}I", head, at))))
        at += 4 * planes
    doc_ids = np.frombuffer(head, "<i8", n_docs, at)
    return bool(bits), found, doc_ids, np.frombuffer(head, "<i8", n_docs + 1, at + 8 * n_docs)


def read_block(content: bytes, bits: bool, entry: tuple[int, int, list[int]]) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor()
    at, n, lengths = entry
    planes = []
    for length in lengths:
        planes.append(unpack.decompress(content[at : at + length]))
        at += length
    return from_planes(planes, n, bits)


def read_file(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, bounds, ids) of a file."""
    bits, entries, doc_ids, bounds = read_index(content)
    return doc_ids, bounds, np.concatenate([np.empty(0, np.uint32), *(read_block(content, bits, e) for e in entries)])


MARK = "\x7f"  # one token of its own; stands between chunks that the library encodes together
TOGETHER = 64


def _library_encoder(path: str) -> ChunkEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def ids_of(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    (mark,) = ids_of([MARK])[0].tolist()

    def encode_new(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [c if MARK not in c else "" for c in chunks]
        lines = [f" {MARK} ".join(plain[k : k + TOGETHER]) + f" {MARK} " for k in range(0, len(plain), TOGETHER)]
        ids = np.concatenate(ids_of(lines))
        marked = ids == mark
        bounds = np.concatenate([[0], np.cumsum(~marked)[marked]])
        ids = ids[~marked]
        odd = [k for k, c in enumerate(chunks) if MARK in c]
        if odd:  # chunks with the mark itself are encoded alone
            parts = np.split(ids, bounds[1:-1])
            for k, part in zip(odd, ids_of([chunks[k] for k in odd])):
                parts[k] = part
            ids, bounds = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return ids, bounds

    return ChunkEncoder(encode_new, KNOWN, KNOWN_CHARS)


def _write(path: str, end_id: int, bits: bool):
    def run(batches):
        encoder = kept_in_worker("library", path, _library_encoder)
        docs, parts, held, seq = [], [], 0, 0

        def close():
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            content = write_file(np.array(docs, np.int64), bounds, np.concatenate(parts), bits)
            return pa.RecordBatch.from_arrays(
                [pa.array([seq], pa.int64()), pa.array([held], pa.int64()), pa.array([content], pa.binary())], ["seq", "n_ids", "content"]
            )

        for batch in batches:
            for first, texts in blocks(batch.column(1), TEXT_BLOCK):
                ids, bounds = encoder.encode(texts)
                for doc, lo, hi in zip(batch.column(0).slice(first, len(texts)).to_pylist(), bounds[:-1], bounds[1:]):
                    docs.append(doc)
                    parts.append(np.append(ids[lo:hi], np.uint32(end_id)))
                    held += hi - lo + 1
                    if held >= FILE_IDS:
                        yield close()
                        docs, parts, held, seq = [], [], 0, seq + 1
        if docs:
            yield close()

    return run


def write_plane_files(docs: DataFrame, path: str, end_id: int, bits: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, seq, start, n_ids, content): the files of all documents in ascending id order, written to the shared folder.

    ``start`` counts the ids of all files before. Null texts are empty; documents without
    an id are left out; equal ids stand side by side, ordered by their text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = rows.mapInArrow(_write(path, end_id, bits), "seq long, n_ids long, content binary")
    files = stored(files.select(F.spark_partition_id().alias("part"), "*"), "plane_files")
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each partition
    spark, before, starts = docs.sparkSession, 0, []
    for row in parts:
        starts.append((row["part"], before))
        before += row["n"]
    first = spark.createDataFrame(starts, "part int, part_start long")
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    places = (
        files.select("part", "seq", F.coalesce(F.sum("n_ids").over(own), F.lit(0)).alias("earlier")).join(first, "part")
        .select("part", "seq", (F.col("part_start") + F.col("earlier")).alias("start"))
    )
    return files.join(places, ["part", "seq"]).select("part", "seq", "start", "n_ids", "content")


def _read(batches):
    for batch in batches:
        for start, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            docs, bounds, ids = read_file(content.as_py())
            crc = [zlib.crc32(ids[lo:hi].astype("<u4").tobytes()) for lo, hi in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(bounds[:-1] + start, pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_plane_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files' bytes."""
    return files.select("start", "content").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op7_bit_plane_files")
def op7_bit_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_plane_files(write_plane_files(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2))
