"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames, each frame is compressed by itself, and a bundle ends in a
seek table: a skippable frame with the compressed and the whole size of every frame, in the
public seekable format. One record is read by decompressing one frame:

    frame 0 | frame 1 | ... | skippable frame (sizes of each frame, number of frames, magic)

The index maps a record's identifier to its bundle, frame, offset in the frame and length.
A bundle is one row of a Parquet table in the shared folder, so Spark's commit protocol
writes each exactly once; ``export_bundles`` turns the rows into files.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoweave.llm.base import query, stored, table

# Fixed values of the seekable format and of WARC.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FRAME_BYTES = 1 << 18  # a frame is closed once it holds this much; a longer record is a frame of its own
BUNDLE_BYTES = 1 << 23  # a bundle is closed once its compressed frames hold this much
LEAST_PAYLOAD = 100  # bytes from which equal payloads are stored once
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"  # the pages carry no date

BUNDLE = "bundle string, content binary, records array<struct<record_id:string,frame:int,offset:int,length:int>>"


def record_id(page_id: int | None, digest: str) -> str:
    """A UUID (version 8) that carries the page's id and the start of its payload's digest."""
    code = f"{(page_id or 0) & (1 << 64) - 1:016x}"
    return f"<urn:uuid:{code[:8]}-{code[8:12]}-8{code[12:15]}-{'9' if page_id is None else '8'}{code[15]}00-{digest[:12]}>"


def page_of(identifier: str) -> int | None:
    """The page's id in a record's identifier."""
    a, b, c, d, _ = identifier[len("<urn:uuid:") : -1].split("-")
    code = int(a + b + c[1:] + d[1], 16)
    return None if d[0] == "9" else code - (code >> 63 << 64)


def _header_value(text: str | None) -> str:
    """A header's value ends with its line: line ends inside it are written as their percent codes."""
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", text or "")


def write_record(page_id: int | None, url: str | None, digest: str, n_bytes: int, payload: bytes | None, first: int | None) -> tuple[str, bytes]:
    """(identifier, bytes) of a response, or of a revisit of page ``first`` when ``payload`` is None."""
    own = record_id(page_id, digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: {own}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_header_value(url)}"] if url is not None else []),
        *([] if payload is not None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first, digest)}"]),
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + len(payload or b'')}",
    ]
    return own, b"".join(["\r\n".join(lines).encode(), b"\r\n\r\n", http, payload or b"", b"\r\n\r\n"])


def _headers(data: bytes, at: int) -> tuple[dict[str, str], int]:
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    return {"": lines[0], **{k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}}, end + 4


def read_record(data: bytes, at: int = 0) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """(WARC headers, HTTP headers, body, where the next record starts)."""
    head, start = _headers(data, at)
    if not head[""].startswith("WARC/"):
        raise ValueError("not a WARC record")
    end = start + int(head["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    http, body = _headers(data, start)
    return head, http, data[body:end], end + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer: (compressed, whole) bytes of each frame."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames_of(content: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed, whole bytes) of each frame, from the footer."""
    n, flags, magic = struct.unpack_from("<IBI", content, len(content) - 9)
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle, or cut short")
    size = 8 + 4 * bool(flags & 128)
    start = len(content) - 9 - n * size
    kind, length = struct.unpack_from("<II", content, start - 8)
    if kind != SKIPPABLE or length != n * size + 9:
        raise ValueError("the seek table does not fit its frame")
    found, at = [], 0
    for k in range(n):
        packed, whole = struct.unpack_from("<II", content, start + k * size)
        found.append((at, packed, whole))
        at += packed
    return found


def read_frame(content: bytes, frame: tuple[int, int, int]) -> bytes:
    at, packed, whole = frame
    return zstandard.ZstdDecompressor().decompress(content[at : at + packed], max_output_size=whole)


class _Bundle:
    def __init__(self):
        self.frames, self.sizes, self.records, self.open, self.held, self.size = [], [], [], [], 0, 0
        self._pack = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, identifier: str, record: bytes) -> None:
        self.records.append((identifier, len(self.frames), self.held, len(record)))
        self.open.append(record)
        self.held += len(record)
        if self.held >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            frame = self._pack.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.held))
            self.size += len(frame)
            self.open, self.held = [], 0

    def content(self) -> bytes:
        self.close_frame()
        return b"".join([*self.frames, seek_table(self.sizes)])


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bundles of a task's rows (page_id, url, digest, n_bytes, html or null, first)."""
    part, seq, bundle = TaskContext.get().partitionId(), 0, _Bundle()

    def close() -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))
        records = [dict(zip(("record_id", "frame", "offset", "length"), r)) for r in bundle.records]
        return pa.RecordBatch.from_arrays(
            [pa.array([f"bundle-{part:06d}-{seq:06d}.warc.zst"]), pa.array([bundle.content()], pa.binary()), pa.array([records], kind)],
            ["bundle", "content", "records"],
        )

    for batch in batches:
        small = [batch.column(k).to_pylist() for k in (0, 1, 2, 3, 5)]
        for page_id, url, digest, n_bytes, first, html in zip(*small, batch.column(4)):
            text = html.as_py()
            bundle.add(*write_record(page_id, url, digest, n_bytes, None if text is None else text.encode(), first))
            if bundle.size >= BUNDLE_BYTES:
                yield close()
                seq, bundle = seq + 1, _Bundle()
    if bundle.records:
        yield close()


def write_bundles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(bundle, content, records): the archives of all pages, written to the shared folder.

    A null html is an empty payload. Of equal payloads of ``LEAST_PAYLOAD`` bytes or more the
    page with the smallest id is a response and the others are revisits of it; a page without
    an id comes after all others. Rows that repeat the smallest id with the same payload are
    responses too, under one identifier. Shorter payloads are always responses. A null URL
    leaves out its header. Records of 2 GB and more do not fit a row and fail.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    payload = F.encode("html", "UTF-8")
    rows = rows.withColumn("digest", F.sha2(payload, 256)).withColumn("n_bytes", F.octet_length(payload).cast("long"))
    # copies are counted by digest before any payload moves: only digests of several rows are met again below
    several = (
        rows.filter(F.col("n_bytes") >= LEAST_PAYLOAD).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first", F.lit(True).alias("again"))
    )
    marked = rows.join(several, "digest", "left").select(
        "page_id", "url", "digest", "n_bytes",
        F.when(F.col("again") & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("html")).alias("html"), "first",
    )
    return stored(marked.mapInArrow(_write, BUNDLE), "warc_bundles")


def record_index(bundles: DataFrame) -> DataFrame:
    """(record_id, bundle, frame, offset, length) of every record."""
    return bundles.select("bundle", F.explode("records").alias("r")).select("r.record_id", "bundle", "r.frame", "r.offset", "r.length")


def _rows(records: list[tuple[dict, dict, bytes]]) -> pa.RecordBatch:
    pages, sizes, digests, kinds, refers = [], [], [], [], []
    for head, http, body in records:
        response = head["warc-type"] == "response"
        pages.append(page_of(head["warc-record-id"]))
        sizes.append(len(body) if response else int(http["content-length"]))
        digests.append(hashlib.sha256(body).hexdigest() if response else head["warc-payload-digest"].removeprefix("sha256:"))
        kinds.append(head["warc-type"])
        refers.append(None if response else page_of(head["warc-refers-to"]))
    return pa.RecordBatch.from_arrays(
        [pa.array(pages, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(kinds, pa.string()), pa.array(refers, pa.int64())],
        ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            content = content.as_py()
            for frame in frames_of(content):
                data, at, found = read_frame(content, frame), 0, []
                while at < len(data):
                    *record, at = read_record(data, at)
                    found.append(record)
                yield _rows(found)


def read_bundles(bundles: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, from the bundles' bytes.

    Size and digest of a response are taken from its payload, those of a revisit from its headers.
    """
    return bundles.select("content").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
            content = content.as_py()
            frames, data, last = frames_of(content), b"", -1
            for w in sorted(wanted, key=lambda w: (w["frame"], w["offset"])):
                if w["frame"] != last:
                    data, last = read_frame(content, frames[w["frame"]]), w["frame"]
                record = data[w["offset"] : w["offset"] + w["length"]]
                head, _, body, _ = read_record(record)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w["record_id"]]), pa.array([head["warc-type"]]), pa.array([head.get("warc-target-uri")], pa.string()), pa.array([body], pa.binary())],
                    ["record_id", "record_type", "url", "payload"],
                )


def fetch_records(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """(record_id, record_type, url, payload) of the records whose ``record_id`` is asked for.

    Only the frames that hold them are decompressed; the payload of a revisit is empty.
    Identifiers that no bundle holds give no row.
    """
    asked = wanted.select("record_id").distinct()
    places = record_index(bundles).join(asked, "record_id").dropDuplicates(["record_id"])
    needed = places.groupBy("bundle").agg(F.collect_list(F.struct("record_id", "frame", "offset", "length")).alias("wanted"))  # at most a bundle's records
    return bundles.select("bundle", "content").join(needed, "bundle").select("content", "wanted").mapInArrow(
        _fetch, "record_id string, record_type string, url string, payload binary"
    )


def export_bundles(bundles: DataFrame, folder: str) -> None:
    """Each bundle as a file of its name in ``folder``, a path that all executors have mounted."""

    def save(rows):
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            path = os.path.join(folder, row["bundle"])
            with open(f"{path}.{TaskContext.get().taskAttemptId()}", "wb") as f:
                f.write(row["content"])
            os.replace(f.name, path)  # a task that runs twice leaves one whole file

    bundles.select("bundle", "content").foreachPartition(save)


OP13_SQL = f"""
WITH rows AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT payload_digest, min(page_id) AS first FROM rows WHERE payload_bytes >= {LEAST_PAYLOAD} GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_PAYLOAD} AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_PAYLOAD} AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM rows LEFT JOIN firsts USING (payload_digest)
"""


@query("op13_warc_bundles", OP13_SQL)
def op13_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_bundles(write_bundles(table(spark, sf_dir, "pages")))
