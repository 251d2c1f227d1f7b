"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about ``frame_bytes``; frames follow one another in bundles of
about ``bundle_bytes``. A bundle ends with two skippable frames: an index from record identifiers to (frame, offset within
the frame, length), and the footer seek table of the public Zstandard seekable format. So a plain ``zstd -d`` gives the
plain WARC file, and one record is read by decompressing one frame (``read_record``).

Of the records with equal payloads (of at least ``min_payload`` bytes) the one with the largest page_id is a response
record; the others are revisit records that refer to it and carry no payload, only its digest and length. The groups are
found by partial aggregation on a digest; a payload that a third of all pages share is split by the adaptive skew join.

Bundles get names of their own in every task attempt, and a manifest of those that were committed decides which are read;
files of a lost or repeated attempt are never read. The folder has to be one that driver and executors share.

Defined cases: null html is an empty payload; a null url gives no target URI, a null page_id no page id; in a group with
null page ids only, all records are responses; rows that repeat the largest page_id are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import stored, put_file, shared_dir

FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 8 * 1024 * 1024
MIN_PAYLOAD = 0
# Fixed values of the public Zstandard seekable format.
_SKIP_SEEK, _SEEK_MAGIC, _SKIP_INDEX = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public UUID namespace for URLs


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}:{digest}')}>"


def record(page_id, url: str | None, payload: bytes, refers_to=None, digest: str | None = None, length: int | None = None) -> tuple[str, bytes]:
    """(record id, bytes) of a response, or of a revisit of refers_to with the full payload's digest and length."""
    digest = digest or sha1_base32(payload)
    name, revisit = record_id(page_id, digest), refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if page_id is not None:
        head.append(f"X-Page-Id: {quote(str(page_id))}")  # an id may hold line breaks
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload) if length is None else length}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {quote(str(refers_to))}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    """Collects records and gives the bytes of one bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes, self.frames, self.index, self._open, self._size = frame_bytes, [], {}, [], 0
        self.bytes, self.records = 0, 0

    def add(self, name: str, data: bytes) -> None:
        self.index.setdefault(name, []).append((len(self.frames), self._size, len(data)))
        self._open.append(data)
        self._size += len(data)
        self.records += 1
        if self._size >= self.frame_bytes:
            self._close()

    def _close(self) -> None:
        if self._open:
            packed = zstandard.ZstdCompressor(level=3).compress(b"".join(self._open))
            self.frames.append((packed, self._size))
            self.bytes += len(packed)
            self._open, self._size = [], 0

    def done(self) -> bytes:
        self._close()
        index = zstandard.ZstdCompressor().compress(json.dumps(self.index).encode())
        table = b"".join(struct.pack("<II", len(f), n) for f, n in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, _SEEK_MAGIC)
        skip = lambda magic, body: struct.pack("<II", magic, len(body)) + body
        return b"".join([*(f for f, _ in self.frames), skip(_SKIP_INDEX, index), skip(_SKIP_SEEK, table + footer)])


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of every frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != _SEEK_MAGIC or flags & 0x7C:
        raise ValueError("no seek table")
    wide = 12 if flags & 0x80 else 8
    at, out = len(bundle) - 9 - n * wide, []
    start = 0
    for k in range(n):
        packed, size = struct.unpack_from("<II", bundle, at + k * wide)
        out.append((start, packed, size))
        start += packed
    return out


def read_frame(bundle: bytes, frame: tuple[int, int, int]) -> bytes:
    start, packed, size = frame
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=max(1, size)) if size else b""


def read_record(bundle: bytes, name: str, copy: int = 0) -> bytes:
    """One record by its identifier; decompresses the index and one frame."""
    frames = seek_table(bundle)
    start = sum(f[1] for f in frames)
    magic, size = struct.unpack_from("<II", bundle, start)
    if magic != _SKIP_INDEX:
        raise ValueError("no record index")
    index = json.loads(zstandard.ZstdDecompressor().decompress(bundle[start + 8 : start + 8 + size]))
    frame, offset, length = index[name][copy]
    return read_frame(bundle, frames[frame])[offset : offset + length]


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload without the HTTP head) of each record of plain WARC bytes."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        block = data[stop + 4 : stop + 4 + int(head["Content-Length"])]
        yield head, block[block.index(b"\r\n\r\n") + 4 :]
        at = stop + 8 + len(block)


def roles(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """``page_id, url, payload, refers_to`` of every page; refers_to is null for responses."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("same", F.sha2("payload", 256))
    last = rows.groupBy("same").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null")
    joined = rows.join(last, "same", "left")
    revisit = (F.octet_length("payload") >= min_payload) & F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last")))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("last")).alias("refers_to"))


def write(pages: DataFrame, folder: str, *, min_payload: int = MIN_PAYLOAD, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write the bundles and return their manifest: ``bundle, n_records, n_frames, n_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(bundle: Bundle) -> pa.RecordBatch:
            data, name = bundle.done(), f"{uuid.uuid4().hex}.warc.zst"
            put_file(folder, name, data)
            return pa.record_batch([[name], [bundle.records], [len(bundle.frames)], [len(data)]], schema=pa.schema([("bundle", pa.string()), ("n_records", pa.int64()), ("n_frames", pa.int64()), ("n_bytes", pa.int64())]))

        bundle = Bundle(frame_bytes)
        for batch in batches:
            for k in range(batch.num_rows):
                page, url, payload, last = (batch.column(c)[k].as_py() for c in ("page_id", "url", "payload", "refers_to"))
                bundle.add(*record(page, url, payload, last))
                if bundle.bytes >= bundle_bytes:
                    yield flush(bundle)
                    bundle = Bundle(frame_bytes)
        if bundle.records:
            yield flush(bundle)

    return stored(roles(pages, min_payload).mapInArrow(run, "bundle string, n_records long, n_frames long, n_bytes long"))


def read(manifest: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to`` of every record of the bundles."""
    spark = manifest.sparkSession
    schema = f"page_id {id_type}, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}"
    if manifest.isEmpty():
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_buffer().to_pybytes()
                for frame in seek_table(data):
                    rows = []
                    for head, payload in parse(read_frame(data, frame)):
                        digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                        if kind == "response":
                            if sha1_base32(payload) != digest:
                                raise ValueError(f"digest of {head['WARC-Record-ID']} doesn't hold")
                            n = len(payload)
                        else:
                            payload, n = None, int(head["X-Payload-Length"])
                        page, other = (unquote(x) if x is not None else None for x in (head.get("X-Page-Id"), head.get("X-Refers-To-Page")))
                        rows.append((page, head.get("WARC-Target-URI"), payload, n, digest, kind, other))
                    cols = list(zip(*rows, strict=True))
                    kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
                    yield pa.record_batch([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("bundle"), "content").join(manifest.select("bundle"), "bundle", "left_semi")
    out = files.select("content").mapInArrow(run, "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """The result of op9: write the pages, read the archives back, and report every record."""
    folder = folder or f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    kind = pages.schema["page_id"].dataType.simpleString()
    return read(write(pages, folder, **options), folder, kind).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ROUND_TRIP_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS last FROM p),
b AS (SELECT *, array_to_string([CASE x WHEN '0' THEN '0000' WHEN '1' THEN '0001' WHEN '2' THEN '0010' WHEN '3' THEN '0011' WHEN '4' THEN '0100' WHEN '5' THEN '0101'
  WHEN '6' THEN '0110' WHEN '7' THEN '0111' WHEN '8' THEN '1000' WHEN '9' THEN '1001' WHEN 'a' THEN '1010' WHEN 'b' THEN '1011' WHEN 'c' THEN '1100' WHEN 'd' THEN '1101'
  WHEN 'e' THEN '1110' ELSE '1111' END FOR x IN string_split(hex, '')], '') AS bits FROM h)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(substr(bits, 5 * k + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * k + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * k + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * k + 4, 1) AS INT) + CAST(substr(bits, 5 * k + 5, 1) AS INT), 1)
    FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM b
"""
