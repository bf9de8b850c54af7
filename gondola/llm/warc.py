"""WARC records in seekable Zstandard bundles.

A bundle holds independent Zstandard frames of many records each, and ends in the seek table of the public seekable
format (a skippable frame with the compressed and raw size of each frame). The index, a table in the shared folder, maps
each record to bundle, frame and the offset within the frame; a reader fetches the footer and the frames it needs.

Defined results:
- null html is an empty payload; null url an empty Target-URI; null page_id: such a record is never referred to;
- payloads of at least MIN_REVISIT bytes that are equal: the smallest page_id is the response, others revisit it; rows
  that repeat that page_id are responses too; smaller payloads are always responses;
- payloads of any length are one record each; a frame ends with the record that fills it, so it may be longer;
- an empty table gives no bundle and no rows; extra input columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import parts, saved, shared_dir

MIN_REVISIT = 100
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
#: Frames that a task reads back, of archives of so many frames; of larger ones it reads more.
FRAMES_A_TASK, MOST_TASKS = 8, 20_000
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, bundle string, frame int, offset long, length long"
RECORD = "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"


def record_urn(page_id) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}").urn


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_urn(page_id)}>", f"WARC-Date: {DATE}"]
    head.append("WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{record_urn(refers_to)}>", f"X-Refers-To-Page-Id: {refers_to}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].partition(":")[2]
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    number = lambda x: None if x is None else int(x)
    return {"page_id": number(fields.get("X-Page-Id")), "record_type": kind, "refers_to": number(fields.get("X-Refers-To-Page-Id")), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "payload": payload if kind == "response" else None}


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(start, compressed size, raw size) of each frame, from the end of the file."""
    end = file.size()
    file.seek(end - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    file.seek(end - 9 - 8 * count)
    sizes = struct.unpack(f"<{2 * count}I", file.read(8 * count))
    out, at = [], 0
    for k in range(count):
        out.append((at, sizes[2 * k], sizes[2 * k + 1]))
        at += sizes[2 * k]
    return out


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The store and path of a folder; Hadoop's names of the S3 stores mean S3."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an](?=://)", "s3", folder))


class Bundle:
    """A bundle that is being written. Its name is new in each attempt of a task; files of lost attempts are never referred to."""

    def __init__(self, folder: str, level: int):
        store, path = opened(folder)
        store.create_dir(path, recursive=True)
        self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        self.out, self.packer = store.open_output_stream(f"{path}/{self.name}", compression=None), zstandard.ZstdCompressor(level=level)
        self.frames, self.raw, self.ids, self.bytes, self.total = [], [], [], 0, 0

    def add(self, page_id, raw: bytes) -> None:
        self.ids.append((page_id, self.name, len(self.frames), self.bytes, len(raw)))
        self.raw.append(raw)
        self.bytes += len(raw)

    def flush(self) -> list[tuple]:
        if not self.ids:
            return []
        packed = self.packer.compress(b"".join(self.raw))
        self.out.write(packed)
        self.frames.append((len(packed), self.bytes))
        done, self.total = self.ids, self.total + len(packed)
        self.raw, self.ids, self.bytes = [], [], 0
        return done

    def close(self) -> list[tuple]:
        done = self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()
        return done


def assigned(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, digest, refers_to. The first page of each digest is found from ids and digests alone; a digest that many pages share is summed before the shuffle, and the join back can split it."""
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    hashed = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    large = F.octet_length("html") >= min_revisit
    firsts = hashed.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    firsts = saved(firsts, "warc-firsts", keep=True)
    revisits = large & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return hashed.join(firsts, "digest", "left").select("page_id", "url", "html", "digest", F.when(revisits, F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL, folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes the bundles and returns the saved index and the folder. A task holds one frame in memory."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    schema = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])

    def rows(done: list[tuple]) -> Iterator[pa.RecordBatch]:
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*done), schema)], schema=schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in parts(batches, 100):
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                bundle = bundle or Bundle(folder, level)
                bundle.add(page_id, record_bytes(page_id, url, html, digest, refers_to))
                if bundle.bytes >= frame_bytes:
                    yield from rows(bundle.flush())
                    if bundle.total >= bundle_bytes:
                        bundle.close()
                        bundle = None
        if bundle:
            yield from rows(bundle.close())

    return saved(assigned(pages).mapInArrow(write, INDEX), "warc-index", keep=True), folder


def read_warc(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that the index names, each read by its offset in its frame. Rows of a frame come together, so a frame is unpacked once."""
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        name = frame = file = raw = None
        for batch in batches:
            out, size = [], 0
            for bundle, number, offset, length in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length"))):
                if bundle != name:
                    if file:
                        file.close()
                    file, name, frame = store.open_input_file(f"{path}/{bundle}"), bundle, None
                    table = read_seek_table(file)
                if number != frame:
                    start, packed, unpacked = table[number]
                    file.seek(start)
                    raw, frame = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=unpacked), number
                out.append(parse_record(raw[offset : offset + length]))
                size += length
                if not payloads:
                    out[-1]["payload"] = None
                if size > 32 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if file:
            file.close()

    frames = index.groupBy("bundle").agg(F.max("frame").alias("frame")).agg(F.sum(F.col("frame") + 1)).first()[0] or 0
    # The number is given, since the index's own bytes say nothing of what is to be read.
    tasks = max(1, min(MOST_TASKS, math.ceil(frames / FRAMES_A_TASK)))
    return index.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(read, RECORD)


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> first THEN first END AS refers_to
FROM f
"""
