"""Document fingerprints: a quartile bucket digest of hashed byte triplets, compared by a bounded difference score.

Each window of five bytes gives six triplets that hold its first byte; each triplet is hashed to one of 128 buckets. The
digest names for each bucket the quarter of the bucket counts it is in, and the text's length on a logarithmic scale.

Defined results:
- null text is empty; texts of fewer than three bytes have no triplets, so their digest is that of the length and of a
  checksum of the bytes; equal texts have equal digests;
- a null id comes first in order, then by id; rows of equal id are ordered by a hash of the text; the last row's next is
  the first;
- texts of any length are digested whole, in pieces;
- a table of one row is its own next; an empty table gives no rows; extra input columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import parts as slices
from gondola.llm.common import saved

BUCKETS = 128
#: Places of the second and third byte of each triplet in a window that begins with the first.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4))
CHUNK = 1 << 19
#: Bytes of text that a range of ids has on average at most.
RANGE_BYTES = 16 << 20
#: Difference at which two digests count as unlike: likeness 0.
WORST = 160.0

_SALTS = (np.arange(1, 257, dtype=np.uint32) * np.uint32(0x9E3779B1)) ^ np.uint32(0x5BD1E995)
_MIX = [(_SALTS * np.uint32(m)) for m in (0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)]


def bucket_counts(text: bytes) -> np.ndarray:
    """Counts of the hashed triplets of a whole text, in pieces that overlap by a window."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    data = np.frombuffer(text, dtype=np.uint8)
    for at in range(0, max(1, len(data) - 2), CHUNK):
        a, b, c = (m[data[at : at + CHUNK + 4]] for m in _MIX)
        for salt, (j, k) in enumerate(TRIPLETS):
            n = min(CHUNK, len(a) - k)
            if n > 0:
                h = (a[:n] ^ b[j : j + n]) + c[k : k + n] + np.uint32(salt * 0x61C88647 & 0xFFFFFFFF)
                h ^= h >> np.uint32(15)
                total += np.bincount(((h * np.uint32(0x2C1B3C6D)) >> np.uint32(25)), minlength=BUCKETS)
    return total


def fingerprint(text: bytes) -> str:
    """Hex: length (2), counts' quartile ratios (2), checksum of texts without triplets (8), then 2 bits for each bucket (64)."""
    counts = bucket_counts(text)
    length = min(255, round(8 * math.log2(1 + len(text))))
    short = f"{zlib.crc32(text):08x}" if not counts.any() else "0" * 8
    q1, q2, q3 = (int(x) for x in np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]])
    quarter = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    ratios = (16 * q1 // max(q3, 1) & 15) << 4 | (16 * q2 // max(q3, 1) & 15)
    packed = np.packbits(np.unpackbits(quarter[:, None], axis=1)[:, 6:].ravel())
    return f"{length:02x}{ratios:02x}{short}{packed.tobytes().hex()}"


def difference(a: str, b: str) -> float:
    """Sum over buckets of the quarters' distance (far ones count double) plus the lengths' and ratios' distance."""
    x, y = (np.frombuffer(bytes.fromhex(f), dtype=np.uint8) for f in (a, b))
    q, r = (np.packbits(np.unpackbits(z[6:]).reshape(-1, 2), axis=1).ravel() >> 6 for z in (x, y))
    far = np.abs(q.astype(int) - r)
    ends = sum(abs((int(x[1]) >> s & 15) - (int(y[1]) >> s & 15)) for s in (0, 4))
    return float(far.sum() + 3 * (far == 3).sum() + max(0, abs(int(x[0]) - int(y[0])) - 1) + ends // 2 + (WORST if a[4:12] != b[4:12] else 0))


def likeness(a: str, b: str) -> float:
    """1 for equal digests, falling in proportion to their difference, 0 from WORST on."""
    return 1.0 if a == b else max(0.0, 1.0 - difference(a, b) / WORST)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


WALKED = f"part int, kind string, {OUT}, text string"


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row of OUT for each row of docs (doc_id, text).

    Rows are dealt into ranges of ids (rows of one id may be in several) and sorted, so that a task walks its range with
    one row in hand. The first and last row of each range are kept besides; each last one is then joined with the first
    of the next range, which is a row a range.
    """
    spark = docs.sparkSession
    if parts is None:  # as many ranges as the bytes of text ask for
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / RANGE_BYTES))
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("hash"), F.col("row")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    schema = pa.schema([("part", pa.int32()), ("kind", pa.string()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])

    def judged(doc_id, text: str, own: str, following: str, after: str) -> tuple:
        new = edited(text, following).encode()
        of_new = fingerprint(new)
        return doc_id, len(text), hashlib.sha256(new).hexdigest(), own, of_new, likeness(own, of_new), likeness(own, after)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None  # id, text and fingerprint of the row whose next is to come
        edge = lambda kind, row: (part, kind, row[0], None, None, row[2], None, None, None, row[1])
        for found in slices(batches):
            out = []
            for doc_id, text in zip(*(c.to_pylist() for c in found.columns)):
                row = (doc_id, text or "", fingerprint((text or "").encode()))
                out.append((part, "row", *judged(*held, *row[1:]), None) if held else edge("first", row))
                held = row
            if out:
                yield batch(out)
        if held:
            yield batch([edge("last", held)])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in batches:
            out = [judged(*row) for row in zip(*(c.to_pylist() for c in found.columns))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), list(schema)[2:-1])], names=schema.names[2:-1])

    walked = saved(ranged.mapInArrow(walk, WALKED), "digest-rows", keep=True)
    ranges = sorted(r["part"] for r in walked.where("kind = 'last'").select("part").collect())  # a number for each range
    after = spark.createDataFrame(list(zip(ranges, ranges[1:] + ranges[:1])), "part int, next int")
    first = walked.where("kind = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"), F.col("fingerprint").alias("after"))
    last = walked.where("kind = 'last'").select("part", "doc_id", "text", "fingerprint").join(after, "part").join(first, "next")
    ends = last.select("doc_id", "text", "fingerprint", "following", "after").mapInArrow(meet, OUT)
    return walked.where("kind = 'row'").select(*ends.columns).unionByName(ends)
