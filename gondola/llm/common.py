"""Shared pieces: the shared scratch folder, Arrow text batches, and vectorised word and shingle hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word: space and \t \n \v \f \r.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The same set as a Java regular expression of one word.
WORD_RE = r"[^\x20\x09-\x0D]+"
SHINGLE = 5
SIMILARITY = 0.8

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by Spark's own reader, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the one set on the context. Only where neither is set and Spark runs in one process (tests, bench) a temporary folder is made and set; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gondola-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def deleted(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Paths of the tables that go at the end of the innermost scratch(), in this thread or task of work.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)
#: Paths of the tables that results may still read.
_kept: list[str] = []


def saved(df: DataFrame, name: str, keep: bool = False, spread: tuple[str, ...] = ()) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors, and later reads prune columns. Inside scratch() the table goes when that ends, unless it is to be kept: then it stays until release(). Columns whose values hardly repeat (spread) are written without a dictionary."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**{f"parquet.enable.dictionary#{c}": "false" for c in spread}).parquet(path)
    own = _scratch.get()
    (_kept if keep or own is None else own).append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables saved inside, but for kept ones, are deleted at the end: only what is saved to be kept may be read later."""
    own: list[str] = []
    token = _scratch.set(own)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in own:
            deleted(spark, path)


def release(spark: SparkSession) -> None:
    """Delete all kept tables: for when no result of these operators will be read any more."""
    while _kept:
        deleted(spark, _kept.pop())


def parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of fewer rows, since whole texts may be long: bounds what a Python worker holds unpacked."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def row_place(seed: int, *columns: str) -> Column:
    """A number from 0 to 1 that a hash of the columns gives."""
    return F.pmod(F.xxhash64(*(F.col(c).cast("string") for c in columns), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def window_of(text: str, chars: int, seed: int) -> Column:
    """The column's text, or of longer ones so many characters at a place that a hash of the text gives."""
    start = F.pmod(F.xxhash64(text, F.lit(seed)), F.greatest(F.char_length(text) - chars + 1, F.lit(1))) + 1
    return F.substring(F.col(text), start, F.lit(chars))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_bytes(column) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of an Arrow string column; null is empty."""
    for x in column.cast("large_binary").to_pylist():
        yield x or b""


def pieces(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes in all; one longer text is a range of its own."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD1B54A32D192ED03)
    return h ^ (h >> np.uint64(32))


_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        base = np.full(max(n, 2 * len(_powers), 64), 0x5851F42D4C957F2D, dtype=np.uint64)
        base[0] = 1
        _powers = np.multiply.accumulate(base)
    return _powers


def word_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, byte lengths and first bytes (within their texts) of the words of all texts, and the number of words of each text."""
    raw = LOWER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
    word = ~IS_SPACE[raw]
    edges = np.diff(word.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    lens = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    text = np.searchsorted(np.cumsum(lens), starts, side="right")
    counts = np.bincount(text, minlength=len(texts))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), starts, counts
    size = ends - starts
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first, size)
    value = (raw[word].astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[at]
    return mix64(np.add.reduceat(value, first)), size, starts - (np.cumsum(lens) - lens)[text], counts


def cut_long(text: bytes, limit: int) -> Iterator[bytes]:
    """A text in parts of about limit bytes that end at white space; a longer word stays whole."""
    at = 0
    while len(text) - at > limit:
        end = min((k for k in (text.find(bytes([c]), at + limit) for c in SPACES) if k >= 0), default=len(text))
        yield text[at:end]
        at = end
    yield text[at:]


def word_stream(texts: list[bytes], limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes and byte lengths of the words (letters A-Z lower-cased) of all texts in order, and the number of words of each text. Long texts are hashed in parts, so memory beyond the result is bounded."""
    cuts, of = [], []
    for i, t in enumerate(texts):
        for x in cut_long(t, limit):
            cuts.append(x)
            of.append(i)
    found = [word_places(cuts[lo:hi]) for lo, hi in pieces(cuts, limit)]
    if not found:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    hashes, sizes, _, counts = (np.concatenate(x) for x in zip(*found))
    return hashes, sizes, np.bincount(of, weights=counts, minlength=len(texts)).astype(np.int64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes and counts of word_stream."""
    hashes, _, counts = word_stream(texts)
    return hashes, counts


#: Odd multipliers, one for each place in a shingle.
PLACES = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words within each text, and their number for each text. A text of 1 to n-1 words has one shingle: all its words; one without words has none."""
    out_counts = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    short = np.flatnonzero((counts > 0) & (counts < n))
    first = np.cumsum(counts) - counts
    runs = max(0, len(words) - n + 1)
    full = np.zeros(len(words), dtype=np.uint64)
    for k in range(n):
        full[:runs] += words[k : k + runs] * PLACES[k]
    full = mix64(full)
    keep = np.ones(len(words), dtype=bool)
    if len(words):
        place = np.arange(len(words)) - np.repeat(first, counts)
        keep = place < np.repeat(np.maximum(counts - n + 1, 0), counts)
    for i in short:
        own = words[first[i] : first[i] + counts[i]]
        full[first[i]] = mix64(np.array([np.sum(own * PLACES[: len(own)]) + np.uint64(len(own))], dtype=np.uint64))[0]
        keep[first[i]] = True
    return full[keep], out_counts
