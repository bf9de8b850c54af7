"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, then exact weighted-shingle similarity.

Each benchmark item is fingerprinted in windows of one of a few sizes, the largest of them within SHRINK of the item's
words: at its start and at its end. Every window of such a size in every document gets the 64-bit SimHash
of its word pairs from running sums of bits. Fingerprints are cut into BLOCKS blocks; two that differ in at most RADIUS
bits agree in one block but for RADIUS // BLOCKS bits, so a table of each block's neighbours finds all pairs within the
radius. A pair places the item in the document; there the words are compared with the item's: the weighted Jaccard
similarity of the bags of five-word shingles, each weighing the bytes of its words. A document holds an item if that is
SIMILARITY or more somewhere.

Items go to the tasks in passes of about PASS_BYTES of item text each; the rows of a pass are written to the shared
folder before the items of the next are read, so what the driver holds and sends is bounded for any benchmark.

Defined results:
- null or empty texts and items hold nothing; letters A-Z count as a-z and all white space alike;
- items of one to four words have one shingle: all their words; items of equal texts are each reported;
- texts and items of any length count as a whole; long texts are hashed in parts;
- the row of a document and item is that of the highest similarity, the first place among equals;
- repeated documents each get their rows; null ids stay null; empty tables give no rows; extra columns are ignored by
  `matches` and kept by `clean`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import SHINGLE, SIMILARITY, mix64, parts, pieces, saved, scratch, shingle_hashes, text_bytes, word_stream

RADIUS = 11
BLOCKS = 4
BITS = 64 // BLOCKS
SHRINK = 0.8
RATIO = 1.25
PASS_BYTES = 4 << 20
#: Words whose running sums of bits are in memory at once, besides the overlap of a window.
STRETCH = 8192

_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def window_size(words: int) -> int:
    """The largest size of the ladder 1..8, 10, 12, 15, ... within SHRINK of so many words."""
    most = max(1, math.ceil(SHRINK * words))
    size = min(most, 8)
    while size >= 8 and (bigger := math.floor(size * RATIO)) <= most:
        size = bigger
    return size


def pair_hashes(words: np.ndarray) -> np.ndarray:
    return mix64(words[:-1] * _LEFT + words[1:] * _RIGHT)


class BitSums:
    """Sums of the 64 bits of the pairs' (or words') hashes over windows, put together from sums over powers of two."""

    def __init__(self, words: np.ndarray, single: bool = False):
        hashes = np.ascontiguousarray(words) if single else pair_hashes(words)
        self.doubled = [np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)]

    def over(self, n: int) -> np.ndarray:
        kind = np.uint8 if n < 256 else np.uint32
        at, total = 0, None
        for k in range(n.bit_length()):
            if k == len(self.doubled):
                last = self.doubled[-1] if k < 8 else self.doubled[-1].astype(np.uint32)
                self.doubled.append(last[: -(1 << k - 1)] + last[1 << k - 1 :])
            if n >> k & 1:
                part = self.doubled[k][at : len(self.doubled[0]) - n + 1 + at].astype(kind, copy=False)
                total, at = part if total is None else total + part, at + (1 << k)
        return total


def fingerprints(words: np.ndarray, size: int, sums: BitSums | None = None) -> np.ndarray:
    """SimHash of each window of so many words: of its pairs, or of its only word."""
    n = max(1, size - 1)
    return np.packbits((sums or BitSums(words, size == 1)).over(n) > n // 2, axis=1).view(np.uint64).ravel()


def shingle_bag(words: np.ndarray, sizes: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, their counts, and the weight of one of each: the bytes of its words."""
    own, _ = shingle_hashes(words, np.array([len(words)]), shingle)
    n = min(shingle, len(words))
    total = np.concatenate([[0], np.cumsum(sizes)])
    values, first, counts = np.unique(own, return_index=True, return_counts=True)
    return values, counts, (total[n:] - total[:-n])[first]


def likeness(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = float((np.minimum(a[1][i], b[1][j]) * a[2][i]).sum())
    return common / (float((a[1] * a[2]).sum()) + float((b[1] * b[2]).sum()) - common)


class Index:
    """Items, their windows' fingerprints by size, and for each size and block the windows near each block value."""

    def __init__(self, items: list[tuple[int, bytes]], radius: int = RADIUS, similarity: float = SIMILARITY, shingle: int = SHINGLE):
        self.radius, self.similarity, self.shingle = radius, similarity, shingle
        self.items, windows = [], {}
        words, sizes, counts = word_stream([t for _, t in items])
        ends = np.cumsum(counts)
        for (item_id, _), lo, hi in zip(items, ends - counts, ends):
            n = int(hi - lo)
            if n:
                size, k = window_size(n), len(self.items)
                self.items.append((item_id, n, shingle_bag(words[lo:hi], sizes[lo:hi], shingle)))
                for at in sorted({0, n - size}):
                    windows.setdefault(size, []).append((k, at, fingerprints(words[lo + at : lo + at + size], size)[0]))
        flips = [sum(1 << b for b in c) for r in range(radius // BLOCKS + 1) for c in combinations(range(BITS), r)]
        self.windows = {}
        for size, found in sorted(windows.items()):
            item, at, mark = (np.array(x, dtype=kind) for x, kind in zip(zip(*found), (np.int64, np.int64, np.uint64)))
            tables = []
            for block in range(BLOCKS):
                keys = (mark.view(np.uint16).reshape(-1, BLOCKS)[:, block, None] ^ np.array(flips, dtype=np.uint16)[None, :]).ravel().astype(np.int64)
                order = np.argsort(keys, kind="stable")
                starts = np.searchsorted(keys[order], np.arange((1 << BITS) + 1))
                tables.append((np.diff(starts) > 0, starts, (order // len(flips)).astype(np.int32)))
            self.windows[size] = (item, at, mark, tables)
        self.overlap = max(self.windows, default=1)

    def near(self, marks: np.ndarray, able: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """All (place, window) whose fingerprints differ in at most radius bits, at the able places."""
        _, _, own, tables = self.windows[size]
        place, window, keys = [], [], marks.view(np.uint16).reshape(-1, BLOCKS)
        for block, (some, starts, order) in enumerate(tables):
            key = keys[:, block]
            hit = np.flatnonzero(some[key] & able)
            first = starts[key[hit]]
            n = starts[key[hit].astype(np.int64) + 1] - first
            at = np.repeat(hit, n)
            which = order[np.arange(len(at)) - np.repeat(np.cumsum(n) - n - first, n)]
            near = np.bitwise_count(marks[at] ^ own[which]) <= self.radius
            place.append(at[near])
            window.append(which[near])
        return np.concatenate(place), np.concatenate(window)

    def candidates(self, words: np.ndarray, ends: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Distinct (text of the window that was found, word of the stream where the item would begin, item), given each word's end of text and text."""
        found = [np.zeros((0, 3), dtype=np.int64)]
        for lo in range(0, len(words), STRETCH):
            own = words[lo : lo + STRETCH + self.overlap - 1]
            sums = BitSums(own) if len(own) > 1 else None
            for size, (item, at, _, _) in self.windows.items():
                if len(own) < size:
                    continue
                marks = fingerprints(own, size, None if size == 1 else sums)[:STRETCH]
                starts = lo + np.arange(len(marks))
                place, window = self.near(marks, starts + size <= ends[starts], size)
                if len(place):
                    found.append(np.stack([text[lo + place], lo + place - at[window], item[window]], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def find(self, texts: list[bytes]) -> list[tuple[int, int, float, int, int]]:
        """(text, item id, similarity, first word, words) of each text and item held in it, in order."""
        best: dict[tuple[int, int], tuple] = {}
        if not self.items:
            return []
        for first, last in pieces(texts):
            words, sizes, counts = word_stream(texts[first:last])
            ends = np.cumsum(counts)
            for t, at, k in self.candidates(words, np.repeat(ends, counts), np.repeat(np.arange(len(counts)), counts)).tolist():
                _, n, bag = self.items[k]
                # The item would begin in an earlier text if its first words are cut off.
                begin = int(ends[t] - counts[t])
                lo, hi = max(at, begin), min(at + n, int(ends[t]))
                if hi - lo >= self.similarity * n / 2 and hi > lo:
                    s = likeness(bag, shingle_bag(words[lo:hi], sizes[lo:hi], self.shingle))
                    if s >= self.similarity and s > best.get((first + t, k), (0,))[0]:
                        best[first + t, k] = (s, lo - begin, hi - lo)
        return [(t, self.items[k][0], *v) for (t, k), v in sorted(best.items())]


def passes(items: DataFrame) -> tuple[int, Iterator[list[tuple[int, bytes, int]]]]:
    """The number of passes, and the distinct items of each with their number of rows: about PASS_BYTES of text, dealt by a hash of the id and text. A pass is collected when it is asked for."""
    able = items.where(F.octet_length("text") > 0).select(F.col("item_id").cast("long").alias("item_id"), "text").groupBy("item_id", "text").agg(F.count("*").alias("n"))
    total = able.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / PASS_BYTES))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))

    def groups() -> Iterator[list[tuple[int, bytes, int]]]:
        for k in range(n):
            found = [(r["item_id"], r["text"].encode(), r["n"]) for r in able.where(part == k).collect()]
            yield sorted(found, key=lambda x: (x[0] is None, x))

    return n, groups()


MATCH = "doc_id long, item_id long, similarity double, first_word long, words long"


def matches(docs: DataFrame, items: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """A MATCH row for each row of docs (doc_id, text) and each of items (item_id, text) that it holds."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("words", pa.int64())])
    rows, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    n, groups = passes(items)
    for group in groups:
        found = rows.mapInArrow(_finder(group, radius, similarity, shingle, schema), MATCH)
        found = saved(found, "leaks", keep=True) if n > 1 else found
        out = found if out is None else out.unionByName(found)
    return out


def _finder(group: list[tuple[int, bytes, int]], radius: int, similarity: float, shingle: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index([(k, t) for k, (_, t, _) in enumerate(group)], radius, similarity, shingle)
        for batch in parts(batches):
            ids = batch.column("doc_id").to_pylist()
            found = [(ids[i], group[k][0], *rest) for i, k, *rest in index.find(list(text_bytes(batch.column("text")))) for _ in range(group[k][2])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*found), schema)], schema=schema)

    return run


def _free_of(group: list[tuple[int, bytes, int]], radius: int, similarity: float, shingle: int):
    """A column function: whether a text holds none of these items. The index is built once for a task."""

    @F.pandas_udf("boolean")
    def free(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index([(k, t) for k, (_, t, _) in enumerate(group)], radius, similarity, shingle)
        for t in texts:
            held = {i for i, *_ in index.find([x.encode() if isinstance(x, str) else b"" for x in t])}
            yield pd.Series([i not in held for i in range(len(t))], dtype=bool)

    return free


def clean(docs: DataFrame, items: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs that hold no item, with their columns as they are. What is left after each of several passes is written before the next."""
    n, groups = passes(items)
    with scratch(docs.sparkSession):
        for k, group in enumerate(groups):
            docs = docs.where(_free_of(group, radius, similarity, shingle)(docs["text"]))
            docs = saved(docs, "clean", keep=k == n - 1) if n > 1 else docs
    return docs
