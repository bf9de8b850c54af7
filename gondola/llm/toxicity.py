"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is cut into windows of WINDOW words, each of which shares half of its words with the next. A window's logits are
the softmax layer on the mean of its grams' embeddings, so misspellings share most of a known word's vectors; a text
scores as its most toxic window, since a few words in a long text are enough. Labels belong to whole texts, so training
first learns from texts (as many of either class; of long ones from stretches over the whole text) and then, ROUNDS times,
from the windows that the last model finds most toxic in each whole text of any length, of both classes. The texts stay where
they are: tasks look for those windows, and the driver gets no more than a few short ones of each text. A logistic curve over
held-back texts turns the highest window into a probability.

The classifier is fitted on a bounded sample: at most SAMPLE labelled toxic rows and CLEAN times as many others, drawn by
a hash of the row; equal labelled texts of an id count once. Scoring has no such bound.

Defined results:
- null or empty text has one empty window, scored by the bias alone; texts of any length are scored as a whole;
- null labels are not learned from; a doc_id with several labels is learned from once with each;
- of equally toxic windows the first counts; a score equal to the cut is predicted 1;
- without rows of both classes (empty tables, no training rows) every score is 0;
- repeated rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import crc_mod, mix64, parts, pieces, row_place, saved, scratch
from gondola.llm.subword import joined, segment_sums, spread, train

SAMPLE = 1500
CLEAN = 3
#: Stretches of a long text in the first round, and the characters of each.
STRETCHES = 4
STRETCH = 1000
#: Windows of a clean text that teach without being among its most toxic, and the bytes of a window that teach.
OTHERS = 12
WINDOW_BYTES = 1000
BITS = 17
ORDERS = (3, 4, 5)
WINDOW = 6
ROUNDS = 3
CUT = 0.3


def halves(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the half windows in joined texts, at the blank before every WINDOW/2-th word of each text, and each one's text."""
    word = np.flatnonzero((raw[:-1] == 32) & (raw[1:] != 32))
    text = np.searchsorted(starts, word, side="right") - 1
    first = np.searchsorted(text, np.arange(len(starts)))
    nth = np.arange(len(word)) - first[text]
    cut = word[(nth % (WINDOW // 2) == 0) & (nth > 0)]
    every = np.union1d(starts, cut)
    return every, np.searchsorted(starts, every, side="right") - 1


class Model:
    def __init__(self, scores=None, bias=None, slope: float = 1.0, offset: float = 0.0):
        self.scores, self.bias, self.slope, self.offset = scores, bias, slope, offset

    def margins(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each window: the margin, its text, and (in the joined texts, given besides) its start and end."""
        raw, starts = joined(texts)
        cuts, owner = halves(raw, starts)
        total, grams = segment_sums(raw, cuts, self.scores[:, 1:] - self.scores[:, :1], ORDERS, BITS)
        # A window is a half and the next one of its text; a text's last half is a window only if it is the only one.
        pair = np.append(owner[1:] == owner[:-1], False)
        z, n = total[:, 0] + np.where(pair, np.append(total[1:, 0], 0), 0), grams + np.where(pair, np.append(grams[1:], 0), 0)
        alone = np.concatenate([[True], owner[1:] != owner[:-1]]) & ~pair
        ends = np.where(pair, np.append(cuts[2:], [len(raw)] * 2)[: len(cuts)], np.append(cuts[1:], len(raw)))
        use = pair | alone
        return (z / np.maximum(n, 1))[use] + (self.bias[1] - self.bias[0]), owner[use], raw, np.stack([cuts, ends], axis=1)[use]

    def highest(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo, hi in pieces(texts):
            margin, owner, _, _ = self.margins(texts[lo:hi])
            out[lo:hi] = np.maximum.reduceat(margin, np.searchsorted(owner, np.arange(hi - lo)))
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.scores is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.highest(texts) + self.offset, -40, 40)))


def prepared(text: str | None) -> bytes:
    return (text or "").lower().encode()


def sample_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(toxic, text, place) of labelled rows, a little more than the training sample; equal ones count once. Only ids and labels are counted and moved: the ids drawn, about (1 + CLEAN) * sample of any number, are broadcast, and the texts stay where they are."""
    able = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    counts = {r["toxic"]: r["n"] for r in able.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, sample / counts.get(1, 1))).otherwise(min(1.0, CLEAN * sample / counts.get(0, 1)))
    few = able.where(row_place(9, "doc_id") < share)
    both = docs.select("doc_id", "text").where(crc_mod(F.col("doc_id"), 4) != 2).join(F.broadcast(few), "doc_id")
    return both.select("toxic", "text", row_place(10, "doc_id", "text").alias("place")).dropDuplicates(["toxic", "place"])


def bounded(rows: DataFrame, sample: int) -> DataFrame:
    """The first rows of each class by their place, found by numbers alone, so that no task holds the texts of all."""
    ends = {y: rows.where(F.col("toxic") == y).select("place").orderBy("place").limit(n).agg(F.max("place")).first()[0] for y, n in ((1, sample), (0, CLEAN * sample))}
    able = [(F.col("toxic") == y) & (F.col("place") <= end) for y, end in ends.items() if end is not None]
    return rows.where(able[0] | able[1] if len(able) == 2 else able[0] if able else F.lit(False))


def head(text: str) -> Column:
    """A text for the first round: short ones whole, of longer ones STRETCHES stretches, one in each equal part of the text, at a place that a hash gives."""
    size = F.char_length(text)
    part = F.floor(size / STRETCHES).cast("int")
    cut = [F.substring(text, (part * k + F.pmod(F.xxhash64(text, F.lit(11 + k)), F.greatest(part - STRETCH + 1, F.lit(1))) + 1).cast("int"), F.lit(STRETCH)) for k in range(STRETCHES)]
    return F.when(size <= STRETCHES * STRETCH, F.col(text)).otherwise(F.concat_ws(" ", *cut))


def hardest(rows: DataFrame, model: Model, seed: int) -> tuple[list[bytes], list[bytes]]:
    """Windows of whole toxic and of whole clean texts that teach the next model, found where the texts are: of each toxic text its most toxic one, and up to 8 that the model calls toxic; of each clean one its 3 most toxic and about one in 50 others, up to some OTHERS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 50):
            texts = [prepared(t) for t in batch.column("text").to_pylist()]
            y, place = batch.column("toxic").to_numpy(), batch.column("place").to_numpy()
            for lo, hi in pieces(texts):
                margin, owner, raw, spans = model.margins(texts[lo:hi])
                top = np.lexsort((-margin, owner))  # by text, its most toxic window first
                first = np.searchsorted(owner, owner)
                rank, many = np.arange(len(top)) - first, np.bincount(owner)[owner]
                crc = np.array([zlib.crc32(t) for t in texts[lo:hi]], dtype=np.uint64)[owner]
                chance = (mix64((crc << np.uint64(32)) + (top - first).astype(np.uint64) + np.uint64(seed << 24)) >> np.uint64(11)) / float(1 << 53)
                near = np.where(y[lo + owner] == 1, (rank == 0) | ((rank < 8) & (margin[top] > 0)), (rank < 3) | (chance < np.minimum(0.02, OTHERS / many)))
                found = [raw[spans[w, 0] : min(spans[w, 1], spans[w, 0] + WINDOW_BYTES)].tobytes().strip(b" ") for w in top[near]]
                yield pa.RecordBatch.from_arrays([pa.array(y[lo + owner[near]], pa.int32()), pa.array(place[lo + owner[near]]), pa.array(rank[near], pa.int64()), pa.array(found, pa.binary())], names=["toxic", "place", "rank", "window"])

    found = sorted((r["place"], r["rank"], bytes(r["window"]), r["toxic"]) for r in rows.select("toxic", "text", "place").mapInArrow(run, "toxic int, place double, rank long, window binary").collect())
    return [w for _, _, w, y in found if y], [w for _, _, w, y in found if not y]


def peaks(rows: DataFrame, model: Model) -> list[tuple[int, float]]:
    """(toxic, highest margin) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 50):
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(model.highest([prepared(t) for t in batch.column("text").to_pylist()]))], names=["toxic", "margin"])

    return sorted((r["toxic"], r["margin"]) for r in rows.select("toxic", "text").mapInArrow(run, "toxic int, margin double").collect())


def logistic(x: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic regression on one feature: Newton steps with a small ridge."""
    slope, offset = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -40, 40)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - t) * x).sum() + 0.01 * (slope - 1), (p - t).sum() + 0.01 * offset])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, offset = max(slope - move[0], 0.05), offset - move[1]
    return slope, offset


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the sample; a fifth of it is held back for the logistic curve. The driver holds heads and windows of a bounded size, never whole texts."""
    with scratch(docs.sparkSession):
        some = saved(sample_rows(docs, labels, sample), "toxic-some")
        rows = bounded(some, sample).withColumn("held", F.pmod(F.floor(F.col("place") * (1 << 30)), F.lit(5)) == 4)
        heads = sorted((r["place"], prepared(r["head"]), r["toxic"], r["held"]) for r in rows.select("place", "toxic", "held", head("text").alias("head")).collect())
        kept = {y for _, _, y, held in heads if not held}
        if len(kept) < 2:  # too few rows to hold any back
            if len({y for _, _, y, _ in heads}) < 2:
                return Model()
            rows, heads = rows.withColumn("held", F.lit(False)), [(*h[:3], False) for h in heads]
        use = [(t, y) for _, t, y, held in heads if not held]
        most = max(50, sum(y for _, y in use))  # whole texts have many grams: as many clean texts as toxic ones
        first = [(t, 1) for t, y in use if y][:most] + [(t, 0) for t, y in use if not y][:most]
        raw, starts = joined([t for t, _ in first])
        scores, bias = train(*spread(raw, starts, ORDERS, BITS), np.array([y for _, y in first]), 2, BITS, epochs=6, rate=60.0)
        model = Model(scores, bias)
        clean: dict[bytes, None] = {}  # windows of texts that aren't toxic, kept over the rounds
        for k in range(ROUNDS):
            found, more = hardest(rows.where("not held"), model, k)
            clean |= dict.fromkeys(more)
            raw, starts = joined(found + list(clean))
            scores, bias = train(*spread(raw, starts, ORDERS, BITS), np.array([1] * len(found) + [0] * len(clean)), 2, BITS, epochs=6, rate=30.0)
            model = Model(scores, bias)
        held = peaks(rows.where("held"), model)
        if len({y for y, _ in held}) < 2:
            held = peaks(rows.where("not held"), model)
    return Model(scores, bias, *logistic(np.array([x for _, x in held]), np.array([y for y, _ in held])))


def score(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text)."""
    model = model or fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            p = model.score([prepared(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
