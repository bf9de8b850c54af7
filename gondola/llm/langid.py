"""Language ID: averaged hashed subword embeddings with a linear softmax and a calibrated rejection.

The classifier is fitted on a bounded sample of labelled rows (at most SAMPLE, spread evenly over the languages, drawn by
a hash of the row; of longer texts a window of WINDOW characters at a place that a hash gives); every fifth of them is held back to fit the temperature and the rejection threshold, which
lets at most REJECT_RATE of right predictions fall below it. The temperature is fitted on shuffled texts too, which are
of no language: all are as likely there, so the model is not sure of what it never learned.

Defined results:
- null text, or one without a letter: `und` with score 0, and rejected;
- rows whose lang is null are never learned from; no language learned (empty table, no training rows): all rows `und`;
- of equally likely languages the first by code point is predicted; a null id hashes as the empty string;
- repeated rows each get a row; texts of any length count as a whole; extra columns stay in `keep`, whatever their names.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import crc_mod, parts, pieces, row_place, window_of
from gondola.llm.subword import gram_buckets, joined, segment_logits, softmax, spread, train

SAMPLE = 4000
WINDOW = 4000
BITS = 15
ORDERS = (2, 3, 4)
REJECT_RATE = 0.001
UNKNOWN = "und"


def prepared(text: str | None) -> bytes:
    return (text or "").lower().encode()


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def shuffled(data: bytes) -> bytes:
    """The characters of a text in an order that its crc32 gives."""
    text = data.decode()
    return "".join(random.Random(zlib.crc32(data)).sample(text, len(text))).encode()


def sample_rows(docs: DataFrame, sample: int, seed: int = 5) -> DataFrame:
    """Training rows (text, lang) of docs, about sample / languages of each language and at most sample in all."""
    able = docs.where(F.col("lang").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2))
    counts = {r["lang"]: r["n"] for r in able.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    if not counts:
        return able.select("text", "lang")
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / len(counts) / n))])
    some = able.select("lang", (row_place(seed, "doc_id", "text") / share[F.col("lang")]).alias("place"), window_of("text", WINDOW, seed).alias("text"))
    return some.where("place < 1").orderBy("place", "text", "lang").limit(sample).select("text", "lang")


def packed(data: bytes) -> tuple[bytes, bytes, int]:
    """The distinct buckets of a window's grams (as steps from one to the next), how often each is there, both compressed, and the number of all grams."""
    raw, starts = joined([data])
    _, b, s = spread(raw, starts, ORDERS, BITS)
    total = sum(int((gram_buckets(raw, n, BITS) < 1 << BITS).sum()) for n in ORDERS)
    pack = zstandard.ZstdCompressor(level=3).compress
    return pack(np.diff(b, prepend=0).astype(np.uint16).tobytes()), pack(np.rint(s.astype(np.float64) * total).astype(np.uint16).tobytes()), total


def numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint16)


def buckets_of(row: tuple) -> np.ndarray:
    return np.cumsum(numbers(row[1]), dtype=np.uint16)


def sparse(part: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, buckets and shares of rows (lang, *packed)."""
    buckets = [buckets_of(r) for r in part]
    at = np.repeat(np.arange(len(part), dtype=np.int32), list(map(len, buckets)))
    buckets = np.concatenate(buckets).astype(np.int32)
    return at, buckets, np.concatenate([(numbers(r[2]) / np.float64(r[3])).astype(np.float32) for r in part])


class Model:
    """Collapsed scores, bias, temperature and threshold; small and of fixed size, so tasks get a copy."""

    def __init__(self, langs: list[str], scores, bias, temperature: float = 1.0, threshold: float = 0.0):
        self.langs, self.scores, self.bias, self.temperature, self.threshold = langs, scores, bias, temperature, threshold

    def logits(self, texts: list[bytes]) -> np.ndarray:
        raw, starts = joined(texts)
        return segment_logits(raw, starts, self.scores, ORDERS, BITS) + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
        able = [i for i, t in enumerate(texts) if self.langs and has_letter(t)]
        data = [prepared(texts[i]) for i in able]
        for lo, hi in pieces(data):
            p = softmax(self.logits(data[lo:hi]) / self.temperature)
            for i, k, s in zip(able[lo:hi], p.argmax(1), p.max(1)):
                names[i], best[i] = self.langs[k], s
        return names, best


def fit(docs: DataFrame, sample: int = SAMPLE, reject_rate: float = REJECT_RATE) -> Model:
    """Features of the sample are made on the executors; the driver gets their sparse rows."""

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts, langs = (batch.column(c).to_pylist() for c in ("text", "lang"))
            out = []
            for text, lang in zip(texts, langs):
                if has_letter(text):
                    data = prepared(text)
                    for own, label in ((data, lang), (shuffled(data), None)):
                        if label is not None or zlib.crc32(data) % 5 == 0:
                            out.append((label, *packed(own)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.binary(), pa.binary(), pa.int32()))], names=["lang", "buckets", "counts", "grams"])

    found = list(map(tuple, sample_rows(docs, sample).mapInArrow(featurise, "lang string, buckets binary, counts binary, grams int").collect()))
    rows, junk = sorted((r for r in found if r[0] is not None), key=lambda r: (r[0], buckets_of(r).tobytes(), numbers(r[2]).tobytes())), [r for r in found if r[0] is None]
    del found
    if not rows:
        return Model([], None, None)
    rows = [rows[i] for i in np.random.default_rng(3).permutation(len(rows))]
    langs = sorted({r[0] for r in rows})
    labels = np.array([langs.index(r[0]) for r in rows])
    held = len(rows) // 5 if len(rows) >= 50 else 0

    scores, bias = train(*sparse(rows[held:]), labels[held:], len(langs), BITS)
    model = Model(langs, scores, bias)
    if held:

        def logits(part):
            r, b, s = sparse(part)
            return np.stack([np.bincount(r, weights=scores[b, k] * s, minlength=len(part)) for k in range(len(langs))], axis=1) + bias

        z, none = logits(rows[:held]), logits(junk) if junk else np.zeros((1, len(langs)))
        loss = lambda t: -np.log(softmax(z / t)[np.arange(held), labels[:held]] + 1e-12).mean() - np.log(softmax(none / t) + 1e-12).mean()
        model.temperature = min(np.geomspace(0.05, 20, 61), key=loss)
        p = softmax(z / model.temperature)
        right = p.max(1)[p.argmax(1) == labels[:held]]
        model.threshold = float(np.quantile(right, reject_rate, method="lower")) if len(right) else 0.0
    return model


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of each row of docs (doc_id, text, lang)."""
    model = model or fit(docs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            names, best = model.predict(batch.column("text").to_pylist())
            rejected = [n == UNKNOWN or s < model.threshold for n, s in zip(names, best)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(best), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long"), (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs that are not rejected, with their columns as they are."""
    model = model or fit(docs)

    @F.pandas_udf("boolean")
    def able(texts: pd.Series) -> pd.Series:
        names, best = model.predict([t if isinstance(t, str) else None for t in texts])
        return pd.Series([n != UNKNOWN and s >= model.threshold for n, s in zip(names, best)], dtype=bool)

    return docs.where(able(docs["text"]))
