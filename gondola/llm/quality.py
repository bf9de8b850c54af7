"""Quality classifier: a weak-label model over overlapping heuristic labellers teaches a hashed linear scorer.

Labellers vote good (1), bad (0) or nothing (-1) on each whole text. Only the counts of vote patterns over all texts,
added up by Spark (a row for each pattern: at most 3 to the number of labellers), reach the driver, where
expectation-maximisation finds each labeller's rates of each vote on good and bad texts and the share of good ones. The
posteriors, as they are, are the targets of a logistic scorer over hashed byte grams and hashed text statistics, which
all whole texts train: they are dealt by a hash of the row into shards of about SHARD_ROWS, each shard trains a scorer of
its own, and the mean of their margins, by their texts, is the scorer. The threshold is
set so that at most LOSS of all texts that the votes hold for good (posterior of at least SURE) fall below it,
and is never above a half: a text that the scorer holds for good is not rejected.

Defined results:
- null, empty or all-space text: score 0, rejected; repeated rows each get a row and count each;
- a score equal to the threshold is kept; null ids are kept or rejected as any other;
- no text at all: every row is rejected; the labels table is not used;
- texts of any length count as a whole; extra columns stay in `keep`, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import parts, pieces, row_place, saved
from gondola.llm.subword import joined, segment_logits, spread, train

SHARD_ROWS = 16_000
#: Texts of a shard times rounds, and the most features that a shard holds at once.
TAUGHT, FEATURES = 32_000, 12 << 20
#: Margins times texts are added up in whole steps, so that sums don't depend on their order.
MARGIN_STEPS = 1 << 20
#: The threshold is a whole number of such steps.
SCORE_STEPS = 1 << 16
BITS = 15
ORDERS = (1, 2, 3)
LOSS = 0.002
SURE = 0.95
#: (name, bad beyond, good within) of the statistics below, each a share of words or lines; the order is that of the votes.
LABELLERS = (
    ("upper", 0.30, 0.05),
    ("symbols", 0.30, 0.05),
    ("repeats", 0.12, 0.03),
    ("stale_pairs", 0.40, 0.15),
    ("same_lines", 0.50, 0.20),
    ("odd_words", 0.30, 0.10),
    ("open_lines", 0.80, 0.40),
    ("non_letters", 0.25, 0.12),
)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#$%&*|!<>{}=\\^~")] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def statistics(text: str) -> tuple[float, ...] | None:
    words = text.split()
    n = len(words)
    if not n:
        return None
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    dense = max(1, len(data) - int(_BLANK[data].sum()))
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    pairs = len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 1.0
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    return (
        sum(map(str.isupper, words)) / n,
        min(1.0, int(_SYMBOL[data].sum()) / n),
        sum(map(eq, words, words[1:])) / n,
        1 - pairs,
        1 - len(set(lines)) / len(lines),
        float(((lengths > 16) | (lengths < 2)).mean()),
        sum(not x.endswith((".", "!", "?", '"', "”", "…")) for x in lines) / len(lines),
        1 - int(_LETTER[data].sum()) / dense,
    )


def votes(stats: tuple[float, ...] | None) -> str:
    """One letter for each labeller: g, b or -."""
    if stats is None:
        return "b" * len(LABELLERS)
    return "".join("b" if x > bad else "g" if x <= good else "-" for x, (_, bad, good) in zip(stats, LABELLERS))


def stat_buckets(stats: tuple[float, ...] | None) -> list[int]:
    """Hashed features of the statistics, each in ten steps."""
    return [(k * 11 + int(10 * x)) * 0x9E3779B1 % (1 << BITS) for k, x in enumerate(stats)] if stats else []


class LabelModel:
    """Naive Bayes over votes, fitted by expectation-maximisation on pattern counts."""

    def __init__(self, patterns: dict[str, int], rounds: int = 100):
        keys = sorted(patterns)
        code = np.array([["gb-".index(c) for c in k] for k in keys], dtype=np.int64).reshape(len(keys), len(LABELLERS))
        n = np.array([patterns[k] for k in keys], dtype=np.float64)
        good = np.where((code == 0).sum(1) - 2 * (code == 1).sum(1) > 0, 0.9, 0.1) if len(keys) else np.zeros(0)
        self.prior, self.rates = 0.5, np.full((2, code.shape[1], 3), 1 / 3)
        for _ in range(rounds if len(keys) else 0):
            for y, w in ((1, good), (0, 1 - good)):
                for j in range(code.shape[1]):
                    c = np.bincount(code[:, j], weights=w * n, minlength=3) + 1.0
                    self.rates[y, j] = c / c.sum()
            self.prior = float(np.clip((good * n).sum() / n.sum(), 0.01, 0.99))
            new = self._good(code)
            if np.abs(new - good).max() < 1e-7:
                break
            good = new

    def _good(self, code: np.ndarray) -> np.ndarray:
        z = np.log(self.prior / (1 - self.prior)) + sum(np.log(self.rates[1, j, code[:, j]] / self.rates[0, j, code[:, j]]) for j in range(code.shape[1]))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def posterior(self, pattern: str) -> float:
        return float(self._good(np.array([["gb-".index(c) for c in pattern]]))[0])

    def accuracies(self) -> dict[str, float]:
        """Share of right votes among the votes of each labeller."""
        good, bad = self.prior * self.rates[1], (1 - self.prior) * self.rates[0]
        right, wrong = good[:, 0] + bad[:, 1], good[:, 1] + bad[:, 0]
        return {name: float(r / (r + w)) for (name, _, _), r, w in zip(LABELLERS, right, wrong)}


class Model:
    def __init__(self, labels: LabelModel | None = None, scores=None, bias=None, threshold: float = 0.5):
        self.labels, self.scores, self.bias, self.threshold = labels, scores, bias, threshold

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and posteriors of the votes."""
        out, post = np.zeros(len(texts)), np.zeros(len(texts))
        if self.scores is None:
            return out, post
        stats = [statistics(t or "") for t in texts]
        known: dict[str, float] = {}
        data = [(t or "").encode() for t in texts]
        margin = self.scores[:, 1:] - self.scores[:, :1]
        z = np.zeros(len(texts))
        for lo, hi in pieces(data):
            raw, starts = joined(data[lo:hi])
            z[lo:hi] = segment_logits(raw, starts, margin, ORDERS, BITS)[:, 0]
        for i, s in enumerate(stats):
            if s:
                v = votes(s)
                post[i] = known[v] if v in known else known.setdefault(v, self.labels.posterior(v))
                z[i] = 0.5 * (z[i] + float(np.mean(margin[stat_buckets(s), 0]))) + self.bias[1] - self.bias[0]
                out[i] = 1 / (1 + np.exp(-np.clip(z[i], -50, 50)))
        return out, post


def features(texts: list[str], stats: list[tuple[float, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, share), by text: half of the weight is the byte grams', half the statistics'."""
    rows, b, s = spread(*joined([t.encode() for t in texts]), ORDERS, BITS)
    own = np.array([stat_buckets(x) for x in stats], dtype=np.int32)
    rows = np.concatenate([rows, np.repeat(np.arange(len(own), dtype=np.int32), own.shape[1])])
    order = np.argsort(rows, kind="stable")
    return rows[order], np.concatenate([b, own.ravel()])[order], np.concatenate([0.5 * s, np.full(own.size, 0.5 / own.shape[1], dtype=np.float32)])[order]


def taught(rows: np.ndarray, buckets: np.ndarray, shares: np.ndarray, good: np.ndarray) -> np.ndarray:
    """The margins of the buckets, a zero and the bias that a shard's features and posteriors teach."""
    rounds = min(8, max(2, round(TAUGHT / len(good))))
    scores, bias = train(rows, buckets, shares, np.stack([1 - good, good], axis=1), 2, BITS, dim=4, epochs=rounds)
    return np.append(scores[:, 1] - scores[:, 0], bias[1] - bias[0]).astype(np.float64)


def voted(docs: DataFrame) -> LabelModel:
    """The label model of the vote patterns of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in parts(batches):
            counts.update(votes(statistics(text or "")) for text in batch.column("text").to_pylist())
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["pattern", "n"])

    patterns = docs.select("text").mapInArrow(count, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return LabelModel({r["pattern"]: r["n"] for r in patterns.collect()})


def trained(docs: DataFrame) -> Model:
    """The model of all texts, its threshold not yet set."""
    labels, cells = voted(docs), (1 << BITS) + 2
    shards = max(1, -(-docs.count() // SHARD_ROWS))

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        found, good, size = [], [], 0
        totals = np.zeros(cells + 1, dtype=np.int64)  # and the texts

        def add() -> None:
            margins = taught(*(np.concatenate(x) for x in zip(*found)), np.array(good))
            totals[:-1] += np.round(margins * len(good) * MARGIN_STEPS).astype(np.int64)
            totals[-1] += len(good)

        for batch in parts(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            stats = [statistics(t) for t in texts]
            texts, stats = [t for t, x in zip(texts, stats) if x], [x for x in stats if x]
            for lo, hi in pieces([t.encode() for t in texts]):
                rows, b, s = features(texts[lo:hi], stats[lo:hi])
                found.append((rows + np.int32(len(good)), b, s))
                size += len(b)
                for v in map(votes, stats[lo:hi]):
                    good.append(known[v] if v in known else known.setdefault(v, labels.posterior(v)))
                if size >= FEATURES or len(good) >= 2 * SHARD_ROWS:
                    add()
                    found, good, size = [], [], 0
        if good:
            add()
        if totals[-1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells + 1, dtype=np.int32)), pa.array(totals)], names=["cell", "total"])

    place = row_place(21, "doc_id", "text")
    dealt = docs.select("text", place.alias("place")).repartitionById(shards, F.floor(F.col("place") * shards).cast("int")).sortWithinPartitions("place", "text")
    sums = {r["cell"]: r["total"] for r in dealt.select("text").mapInArrow(teach, "cell int, total long").groupBy("cell").agg(F.sum("total").alias("total")).collect()}
    if not sums:
        return Model(labels)
    mean = np.array([sums[k] for k in range(cells)]) / MARGIN_STEPS / sums[cells]
    return Model(labels, np.stack([np.zeros(cells - 1), mean[:-1]], axis=1).astype(np.float32), np.array([0.0, mean[-1]]))


def threshold(scores: DataFrame) -> float:
    """From all rows of scores (score, posterior): counted in steps, at most half of SCORE_STEPS."""
    half = SCORE_STEPS // 2
    step = F.least(F.floor(F.col("score") * SCORE_STEPS), F.lit(half)).alias("step")
    found = sorted((r["step"], r["n"]) for r in scores.where(F.col("posterior") >= SURE).groupBy(step).agg(F.count("*").alias("n")).collect())
    below, able = 0, LOSS * sum(n for _, n in found)
    for step_, n in found:
        below += n
        if below > able:
            return step_ / SCORE_STEPS
    return 0.5


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, posterior of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            p, post = model.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(post)], names=["doc_id", "score", "posterior"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, posterior double")


def fit(docs: DataFrame) -> Model:
    """The model of all rows of docs (doc_id, text), with its threshold."""
    model = trained(docs)
    model.threshold = threshold(scored(docs, model))
    return model


def classify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, score, posterior, keep of each row of docs (doc_id, text). Without a model the texts are scored once, for the threshold and the result."""
    rows = scored(docs, model) if model else saved(scored(docs, trained(docs)), "quality-scores", keep=True)
    limit = model.threshold if model else threshold(rows)
    return rows.withColumn("keep", (F.col("score") >= limit) & (F.col("score") > 0))


def keep(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs that are not rejected, with their columns as they are."""
    model = model or fit(docs)

    @F.pandas_udf("boolean")
    def able(texts: pd.Series) -> pd.Series:
        p, _ = model.score([t if isinstance(t, str) else None for t in texts])
        return pd.Series((p >= model.threshold) & (p > 0))

    return docs.where(able(docs["text"]))
