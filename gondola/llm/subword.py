"""Hashed subword embeddings averaged into a linear softmax, trained by stochastic gradient descent in numpy.

A gram is a run of 2 to 5 bytes without white space inside (it may begin or end with one, so that word edges count).
Because the mean of embeddings meets a linear layer, a trained model collapses to one row of class scores for each hash
bucket, and the logits of a stretch of text are the mean of its grams' rows.
"""

from __future__ import annotations

import numpy as np

from gondola.llm.common import IS_SPACE

_FACTORS = (np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SPACE_TO_BLANK = np.arange(256, dtype=np.uint8)
_SPACE_TO_BLANK[IS_SPACE] = 32


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each after a blank, and the place of each such blank; three blanks end it."""
    raw = np.frombuffer(b" " + b" ".join(texts) + b"   ", dtype=np.uint8)
    lens = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    return _SPACE_TO_BLANK[raw], np.cumsum(lens) - lens


def gram_buckets(raw: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket of the gram of n bytes at each place (bucket 2**bits: none there)."""
    size = len(raw) - n + 1
    out = np.full(len(raw), 1 << bits, dtype=np.int32)
    if size <= 0:
        return out
    h = np.full(size, 0x27D4EB2F * n & 0xFFFFFFFF, dtype=np.uint32)
    for k in range(n):
        h += raw[k : k + size] * _FACTORS[k]
        h ^= h >> np.uint32(13)
        h *= np.uint32(0x85EBCA6B)
    blank = raw == 32
    bad = blank[:size] & blank[n - 1 : n - 1 + size] & (n < 3)
    for k in range(1, n - 1):
        bad = bad | blank[k : k + size]
    out[:size] = np.where(bad, 1 << bits, (h >> np.uint32(32 - bits)).astype(np.int32))
    return out


def spread(raw: np.ndarray, starts: np.ndarray, orders: tuple[int, ...], bits: int, limit: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets and their shares in each segment, as (segment, bucket, share); about limit bytes are worked on at once."""
    ends, out, lo = np.append(starts[1:], len(raw)), [], 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + limit, side="right")))
        # A gram may reach into the next segment, as it does when all are worked on at once.
        rows, buckets, shares = _spread(raw[starts[lo] : ends[hi - 1] + max(orders) - 1], starts[lo:hi] - starts[lo], int(ends[hi - 1] - starts[lo]), orders, bits)
        out.append((rows + np.int32(lo), buckets, shares))
        lo = hi
    return tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32))


def _spread(raw: np.ndarray, starts: np.ndarray, size: int, orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    segment = np.zeros(size, dtype=np.int64)
    segment[starts[1:]] = 1
    segment = np.cumsum(segment)
    keys = []
    for n in orders:
        b = gram_buckets(raw, n, bits)[:size]
        own = b < 1 << bits
        keys.append(segment[own] << bits | b[own])
    keys, counts = np.unique(np.concatenate(keys), return_counts=True)
    rows = (keys >> bits).astype(np.int32)
    total = np.bincount(rows, weights=counts, minlength=len(starts))
    return rows, (keys & (1 << bits) - 1).astype(np.int32), (counts / total[rows]).astype(np.float32)


def segment_logits(raw: np.ndarray, starts: np.ndarray, scores: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Mean of the class scores of the grams of each segment; the segments begin at starts and end where the next begins."""
    total, grams = segment_sums(raw, starts, scores, orders, bits)
    return total / np.maximum(grams, 1)[:, None]


def segment_sums(raw: np.ndarray, starts: np.ndarray, scores: np.ndarray, orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the class scores of the grams of each segment, and their number."""
    total, grams = np.zeros((len(starts), scores.shape[1])), np.zeros(len(starts))
    for n in orders:
        b = gram_buckets(raw, n, bits)
        grams += np.add.reduceat((b < 1 << bits).astype(np.float32), starts)
        for k in range(scores.shape[1]):
            total[:, k] += np.add.reduceat(scores[:, k][b], starts, dtype=np.float64)
    return total, grams


def train(rows, buckets, shares, labels, classes: int, bits: int, dim: int = 8, epochs: int = 8, rate: float = 20.0, batch: int = 64, seed: int = 1, start=None) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings and softmax weights from sparse rows (sorted by row) and labels: a class, or the shares of all classes, for each row; returns the collapsed scores (a zero row at the end) and the bias."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32) if start is None else start[0]
    weights = rng.normal(0, 0.5, (dim, classes)).astype(np.float32) if start is None else start[1]
    bias = np.zeros(classes, dtype=np.float32)
    ends = np.searchsorted(rows, np.arange(len(labels) + 1))
    once = labels.astype(np.float32) if labels.ndim == 2 else np.eye(classes, dtype=np.float32)[labels]
    steps, step = max(1, epochs * -(-len(labels) // batch)), 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            own = own[ends[own + 1] > ends[own]]
            now = rate * (1 - step / steps)
            step += 1
            if not len(own):
                continue
            sizes = ends[own + 1] - ends[own]
            first = np.cumsum(sizes) - sizes
            pick = np.arange(int(sizes.sum())) - np.repeat(first - ends[own], sizes)
            b, s = buckets[pick], shares[pick][:, None]
            mean = np.add.reduceat(table[b] * s, first)
            z = mean @ weights + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - once[own]) / len(own)
            back = np.repeat(g @ weights.T, sizes, axis=0) * s
            # Steps are bounded, so that no rate makes the values overflow.
            weights -= np.clip(0.05 * now * mean.T @ g, -1, 1)
            bias -= np.clip(0.01 * now * g.sum(0), -1, 1)
            order_b = np.argsort(b, kind="stable")
            sorted_b = b[order_b]
            new = np.flatnonzero(np.diff(sorted_b, prepend=-1))
            table[sorted_b[new]] -= np.clip(now * len(own) * 0.25 * np.add.reduceat(back[order_b], new), -1, 1)
    return np.vstack([table @ weights, np.zeros((1, classes), dtype=np.float32)]).astype(np.float32), bias.astype(np.float64)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)
