"""The classifiers' forward passes and the label model's posteriors against plain Python: same weights in, same scores out."""

import math
from itertools import product

import numpy as np
import pytest

from gondola.llm import langid, quality, toxicity

TEXTS = ["one", "the same five words here and some more of them to fill windows", "  led by blanks\tand\n\nlines  ", "É a ñ 日本 \U0001f600 end", "ab" * 400, "a", "x y z " * 30 + "last"]


def grams(text: bytes, orders, bits):
    """(place, bucket) of each gram of a text: no white space inside."""
    raw = [32 if c in b" \t\n\v\f\r" else c for c in b" " + text + b"   "]
    for n in orders:
        for at in range(len(raw) - n + 1):
            own = raw[at : at + n]
            if 32 in own[1:-1] or (n < 3 and own[0] == own[-1] == 32):
                continue
            h = 0x27D4EB2F * n & 0xFFFFFFFF
            for k, c in enumerate(own):
                factor = ((k + 1) * 0x9E3779B97F4A7C15 % 2**64 >> 32) | 1
                h = (h + c * factor) & 0xFFFFFFFF
                h ^= h >> 13
                h = h * 0x85EBCA6B & 0xFFFFFFFF
            yield at, h >> (32 - bits)


def weights(bits, classes, seed):
    rng = np.random.default_rng(seed)
    scores = rng.normal(0, 2, ((1 << bits) + 1, classes)).astype(np.float32)
    scores[-1] = 0
    return scores, rng.normal(0, 1, classes)


def sigmoid(z):
    return 1 / (1 + math.exp(-z))


def test_language_scores():
    langs = ["de", "en", "fr"]
    scores, bias = weights(langid.BITS, 3, 1)
    model = langid.Model(langs, scores, bias, temperature=0.7)
    names, best = model.predict(TEXTS)
    for text, name, score in zip(TEXTS, names, best):
        own = [b for _, b in grams(langid.prepared(text), langid.ORDERS, langid.BITS)]
        z = [(sum(float(scores[b, k]) for b in own) / max(len(own), 1) + bias[k]) / 0.7 for k in range(3)]
        p = [math.exp(x - max(z)) for x in z]
        p = [x / sum(p) for x in p]
        assert name == langs[p.index(max(p))] and score == pytest.approx(max(p), abs=1e-5)


def test_quality_scores():
    scores, bias = weights(quality.BITS, 2, 2)
    model = quality.Model(quality.LabelModel({"gggggggg": 3, "bbbbbbbb": 1}), scores, bias)
    found, _ = model.score(TEXTS)
    margin = lambda b: float(scores[b, 1]) - float(scores[b, 0])
    for text, score in zip(TEXTS, found):
        own = [margin(b) for _, b in grams(text.encode(), quality.ORDERS, quality.BITS)]
        stats = [margin((k * 11 + int(10 * x)) * 0x9E3779B1 % (1 << quality.BITS)) for k, x in enumerate(quality.statistics(text))]
        z = 0.5 * (sum(own) / max(len(own), 1) + sum(stats) / len(stats)) + bias[1] - bias[0]
        assert score == pytest.approx(sigmoid(z), abs=1e-5)


def test_toxicity_scores():
    scores, bias = weights(toxicity.BITS, 2, 3)
    model = toxicity.Model(scores, bias, 1.5, -0.2)
    for text, score in zip(TEXTS, model.score([toxicity.prepared(t) for t in TEXTS])):
        data = toxicity.prepared(text)
        raw = [32 if c in b" \t\n\v\f\r" else c for c in b" " + data + b"   "]
        starts = [i for i in range(len(raw) - 1) if raw[i] == 32 and raw[i + 1] != 32]
        half = toxicity.WINDOW // 2
        cuts = [0, *(w for k, w in enumerate(starts) if k and k % half == 0), len(raw)]
        found = list(grams(data, toxicity.ORDERS, toxicity.BITS))
        means = []
        for k in range(max(1, len(cuts) - 2)):
            lo, hi = cuts[k], cuts[min(k + 2, len(cuts) - 1)]
            own = [float(scores[b, 1]) - float(scores[b, 0]) for at, b in found if lo <= at < hi]
            means.append(sum(own) / max(len(own), 1) + bias[1] - bias[0])
        assert score == pytest.approx(sigmoid(1.5 * max(means) - 0.2), abs=1e-5)


def test_posteriors_by_enumeration():
    rng = np.random.default_rng(5)
    patterns = {"".join(rng.choice(list("gb-"), len(quality.LABELLERS))): int(rng.integers(1, 50)) for _ in range(200)}
    model, total = quality.LabelModel(patterns), 0.0
    for pattern in map("".join, product("gb-", repeat=len(quality.LABELLERS))):
        joint = [prior * math.prod(model.rates[y, j, "gb-".index(c)] for j, c in enumerate(pattern)) for y, prior in ((0, 1 - model.prior), (1, model.prior))]
        total += sum(joint)
        if pattern in patterns:
            assert model.posterior(pattern) == pytest.approx(joint[1] / sum(joint), abs=1e-9)
    assert total == pytest.approx(1)
