import hashlib
import math
import zlib

import numpy as np
import pytest
import xxhash

from gondola.llm import digest
from gondola.llm.common import table
from tests.llm.frames import LONG, documents


def plain_fingerprint(text: bytes) -> str:
    """The digest by plain whole numbers, a triplet at a time."""
    low = (1 << 32) - 1
    salt = lambda b: (b + 1) * 0x9E3779B1 & low ^ 0x5BD1E995
    counts = [0] * 128
    for i in range(len(text)):
        for kind, (j, k) in enumerate(((1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4))):
            if i + k < len(text):
                a, b, c = (salt(x) * m & low for x, m in zip((text[i], text[i + j], text[i + k]), (0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)))
                h = (a ^ b) + c + (kind * 0x61C88647 & low) & low
                counts[((h ^ h >> 15) * 0x2C1B3C6D & low) >> 25] += 1
    q1, q2, q3 = (sorted(counts)[k] for k in (31, 63, 95))
    quarters = [(c > q1) + (c > q2) + (c > q3) for c in counts]
    packed = bytes(quarters[k] << 6 | quarters[k + 1] << 4 | quarters[k + 2] << 2 | quarters[k + 3] for k in range(0, 128, 4))
    ratios = (16 * q1 // max(q3, 1) % 16) << 4 | 16 * q2 // max(q3, 1) % 16
    return f"{min(255, round(8 * math.log2(1 + len(text)))):02x}{ratios:02x}{0 if any(counts) else zlib.crc32(text):08x}{packed.hex()}"


def plain_likeness(a: str, b: str) -> float:
    quarters = lambda f: [x >> s & 3 for x in bytes.fromhex(f)[6:] for s in (6, 4, 2, 0)]
    far = [abs(x - y) for x, y in zip(quarters(a), quarters(b))]
    ends = sum(abs(int(a[k], 16) - int(b[k], 16)) for k in (2, 3))
    worse = sum(x + 3 * (x == 3) for x in far) + max(0, abs(int(a[:2], 16) - int(b[:2], 16)) - 1) + ends // 2 + (160 if a[4:12] != b[4:12] else 0)
    return 1.0 if a == b else max(0.0, 1 - worse / 160)


def test_digests_against_plain_numbers():
    rng = np.random.default_rng(3)
    texts = [b"", b"a", b"ab", b"abc", "Éa ñu 日本".encode(), LONG[:3000].encode(), *(rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (5, 40, 900))]
    marks = [plain_fingerprint(t) for t in texts]
    assert [digest.fingerprint(t) for t in texts] == marks
    assert all(digest.likeness(a, b) == pytest.approx(plain_likeness(a, b)) for a in marks for b in marks)


def brute(rows):
    """The contract by a plain loop over the sorted rows; the digest functions are those of the test above."""
    place = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), seed=42)).view(np.int64))
    rows = [(i, t or "") for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, 42 if r[1] is None else place(r[1])))]
    out = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        new = t[: len(t) - n] + following[:n]
        a, b, c = (digest.fingerprint(x.encode()) for x in (t, new, following))
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), a, b, digest.likeness(a, b), digest.likeness(a, c)))
    return out


KEY = lambda r: (r[0] is None, r[0] or 0, *r[1:])


@pytest.mark.parametrize("parts", [1, 3, None])
def test_table(spark, small, parts):
    docs = table(spark, small, "documents")
    got = sorted((tuple(r) for r in digest.fingerprints(docs, parts).collect()), key=KEY)
    assert got == sorted(brute([(r["doc_id"], r["text"]) for r in docs.collect()]), key=KEY)


def test_cases(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((tuple(r) for r in digest.fingerprints(docs).collect()), key=KEY) == sorted(brute(rows), key=KEY)
    assert digest.fingerprints(docs.where("false")).count() == 0
    (one,) = digest.fingerprints(docs.where("doc_id = 3")).collect()
    assert one["near_next"] == 1.0


def test_likeness_falls_with_edits_and_is_bounded():
    text = b"The quick brown fox jumps over the lazy dog. " * 40
    near, far = text.replace(b"lazy", b"idle", 5), bytes(range(256)) * 8
    a, b, c = map(digest.fingerprint, (text, near, far))
    assert 1.0 == digest.likeness(a, a) > digest.likeness(a, b) > digest.likeness(a, c) >= 0.0


def test_pieces_count_each_triplet_once(monkeypatch):
    text = b"abcdefghij" * 50
    want = digest.bucket_counts(text)
    monkeypatch.setattr(digest, "CHUNK", 37)
    assert (digest.bucket_counts(text) == want).all()
