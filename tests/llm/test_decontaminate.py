import random

import pytest

from gondola.llm import decontaminate
from gondola.llm.common import table, word_stream
from tests.llm.frames import documents


def words(text):
    return text.lower().split()


def similarity(a, b):
    def bag(w):
        out = {}
        for k in range(max(1, len(w) - 4)):
            s = tuple(w[k : k + 5])
            out[s] = out.get(s, 0) + 1
        return out

    x, y = bag(a), bag(b)
    size = lambda s: sum(len(v.encode()) for v in s)
    common = sum(min(n, y.get(s, 0)) * size(s) for s, n in x.items())
    return common / (sum(n * size(s) for s, n in x.items()) + sum(n * size(s) for s, n in y.items()) - common)


def brute(text, item):
    """The highest similarity of the item and a window of its length."""
    w, own = words(text), words(item)
    return max((similarity(own, w[k : k + len(own)]) for k in range(max(1, len(w) - len(own) + 1))), default=0.0) if w and own else 0.0


def test_table(spark, medium):
    docs, items = table(spark, medium, "documents"), table(spark, medium, "benchmark")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.matches(docs, items).collect()}
    texts, by_id = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["item_id"]: r["text"] for r in items.collect()}
    first = {}
    for i, t in by_id.items():
        w = words(t)
        for k in range(len(w) - 4):
            first.setdefault(tuple(w[k : k + 5]), set()).add(i)
    want = {}
    for d, t in texts.items():
        w = words(t)
        for i in {i for k in range(len(w) - 4) for i in first.get(tuple(w[k : k + 5]), ())}:
            if (s := brute(t, by_id[i])) >= 0.8:
                want[d, i] = s
    assert got.keys() == want.keys() and got
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_near_passages_and_cut_ones(spark):
    rng = random.Random(3)
    make = lambda n: [f"v{rng.randrange(10**5)}" for _ in range(n)]
    items = [(k, " ".join(make(n))) for k, n in enumerate((6, 15, 22, 40, 60, 200))] + [(None, None), (90, ""), (91, "two words")]
    docs, want = [], set()
    for k, text in items[3:6]:
        w = text.split()
        edited = [*w]
        edited[len(w) // 2] = "changed"
        for d, body in enumerate((w, edited, w[2:], w[:-2])):
            docs.append((10 * k + d, " ".join([*make(90), *(x.upper() for x in body), *make(700)])))
            if similarity(w, body) >= 0.8:
                want.add((10 * k + d, k))
    docs += [(500 + k, t) for k, t in items[:3]] + [(600, "just two words here"), (700, " ".join(make(3000))), (800, None)]
    want |= {(500 + k, k) for k in range(3)} | {(600, 91)}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want


def test_cut_items_are_found_whatever_rows_come_before():
    rng = random.Random(7)
    make = lambda n: " ".join(f"v{rng.randrange(10**5)}" for _ in range(n)).encode()
    item = make(50)
    cut = b" ".join(item.split()[2:]) + b" " + make(12)
    index = decontaminate.Index([(1, item)])
    for before in ([], [b""], [make(100), b""], [make(100), b"a", b"", b"two words"], [make(30), *[b""] * 5]):
        (found,) = index.find([*before, cut, b"", make(70)])
        assert found[:2] == (len(before), 1) and found[2] >= 0.9 and found[3:] == (0, 48)


def test_all_fingerprints_within_the_radius_are_found():
    rng = random.Random(1)
    item = " ".join(f"q{rng.randrange(10**6)}" for _ in range(50)).encode()
    index = decontaminate.Index([(1, item)])
    ((size, (_, _, own, _)),) = index.windows.items()
    flips = [sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 20))) for _ in range(3000)]
    import numpy as np

    marks = np.array([int(own[0]) ^ f for f in flips], dtype=np.uint64)
    place, window = index.near(marks, np.ones(len(marks), dtype=bool), size)
    assert {p for p, w in zip(place, window) if w == 0} == {k for k, f in enumerate(flips) if f.bit_count() <= decontaminate.RADIUS}


def test_passes_and_stretches_agree(spark, small, monkeypatch):
    docs, items = table(spark, small, "documents"), table(spark, small, "benchmark")
    rows = lambda: sorted(map(tuple, decontaminate.matches(docs, items).collect()))
    want = rows()
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 2000)
    monkeypatch.setattr(decontaminate, "STRETCH", 100)
    assert decontaminate.passes(items)[0] > 2 and rows() == want


def test_many_passes_leave_what_one_leaves(spark, small, monkeypatch):
    docs, items = table(spark, small, "documents"), table(spark, small, "benchmark")
    want = sorted(r["doc_id"] for r in decontaminate.clean(docs, items).collect())
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 2000)
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, items).collect()) == want


def test_long_texts_are_hashed_in_parts():
    text = b" ".join(b"Word%d" % k for k in range(5000)) + b"\n" + b"x" * 5000
    a, b = word_stream([b"a b", text, b"", b"c"]), word_stream([b"a b", text, b"", b"c"], limit=700)
    assert all((x == y).all() for x, y in zip(a, b)) and a[2].tolist() == [2, 5001, 0, 1]


def test_cases(spark):
    docs = documents(spark)
    items = spark.createDataFrame([(1, "the same five words here", 1), (1, "the same five words here", 1), (2, None, 1)], "item_id long, text string, doc_id long")
    got = [tuple(r)[:2] for r in decontaminate.matches(docs, items).collect()]
    assert sorted(got) == [(7, 1)] * 4
    left = decontaminate.clean(docs, items)
    assert left.schema == docs.schema and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 0, 1, 1, 2, 3, 4, 5, 6, 8]
    for d, i in ((docs.where("false"), items), (docs, items.where("false"))):
        assert decontaminate.matches(d, i).count() == 0
    assert decontaminate.clean(docs, items.where("false")).count() == docs.count()
