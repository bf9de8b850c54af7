import random
import re
from collections import Counter, defaultdict

import pytest

from gondola.llm import chosenpath
from gondola.llm.common import table
from tests.llm.frames import documents


def shingles(text):
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    """(class id, links) of each row, by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    shared = Counter((a, b) for own in holders.values() for j, b in enumerate(own) for a in own[:j])
    root, links = list(range(len(rows))), Counter()

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)].append(i)
    return Counter((rows[k][0], min(ids[find(k)], default=None), links[k]) for k in range(len(rows)))


def got(docs):
    return Counter((r["doc_id"], r["class_id"], r["links"]) for r in chosenpath.links(docs).collect())


def test_table(spark, medium):
    docs = table(spark, medium, "documents")
    assert got(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def near_copies(n, words=120, seed=1):
    """A text with n copies of which many differ in a word or two, texts that share a long passage, and others."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    passage = " ".join(f"p{k}" for k in range(60))
    out = []
    for k in range(n):
        own = list(base)
        for _ in range(k % 3):
            own[rng.randrange(words)] = f"x{rng.randrange(50)}"
        out.append((k, " ".join(own)))
        out.append((10_000 + k, passage + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(200))))
        out.append((20_000 + k, " ".join(f"z{rng.randrange(10**6)}" for _ in range(40))))
    return out


@pytest.mark.parametrize("limit, block, flat", [(8, 16, 4), (64, 2048, 32)])
def test_large_buckets_and_blocks(spark, monkeypatch, limit, block, flat):
    rows = near_copies(80)
    monkeypatch.setattr(chosenpath, "FLAT", flat)
    for f, k, v in ((chosenpath.leaves, "limit", limit), (chosenpath.in_blocks, "block", block)):
        monkeypatch.setattr(f, "__defaults__", (v,))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs) == brute(rows)


def test_cases(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = got(docs)
    assert sum(found.values()) == len(rows)
    assert found[(5, 5, 1)] == 1 and found[(6, 5, 1)] == 1 and found[(7, 7, 1)] == 2
    assert found[(None, None, 0)] == 2 and found[(1, 1, 0)] == 2 and found[(2, 2, 0)] == 1
    assert got(docs.where("false")) == Counter()


def test_one_of_each_keeps_columns_and_first_rows(spark):
    docs = documents(spark)
    left = chosenpath.one_of_each(docs)
    assert left.schema == docs.schema
    ids = Counter(r["doc_id"] for r in left.collect())
    assert ids == Counter({None: 2, 1: 2, 2: 1, 3: 1, 4: 1, 5: 1, 7: 1, 8: 1})
    assert chosenpath.one_of_each(docs.where("false")).count() == 0


def test_runs_reach_the_recall():
    assert 1 - (1 - 0.8 * 0.96**2) ** chosenpath.runs_for() >= chosenpath.RECALL
