import random
import re
from collections import Counter

import numpy as np
import pytest

from gondola.llm import collocations
from gondola.llm.collocations import LEAST, MOST_WORDS, TOP
from tests.llm.frames import ROWS, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top=TOP, most_words=MOST_WORDS):
    counts, totals = {}, Counter()
    for _, text, lang, *_ in rows:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            own.update(tuple(words[i : i + n]) for n in range(1, most_words + 1) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        ranked = []
        for p, a in found.items():
            score, cut = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and b >= a and inside(p, q) for q, b in found.items()):
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]], cut))
        out += [(lang, k, p.decode(), -a, l_, r, totals[lang], -s, cut) for k, (s, a, p, l_, r, cut) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def got(frame, **more):
    return sorted(tuple(r) for r in collocations.collocations(frame, **more).collect())


@pytest.fixture(scope="module")
def many():
    rng = random.Random(5)
    words = ["The", "of", "a", "new york", "Éa", "日本", "x\ty", "end.", "no, yes", "\n", "é!", "b"]
    return [(i, " ".join(rng.choices(words, weights=[9, 7, 5, 4, 2, 2, 1, 2, 2, 1, 1, 3], k=rng.randint(0, 60))), rng.choice(["en", "fr", None, "und"]), "s") for i in range(300)]


@pytest.mark.parametrize("shard_bytes", [200, 1 << 20])
def test_equals_plain_python(spark, many, shard_bytes):
    rows = [*ROWS, *many]
    want = plain(rows, 40)
    assert len(want) > 30 and any(len(r[2].split()) > 2 for r in want)
    assert got(documents(spark, rows).repartition(3), least=40, shard_bytes=shard_bytes) == want


def test_top_and_fewer_words(spark, many):
    assert got(documents(spark, many), least=20, top=5, most_words=3) == plain(many, 20, 5, 3)
    assert got(documents(spark, many), least=20, most_words=2) == plain(many, 20, most_words=2)


def test_one_long_piece_and_repeats(spark):
    rows = [(1, "red fox " * 5000, "en", "a"), (1, "red fox " * 5000, "en", "a")]
    assert got(documents(spark, rows), shard_bytes=1000) == plain(rows, LEAST)


def test_nothing_frequent(spark):
    assert got(documents(spark, [])) == [] and got(documents(spark, ROWS[:6])) == []


def test_suffix_array_is_in_order():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 4, 300)
    ids[-1] = 0
    left = np.array([next(k for k in range(i, 300) if ids[k] == 0) - i for i in range(300)])
    order = collocations.suffix_array(ids, left, 5)
    suffix = lambda i: tuple(ids[i : i + min(left[i], 8)])
    found = [suffix(i) for i in order if left[i]]
    assert found == sorted(found)


def test_cut_only_where_pieces_end():
    text = b"one two, three four. " * 50 + b"x" * 500
    found = list(collocations.cut_pieces(text, 64))
    assert b"".join(found) == text and len(found) > 5 and all(x[-1:] in b".," for x in found[:-1])


def test_bit_table_never_holds_back(spark):
    rows = spark.createDataFrame([("en", f"w{i} v{i}") for i in range(3000)], "lang string, phrase string")
    known = collocations.bit_table(collocations.keys_of(rows), most_bits=12)  # crowded
    h = collocations.Words([f"w{i} v{i}".encode() for i in range(3000)]).hashes + collocations.salts(["en"])[0]
    assert known.has(collocations.pair_hashes(h)[::2]).all()


def test_sums_of_pairs(spark, many):
    frame = documents(spark, many).repartition(3)
    words = collocations.bit_table(collocations.keys_of(collocations.counted(frame, 1, 1, []).where("n >= 30")))
    got = {r[0] for r in collocations.frequent_pairs(frame, [words], 30, shard_bytes=300).collect()}
    pairs = collocations.counted(frame, 2, 2, []).where("n >= 30")
    assert got == {r[0] for r in collocations.keys_of(pairs).collect()} and len(got) > 20


def test_planes():
    x = np.array([0, 1, 255, 256, 1 << 31, (1 << 32) - 1], dtype=np.uint64)
    assert (collocations.unplaned(collocations.planes(x)) == x).all()
