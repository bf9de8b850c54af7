import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gondola.llm import mixlm
from gondola.llm.common import PLACES, mix64, table, word_places
from tests.llm.frames import LONG, documents


def tokens(text):
    return [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())] + [b" end"]


def base_scores(rows):
    learn = [t for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 10]
    c = Counter(w for t in learn for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(i, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for i, t in rows]


def same(rows, got):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[4], 6))
    want = sorted(base_scores(rows), key=key)
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
    assert len(got) == len(want)
    for a, b in zip(want, got):
        assert a[:4] == b[:4] and b[4] == pytest.approx(a[4], rel=1e-9)


def test_base_score_and_model_on_the_table(spark, small):
    docs = table(spark, small, "documents")
    got = mixlm.score(docs).collect()
    same([(r["doc_id"], r["text"]) for r in docs.collect()], got)
    held = [r for r in got if r["held_out"]]
    assert held and all(r["score"] < 0 for r in got)
    assert np.mean([r["bits_per_byte"] for r in held]) < 3.2
    assert sum(r["score"] for r in held) > 0.95 * sum(r["base_score"] for r in held)
    size = {r["doc_id"]: len(r["text"].encode()) + 1 for r in docs.collect()}
    assert all(r["bits_per_byte"] * size[r["doc_id"]] * np.log10(2) == pytest.approx(-r["score"], rel=1e-9) for r in got)


def test_held_out_texts_beat_the_base_score(spark, medium):
    held = mixlm.score(table(spark, medium, "documents")).where("held_out").collect()
    assert sum(r["score"] for r in held) > 0.8 * sum(r["base_score"] for r in held)
    assert sum(r["score"] > r["base_score"] for r in held) > 0.55 * len(held)


def test_cases(spark):
    docs = documents(spark)
    got = mixlm.score(docs).collect()
    same([(r["doc_id"], r["text"]) for r in docs.collect()], got)
    scores = {}
    for r in got:
        scores.setdefault(r["n_tokens"], set()).add(round(r["score"], 6))
    assert len(scores[1]) == 2  # one for null and empty texts, one for white space
    long = {r["held_out"]: r["score"] for r in got if r["n_tokens"] == len(tokens(LONG))}
    assert set(long) == {False, True} and long[True] > 0.1 * long[False]  # the training text is all that the held-out one repeats


def test_empty_and_all_held_out(spark):
    docs = documents(spark)
    assert mixlm.score(docs.where("false")).count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    (r,) = mixlm.score(documents(spark, [(held, "some words", "en", "a")])).collect()
    assert (r["held_out"], r["train_tokens"], r["n_known"], r["n_tokens"]) == (True, 0, 0, 3) and r["base_score"] == pytest.approx(0)


def trained(bits=18, texts=(b"abab abba baab cc",) * 20):
    counts = mixlm.Counts(bits)
    counts.add(list(texts))
    return mixlm.Model([mixlm.log_odds(t) for t in counts.tables], bits)


def test_probabilities_of_the_next_byte_sum_to_one():
    model = trained()

    def coded(text, size):
        raw, starts, _ = mixlm.joined([text])
        return 2.0 ** -model.code(raw, mixlm.word_so_far(raw), starts, np.array([size]))[0].sum(dtype=np.float64)

    every = [coded(b"ab" + bytes([c]), 3) for c in range(256) if not 65 <= c <= 90]
    assert sum(every) <= coded(b"ab", 2) * (1 + 1e-4)
    assert sum(every) >= 0.98 * coded(b"ab", 2)  # the rest is upper case, which no text has


def coded_bit_by_bit(model, text):
    """The bits of one text, by plain numbers, one bit at a time; learning waits for the end of each stretch."""
    pad, data = mixlm.PAD, text.lower() + b"\0"
    raw = np.frombuffer(bytes(pad) + data, dtype=np.uint8)
    rows = list(mixlm.rows_of(raw.astype(np.uint32), mixlm.word_so_far(raw)[pad:], model.bits))
    n, sigmoid = len(rows) + 1, lambda z: 1 / (1 + np.exp(-z))
    weights = [[float(x) / (mixlm.SCALE if k < n - 1 else 1) for x in model.weights[k]] for k in range(n)]
    rates = [mixlm.RATE / mixlm.SCALE**2] * (n - 1) + [mixlm.RATE]
    maps = [[list(map(float, m)) for m in by_bit] for by_bit in model.refine]
    slots, slot_bits = {}, max(12, min(20, int(np.ceil(np.log2(len(data) * mixlm.SLOTS_A_BYTE)))))
    total = 0.0
    for at, step in mixlm.steps(len(data)):
        learn, moves = [[0.0] * 8 for _ in range(n)], [[[0.0] * mixlm.KNOTS for _ in range(8)] for _ in range(2)]
        hits = []
        for i in range(at, min(at + step, len(data))):
            byte, before = data[i], raw[pad + i - 2 : pad + i].tolist()
            two = (before[1] << 8 | before[0]) * 0x9E3779B1 & 0xFFFFFFFF
            low = (two + ((byte >> 4) + 1) * 0x297A2D39 & 0xFFFFFFFF) * 0x2C1B3C6D & 0xFFFFFFFF
            for b in range(8):
                half, node = b // 4, 1
                for k in range(b // 4 * 4, b):
                    node = node << 1 | byte >> 7 - k & 1
                bit = byte >> 7 - b & 1
                slot = (((two, low)[half] >> 32 - (slot_bits - 4)) << 4) + node
                x = [float(model.tables[k][(int(r[half][i]) << 4) + node]) for k, r in enumerate(rows)]
                x.append(float(mixlm.SLOT_ODDS[slots.get(slot, 0)]))
                z = min(7.99, max(-7.99, sum(weights[k][b] * x[k] for k in range(n))))
                p, seen = sigmoid(z), int(x[-2] != 0)
                cell = int(z * (mixlm.KNOTS - 1) / 16 + mixlm.KNOTS // 2 + 0.5)
                q = maps[seen][b][cell]
                total -= np.log2(abs(1 - bit - min(1 - 1e-5, max(1e-5, (p + q) / 2))))
                for k in range(n):
                    learn[k][b] += (bit - p) * x[k]
                moves[seen][b][cell] += bit - q
                hits.append((slot, bit, slots.get(slot, 0)))
        for k in range(n):
            for b in range(8):
                weights[k][b] += rates[k] * mixlm.STEP / step * learn[k][b]
        for seen in range(2):
            maps[seen] = [[m + mixlm.MAP_RATE * mixlm.STEP / step * v for m, v in zip(*x)] for x in zip(maps[seen], moves[seen])]
        # Of several bits of a slot in a stretch, that of the highest place in its byte counts, then the last.
        for _, (slot, bit, state) in sorted(enumerate(hits), key=lambda h: (h[0] % 8, h[0])):
            slots[slot] = int(mixlm.FOLLOW[2 * state + bit])
    return total


def test_a_plain_coder_agrees():
    model = trained()
    for text in (b"", b"abab", b"abba baab the cc of Abab abba abab! " * 30, bytes(range(1, 256)) * 3):
        assert -model.score([text])[0] / np.log10(2) == pytest.approx(coded_bit_by_bit(model, text), rel=2e-4)


def test_steps_cover_a_text_and_grow():
    every = list(mixlm.steps(100_000))
    assert every[0] == (0, 64) and all(a + n == b for (a, n), (b, _) in zip(every, every[1:])) and sum(every[-1]) >= 100_000
    assert {n for _, n in every} == {64, 128, 256, 512, 1024}


def test_contexts_of_several_stretches_are_looked_up_together(monkeypatch):
    """With the same bits, weights and maps as stretch by stretch, also behind the last text's end."""
    model, rng = trained(), np.random.default_rng(3)
    texts = sorted((bytes(rng.choice(list(b"ab c"), n).astype(np.uint8)) for n in (9000, 5000, 4097, 700, 700, 64, 63, 1, 0)), key=len, reverse=True)
    raw, starts, sizes = mixlm.joined(texts)
    calls, rows_of = [], mixlm.rows_of
    monkeypatch.setattr(mixlm, "rows_of", lambda *a: calls.append(1) or rows_of(*a))
    together = model.code(raw, mixlm.word_so_far(raw), starts, sizes)
    assert 0 < 4 * len(calls) <= len(list(mixlm.steps(int(sizes[0]))))
    assert [s for *_, own in mixlm.blocks(sizes) for s in own] == list(mixlm.steps(int(sizes[0])))
    calls.clear()
    monkeypatch.setattr(mixlm, "BLOCK", 1)
    for a, b in zip(together, model.code(raw, mixlm.word_so_far(raw), starts, sizes)):
        assert (a == b).all()
    assert len(calls) == len(list(mixlm.steps(int(sizes[0]))))


def test_long_contexts_against_plain_counts(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)]
    passage = " ".join(rng.choice(words, 400))
    texts = [" ".join(rng.choice(words, 200)) + " " + (passage if k % 3 == 0 else "Tail") for k in range(24)] + [passage + " " + passage, None, "", "one two three"]
    rows = list(enumerate(texts)) + [(None, passage), (3, texts[3]), (3, texts[3])]
    model = trained(texts=[passage.encode()])
    got = mixlm.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()

    def runs(text):
        """(four words before, the stretch, its bits) of each stretch."""
        data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
        raw, starts, sizes = mixlm.joined([data])
        spent = model.spent(raw, mixlm.word_so_far(raw), starts, sizes)[mixlm.PAD :]
        found = list(re.finditer(rb"[^\x20\x09-\x0D]+", data))
        hashes, _, _, _ = word_places([data])
        at = []
        for k in range(4, len(found)):
            h = mix64(np.array([sum(int(hashes[k - j]) * int(PLACES[j - 1]) for j in range(1, 5)) & (1 << 64) - 1], dtype=np.uint64))[0]
            if int(h) >> 32 < (1 << 32) // mixlm.SPACING:
                at.append((found[k].start(), tuple(m[0] for m in found[k - 4 : k])))
        ends = [a for a, _ in at[1:]] + [len(data) + 1]
        return spent[: len(data) + 1].sum(), [(c, data[a:e] + b"\0" * (e > len(data)), float(spent[a:e].sum(dtype=np.float64))) for (a, c), e in zip(at, ends)]

    learns = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 != 0
    contexts, pairs = Counter(), Counter()
    for i, t in rows:
        if learns(i):
            contexts.update(c for c, _, _ in runs(t)[1])
            pairs.update((c, x) for c, x, _ in runs(t)[1])
    want = []
    for i, t in rows:
        bits, own = runs(t)
        met, met_pairs = Counter(c for c, _, _ in own), Counter((c, x) for c, x, _ in own)
        n, m = (Counter(contexts), Counter(pairs))
        if learns(i):
            n.subtract(met), m.subtract(met_pairs)
        for c, x, cost in own:
            bits -= np.log2((m[c, x] + 0.5 * 2.0**-cost) / (n[c] + 0.5)) + cost
            n[c] += 1
            m[c, x] += 1
        want.append((i is None, i or 0, max(bits, 0.0)))
    have = sorted((r["doc_id"] is None, r["doc_id"] or 0, -r["score"] / np.log10(2)) for r in got)
    for a, b in zip(sorted(want), have, strict=True):
        assert a[:2] == b[:2] and b[2] == pytest.approx(a[2], rel=1e-4, abs=1e-3)
    assert any(0 < w[2] < 400 for w in want)


def test_a_score_depends_on_the_text_alone():
    rng = np.random.default_rng(0)
    model = mixlm.Model([rng.integers(-60, 60, n).astype(np.int8) for n in mixlm.table_sizes(18)], 18)
    text = LONG.encode()
    alone = model.score([text, b"", b"few words"])
    among = model.score([b"x" * 100_000, text, b"y", text, b"few words", *[b"z" * 5000] * 300, b""])
    assert alone[0] == pytest.approx(among[1], rel=1e-9) and among[1] == pytest.approx(among[3], rel=1e-9)
    assert alone[1] == pytest.approx(among[-1], rel=1e-9) and alone[2] == pytest.approx(among[4], rel=1e-9)


def test_words_of_batches_and_parts_agree(spark, monkeypatch, small):
    docs = table(spark, small, "documents").repartition(5)
    model = mixlm.fit(docs)
    want = {r["doc_id"]: r for r in mixlm.score(docs, model).collect()}
    monkeypatch.setattr(mixlm, "LANES", 7)
    got = {r["doc_id"]: r for r in mixlm.score(docs.repartition(3), model).collect()}
    for k, r in want.items():
        assert got[k]["base_score"] == pytest.approx(r["base_score"], rel=1e-9) and got[k]["score"] == pytest.approx(r["score"], rel=1e-4)


def test_start_comes_from_every_tuning_text(spark, monkeypatch):
    """Whole texts of the tuning fold, more of them than any sample had: worth of the values and starting weights."""
    bits, rng = 12, np.random.default_rng(8)
    words = [f"w{k}" for k in range(50)]
    rows = [(k, " ".join(rng.choice(words, 4)) + " end") for k in range(6000)] + [(None, None), (6001, "")]
    rows += [(k, " ".join(rng.choice(words, 1500))) for k in range(7000, 7020)]
    fold = [zlib.crc32(b"" if k is None else str(k).encode()) % 10 for k, _ in rows]
    tune = [(t or "").encode() for (_, t), f in zip(rows, fold) if f == 1]
    assert len(tune) > 400 and max(map(len, tune)) > 4096
    rest = mixlm.Counts(bits)
    rest.add([(t or "").encode() for (_, t), f in zip(rows, fold) if f > 1])
    tables = [mixlm.log_odds(t) for t in rest.tables]
    met, ones = np.zeros((2, len(tables), 256))
    for text in tune:
        raw = np.frombuffer(bytes(mixlm.PAD) + text.lower() + b"\0", dtype=np.uint8)
        byte = raw[mixlm.PAD :].astype(np.int64)
        for k, halves in enumerate(mixlm.rows_of(raw.astype(np.uint32), mixlm.word_so_far(raw)[mixlm.PAD :], bits)):
            for b in range(8):
                node = (1 << b % 4) + ((byte >> 4 if b < 4 else byte & 15) >> 4 - b % 4)
                value = tables[k][(halves[b // 4].astype(np.int64) << 4) + node].astype(np.int64) + 128
                np.add.at(met[k], value, 1)
                np.add.at(ones[k], value, byte >> 7 - b & 1)
    values = [mixlm.new_values(m, o) for m, o in zip(met, ones)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with mixlm.scratch(spark):
        able = docs.where("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 10 != 0").selectExpr("doc_id", "text", "crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 10 = 1 as tune")
        found = mixlm.log_odds_tables(mixlm.context_counts(able, bits), bits)
    assert all((a == b).all() for a, b in zip(found[1], tables)) and all((a == b).all() for a, b in zip(found[2], values))
    # A shard for each text: the start is the mean of what each of them ends with, by its bytes.
    monkeypatch.setattr(mixlm, "SHARD_BYTES", 1 << 12)
    monkeypatch.setattr(mixlm, "SMALL_SHARD", 0)
    first, few = mixlm.Model(tables, bits).calibrated(values), [(5, "w1 w2 " * 2000), (6, "w3 w4 w5 " * 1500), (7, "w6"), (7, "w6")]
    monkeypatch.setattr(mixlm, "row_place", lambda *_: mixlm.F.col("doc_id") / 8.0)
    start = mixlm.started(spark.createDataFrame(few, "doc_id long, text string").repartition(3), first)
    groups, sizes = [["w1 w2 " * 2000], ["w3 w4 w5 " * 1500], ["w6", "w6"]], [12001, 13501, 6]
    alone = [first.tuned([t.encode() for t in g], rounds=1) for g in groups]
    assert start.weights == pytest.approx(np.average([m.weights for m in alone], axis=0, weights=sizes), abs=1e-4)
    assert start.refine == pytest.approx(np.average([m.refine for m in alone], axis=0, weights=sizes), abs=1e-4)
