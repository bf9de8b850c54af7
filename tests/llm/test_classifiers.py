"""Language ID, quality and toxicity: held-out accuracy on the tables, and defined results of the odd cases."""

import numpy as np
import pytest

from gondola.llm import langid, quality, subword, toxicity
from gondola.llm.common import table
from tests.conftest import DATA
from tests.llm.frames import LONG, documents


@pytest.fixture(scope="module")
def lang_model(spark, medium):
    return langid.fit(table(spark, medium, "documents"))


@pytest.fixture(scope="module")
def quality_model(spark, medium):
    return quality.fit(table(spark, medium, "documents"))


def test_languages_of_held_out_texts(spark, medium, lang_model):
    docs = table(spark, medium, "documents")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = langid.identify(docs, lang_model).collect()
    assert len(rows) == len(lang) and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert sum(r["rejected"] for r in rows) <= 0.01 * len(rows)


def test_language_cases(spark, lang_model):
    docs = documents(spark)
    rows = langid.identify(docs, lang_model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] in (1, 2, 8):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
    left = langid.keep(docs, lang_model)
    assert left.schema == docs.schema and not {1, 2, 8} & {r["doc_id"] for r in left.collect()}


def test_no_language_learned(spark):
    docs = documents(spark)
    assert langid.identify(docs.where("false")).count() == 0
    rows = langid.identify(docs.withColumn("lang", docs["lang"].substr(99, 1)).where("lang is null")).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {("und", 0.0)}


def test_quality_finds_the_bad_ones(spark, medium, quality_model):
    docs = table(spark, medium, "documents")
    labels = {r["doc_id"]: r["quality"] for r in table(spark, medium, "labels").collect()}
    kept = {r["doc_id"]: r["keep"] for r in quality.classify(docs, quality_model).collect()}
    good, bad = ([kept[d] for d, q in labels.items() if q == k] for k in (1, 0))
    assert len(kept) == docs.count() and np.mean(good) > 0.97 and np.mean(bad) < np.mean(good)
    assert all(0 <= a <= 1 for a in quality_model.labels.accuracies().values())


def test_quality_cases(spark, quality_model):
    docs = documents(spark)
    rows = quality.classify(docs, quality_model).collect()
    assert len(rows) == docs.count() and all(not r["keep"] and r["score"] == 0 for r in rows if r["doc_id"] in (1, 2))
    assert quality.keep(docs, quality_model).schema == docs.schema
    assert quality.classify(docs.where("false")).count() == 0 and quality.keep(docs.where("false")).count() == 0


def test_quality_learns_from_every_text(spark, monkeypatch):
    """Each shard's texts teach, and the threshold counts all sure texts."""
    rng = np.random.default_rng(3)
    words = [f"word{k}" for k in range(40)]
    texts = [" ".join(rng.choice(words, 12)) + "." if k % 3 else "## $$ ## $$ XX" * (1 + k % 5) for k in range(5000)] + [None, " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(quality, "SHARD_ROWS", 1000)
    model = quality.trained(docs)
    stats = [quality.statistics(t or "") for t in texts]
    place = {r["doc_id"]: r["p"] for r in docs.select("doc_id", quality.row_place(21, "doc_id", "text").alias("p")).collect()}
    shards = [[] for _ in range(6)]
    for k in sorted(place, key=place.get):
        if stats[k]:
            shards[int(place[k] * 6)].append(k)
    post = [model.labels.posterior(quality.votes(s)) for s in stats]
    margins = [quality.taught(*quality.features([texts[k] for k in x], [stats[k] for k in x]), np.array([post[k] for k in x])) for x in shards]
    want = np.average(margins, axis=0, weights=[len(x) for x in shards])
    assert sum(map(len, shards)) == 5000
    assert model.scores[:, 1] - model.scores[:, 0] == pytest.approx(want[:-1], abs=1e-4) and model.bias[1] - model.bias[0] == pytest.approx(want[-1], abs=1e-4)
    for low, limit in ((10, 0.5), (11, 0.25)):  # 0.002 of 5000 are 10
        scores = spark.createDataFrame([(0.25, 1.0)] * low + [(0.75, 1.0)] * (5000 - low) + [(0.1, 0.5)] * 50, "score double, posterior double")
        assert quality.threshold(scores) == limit
    assert quality.threshold(scores.where("false")) == 0.5
    whole, alone = ({tuple(r) for r in quality.classify(docs, m).collect()} for m in (None, quality.fit(docs.repartition(5))))
    assert whole == alone and len(whole) == len(texts)


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.7
    right = [0.9, 0.8, 0.95, 0.7, 0.85, 0.9, 0.75, 0.8]
    patterns = {}
    for y in truth:
        votes = "".join("-" if rng.random() < 0.3 else "bg"[int(y == (rng.random() < r))] for r in right)
        patterns[votes] = patterns.get(votes, 0) + 1
    model = quality.LabelModel(patterns)
    assert list(model.accuracies().values()) == pytest.approx(right, abs=0.04) and model.prior == pytest.approx(0.7, abs=0.03)


WORDS = "the of and a to in is it on that by this with you are".split()


def toxic_rows(n, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        words = list(rng.choice(WORDS, 60))
        if k % 4 == 0:
            words[rng.integers(60)] = ("horrible", "nastyface", "vilething")[k % 3]
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    return rows


def test_toxic_words_and_their_misspellings(spark):
    rows = toxic_rows(1200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    held = [r for r in toxicity.score(docs, model=model).collect() if r["held_out"]]
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.97
    clean = " ".join(WORDS * 50)
    low, high = model.score([clean.encode(), (clean + " horribble nastyfase " + clean).encode()])
    assert low < 0.3 <= high


def test_toxicity_on_the_table(spark):
    docs, labels = table(spark, f"{DATA}/sf0.1", "documents"), table(spark, f"{DATA}/sf0.1", "labels")
    docs = docs.join(labels.select("doc_id"), "doc_id")
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = [r for r in toxicity.score(docs, labels).collect() if r["doc_id"] in truth and r["held_out"]]
    hit = [r["predicted"] for r in rows if truth[r["doc_id"]]]
    clean = [r["predicted"] for r in rows if not truth[r["doc_id"]]]
    assert np.mean(hit) > 0.75 and np.mean(clean) < 0.05  # a tenth of the labels are noise


def test_toxicity_cases(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, labels).collect()} == {0.0}
    rows = toxic_rows(200)
    model = toxicity.fit(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    found = toxicity.score(docs, model=model).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    assert toxicity.score(docs.where("false"), model=model).count() == 0
    assert len(model.score([LONG.encode() * 20])) == 1


def test_spread_in_pieces_is_the_same():
    raw, starts = subword.joined([b"some text", b"", b"other text here", b"x" * 300])
    whole, parts = subword.spread(raw, starts, (2, 3, 4), 12), subword.spread(raw, starts, (2, 3, 4), 12, limit=10)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_the_fitted_threshold_rejects_as_it_is(spark):
    model = langid.Model(["de", "en"], np.zeros(((1 << langid.BITS) + 1, 2), dtype=np.float32), np.log([0.3, 0.7]), threshold=0.8)
    docs = documents(spark, [(1, "some words", "en", "a")])
    (r,) = langid.identify(docs, model).collect()
    assert (r["lang_pred"], r["rejected"]) == ("en", True) and r["score"] == pytest.approx(0.7)
    assert langid.keep(docs, model).count() == 0
    model.threshold = 0.6
    assert not langid.identify(docs, model).first()["rejected"] and langid.keep(docs, model).count() == 1


def test_much_shuffled_text_is_rejected(spark, lang_model, medium):
    texts = [r["text"] for r in table(spark, medium, "documents").where("text <> ''").collect()]
    junk = [langid.shuffled(langid.prepared(t)[::-1].decode("utf-8", "ignore").encode()).decode() for t in texts if len(t) > 200]
    rejected = lambda found: np.mean([n == langid.UNKNOWN or s < lang_model.threshold for n, s in zip(*lang_model.predict(found))])
    assert rejected(junk) > 0.3 and rejected(texts) < 0.01


def test_packed_grams_are_the_shares():
    rng = np.random.default_rng(4)
    rows = [("xx", *langid.packed("".join(rng.choice(list("abcé \U0001f600"), n)).encode())) for n in (1, 7, 900, 4000)] + [("yy", *langid.packed(("\U0001f600" * 4000).encode()))]
    at, buckets, shares = langid.sparse(rows)
    for k, n in enumerate((1, 7, 900, 4000)):
        assert shares[at == k].sum() == pytest.approx(1, rel=1e-4) or n == 1
    data = b"the cat and the other cat"
    _, b, s = subword.spread(*subword.joined([data]), langid.ORDERS, langid.BITS)
    own = langid.packed(data)
    _, buckets, shares = langid.sparse([("en", *own)])
    assert (buckets == b).all() and (shares == s).all()
    data = "".join(rng.choice(list("abcdefghij "), 4000)).encode()
    _, b, s = subword.spread(*subword.joined([data]), langid.ORDERS, langid.BITS)
    assert 4 * sum(map(len, langid.packed(data)[:2])) < b.nbytes + s.nbytes  # what the driver got of a window before
