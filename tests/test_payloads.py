"""JSON walks and products in Spark against the plain version."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gondola.functions import payloads, urls
from gondola.functions.urls import join_url
from tests import plain_payloads
from tests.test_functions import ITEM


def bodies(seed: int, n: int) -> list:
    """JSON of any shape whose keys are often those of products."""
    rng = random.Random(seed)
    keys = ["name", "nome", "price", "pricing", "promotionalPrice", "id", "url", "slug", "image", "tags", "items", "products", "data", "oferta", "preco_antigo", "unidade", "discount", "limit", "clube", "em_oferta", "x", "y.z", "promotion", "title"]
    scalars = [None, True, False, 0, 7, 12.5, -3, "", "Arroz 5kg", "R$ 5,99", "9,99", "/i.png", "slug-1", "https://b/x", "limite 3 por cpf", "é   ü", "{\"a\":1}", "[1]", "imgs/q.png", "../up/x", "store1: y"]

    def value(depth):
        kind = rng.random()
        if depth > 7 or kind < 0.35:
            return rng.choice(scalars)
        if kind < 0.6:
            return [value(depth + 1) for _ in range(rng.choice([0, 1, 2, 3, 7, 22]))]
        return {rng.choice(keys): value(depth + 1) for _ in range(rng.choice([0, 1, 3, 6, 9]))}

    product = lambda: {**{k: rng.choice(scalars) for k in rng.sample(keys, 8)}, "nome": rng.choice(["Café", "R$ 3,00 pão", "Leite  1L", ""]), "preco": rng.choice([1, "2,50", None, "abc"]), "slug": rng.choice(["a-b", "", "A B"])}
    return [value(0) for _ in range(n)] + [{"data": {rng.choice(keys): [product() for _ in range(rng.randint(0, 6))]}} for _ in range(n)] + [{f"k{i}": {"v": i, "w": None} for i in range(100)}, [[[[[[[[1, {"a": 2}]]]]]]]], ITEM, [ITEM, dict(ITEM, id=8)]]


def frame(spark, found):
    return spark.createDataFrame([(k, json.dumps(b, ensure_ascii=False), "https://a/search/x?q=1") for k, b in enumerate(found)], "k int, body string, url string").repartition(4)


def test_flat_json_equals_plain(spark):
    found = bodies(3, 60)
    got = {r["k"]: [(f["path"], f["vtype"], f["value"]) for f in r["f"]] for r in frame(spark, found).select("k", payloads.flat_json("body").alias("f")).collect()}
    for k, b in enumerate(found):
        want = [(p, plain_payloads._kind(v), v if isinstance(v, str) else json.dumps(v)) for p, v in plain_payloads.flatten(b)]
        assert got[k] == want, b


def test_products_equal_plain(spark):
    found = bodies(4, 40)
    rows = frame(spark, found).select("k", payloads.found_arrays("body", "url").alias("a")).collect()
    total = 0
    for r in rows:
        want = plain_payloads.product_arrays(found[r["k"]], "https://a/search/x?q=1")
        assert [(a["path"], a["score"]) for a in r["a"]] == [(a["path"], a["score"]) for a in want], found[r["k"]]
        for a, b in zip(r["a"], want):
            for x, y in zip(a["items"], b["items"]):
                assert x.asDict() == y
            total += len(a["items"])
    assert total > 60


def test_broken_and_empty_bodies(spark):
    rows = spark.createDataFrame([("not json",), (None,), ("",), ('{"a": 1',), ("3",), ('"x"',), ("null",), ("[]",), ("{}",), (' [ {"a": 1} ] ',)], "body string")
    got = rows.select(F.size(payloads.flat_json("body")).alias("n"), F.size(payloads.found_arrays("body", F.lit("u"))).alias("m")).collect()
    assert [r["n"] for r in got] == [0] * 9 + [1] and {r["m"] for r in got} == {0}


def test_no_python_in_the_plan(spark):
    rows = frame(spark, [ITEM]).select(payloads.found_arrays("body", "url").alias("a"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("base", ["https://a.com/x/y/z.html?q=1#f", "http://a.com", "http://A.com/", "x", None])
def test_joined_links_equal_plain(spark, base):
    values = ["/i.png", "i.png", "../i.png", "./a/./b", "../../../../q", "//c.com/x", "https://b.com/x/../y", "mailto:x@y", "?a=b", "#top", " /t ", "", None, "a/b?c=../d", "/a/..", "..", "javascript:void(0)"]
    rows = spark.createDataFrame([(k, v, base) for k, v in enumerate(values)], "k int, v string, base string").select("k", urls.joined(F.col("v"), F.col("base")).alias("u")).collect()
    got = {r["k"]: r["u"] for r in rows}
    for k, v in enumerate(values):
        want = join_url(v, base) if base and "/" in base or not (v or "").startswith("//") else None  # no scheme to take over
        assert got[k] == want or (base and base.count("/") == 2 and got[k].replace("com/?", "com?").replace("com/#", "com#") == want), (v, got[k], want)
