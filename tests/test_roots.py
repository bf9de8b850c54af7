"""Discovery of roots against a plain loop over a queue."""

import random

import pytest
from pyspark.sql import functions as F

from gondola import shared
from gondola.plans import roots


def plain(starts, ways, score, budget):
    out = []
    for site in sorted({s for s, _, _ in starts if s}):
        queue = []
        for _, u, _ in sorted((x for x in starts if x[0] == site and x[1]), key=lambda x: x[2]):
            queue += [u] if u not in queue else []
        known, place, at = set(queue), {u: k for k, u in enumerate(queue)}, 0
        while queue and at < budget:
            queue.sort(key=lambda u: (-score(u), place[u]))
            u, at = queue.pop(0), at + 1
            out.append((site, u, at))
            for _, to, _ in sorted((x for x in ways if x[0] == u and x[1]), key=lambda x: x[2]):
                if to not in known:
                    known.add(to)
                    place[to] = len(place)
                    queue.append(to)
    return out


@pytest.mark.parametrize("best_first", [False, True])
def test_inspected_as_a_plain_queue(spark, best_first):
    rng = random.Random(5)
    name = lambda: "u" * rng.randint(1, 4) + str(rng.randint(0, 9))
    starts = [(f"s{k % 5}", name(), k) for k in range(14)] + [("s0", None, 90), (None, "u1", 91)]
    ways = [(name(), name(), k) for k in range(120)] + [("u1", None, 200)]
    links = spark.createDataFrame(ways, "url string, href string, nth int").withColumn("site", F.lit("other"))
    got = roots.inspected(spark.createDataFrame(starts, "site string, url string, place int"), links, F.lit(True), F.length("url") if best_first else None, 6)
    want = plain(starts, ways, len if best_first else (lambda u: 0), 6)
    assert sorted(map(tuple, got.select("site", "url", "at").collect())) == sorted(want)


def test_root_of_each_site(spark, tmp_path):
    sites = spark.createDataFrame([("http://a.com/", ["http://a.com/busca"]), ("http://b.com/", None)], "site string, preferred array<string>")
    starts = roots.candidates(sites)
    assert [r["url"] for r in starts.where("site like '%a.com/'").orderBy("place").limit(3).collect()] == ["http://a.com/busca", "http://a.com/", "http://a.com/produtos"]
    links = spark.createDataFrame([], "url string, href string, nth int")
    visited = roots.inspected(starts, links)
    assert [r["count"] for r in visited.groupBy("site").count().collect()] == [10, 10]
    landed = spark.createDataFrame([("http://a.com/categorias", "http://a.com/categorias/", "network", 30, 5), ("http://a.com/busca", "http://a.com/login", "dom", 30, 5)], "url string, finalUrl string, strategy string, n_items long, n_links long")
    found = {r["site"]: (r["rootUrl"], r["score"], r["inspected"]) for r in roots.chosen(roots.scored(visited, landed)).collect()}
    assert found == {"http://a.com/": ("http://a.com/categorias/", 270 + 35 + 30 + 180 + 32, 10), "http://b.com/": ("http://b.com/categorias", 180, 10)}


def test_empty_and_scratch_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "folder", lambda spark: f"file://{tmp_path}")
    starts, links = spark.createDataFrame([], "site string, url string, place int"), spark.createDataFrame([], "url string, href string, nth int")
    assert roots.inspected(starts, links).isEmpty()
    assert [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()] == ["root-inspected"]
