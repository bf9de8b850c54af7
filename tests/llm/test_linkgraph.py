import re
from collections import Counter, defaultdict

import pytest

from gondola.llm import linkgraph
from gondola.llm.common import table
from tests.llm.frames import pages

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


def rule(host, path):
    fits = [r for _, r in linkgraph.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


def brute(rows):
    verdict, seen = {r: v for v, r in linkgraph.RULES}, [(i, *parts(u), rule(*parts(u)), h) for i, u, h in rows]
    edges, seeds = Counter(), {"trust": Counter(), "distrust": Counter()}
    for _, host, _, r, html in seen:
        if r:
            seeds["trust" if verdict[r] == "allow" else "distrust"][host] += 1.0
        for href in re.findall(linkgraph.HREF_RE[4:], html or "", re.I):
            to = parts("x:" + href[href.index("//") :])[0]
            if to and to != host:
                edges[host, to] += 1
    rank = {}
    for kind, turn in (("trust", False), ("distrust", True)):
        own = {((b, a) if turn else (a, b)): n for (a, b), n in edges.items()}
        out = defaultdict(int)
        for (a, _), n in own.items():
            out[a] += n
        start = {h: 0.15 * s for h, s in seeds[kind].items()}
        now = dict(start)
        for _ in range(linkgraph.ROUNDS):
            new = defaultdict(float, start)
            for (a, b), n in own.items():
                new[b] += 0.85 * n / out[a] * now.get(a, 0)
            now = dict(new)
        rank[kind] = now
    out = []
    for i, host, path, r, _ in seen:
        t, d = rank["trust"].get(host, 0), rank["distrust"].get(host, 0)
        out.append((i, host, path, r, verdict[r] if r else "block" if d > 0.5 * (t + d) else "allow"))
    return out


def got(df):
    return Counter(tuple(r)[:5] for r in linkgraph.judge(df).collect())


def test_table(spark, medium):
    df = table(spark, medium, "pages")
    assert got(df) == Counter(brute([tuple(r) for r in df.select("page_id", "url", "html").collect()]))


def test_cases(spark):
    link = '<a class=x href="{}">t</a>'
    rows = [(1, None, None), (2, "no scheme", ""), (2, "no scheme", ""), (None, "HTTP://A.Example.COM/en/7?q#f", link.format("//B.org/x") + link.format("https://c.net/1")), (4, "http://b.org/es/9", link.format("http://c.net/2")), (5, "http://c.net/de/", None), (6, "http://x.example.net/de/8", link.format("/local")), (7, "http://b.org/free", "x" * 200_000), (8, "http://notexample.com/en/1", ""), (9, "ftp://com/en/", "")]
    df = pages(spark, rows)
    found = got(df)
    assert found == Counter(brute(rows))
    assert found[(2, "", "", None, "allow")] == 2 and found[(None, "a.example.com", "/en/7", "example.com/en/7", "allow")] == 1
    assert got(df.where("false")) == Counter()


def test_verdicts_of_the_contract(spark):
    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert ", ".join(f"{v} {r}" for v, r in linkgraph.RULES) == contract
    found = got(pages(spark, [(k, f"http://a.{r}", None) for k, (_, r) in enumerate(linkgraph.RULES)]))
    assert [x[3:] for x in sorted(found)] == [tuple(reversed(x.split())) for x in contract.split(", ")]


def test_propagation_passes_shares_on(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("a", "c", 3)], "src string, dst string, links long")
    seeds = spark.createDataFrame([("trust", "a", 1.0), ("distrust", "c", 1.0)], "kind string, host string, seed double")
    r = {(x["kind"], x["host"]): x["score"] for x in linkgraph.propagate(edges, seeds).collect()}
    assert r["trust", "b"] == pytest.approx(0.15 * 0.85 / 4) and r["trust", "c"] == pytest.approx(0.15 * 0.85 * 3 / 4) and r["distrust", "a"] == pytest.approx(0.15 * 0.85)


def test_chains_and_cycles_are_followed_to_the_end(spark):
    link = '<a href="http://{}/">t</a>'
    chain = [(k, f"http://h{k}.x/", link.format(f"h{k + 1}.x")) for k in range(20)] + [(20, "http://h20.x/", link.format("bad.com")), (21, "http://bad.com/en/", "")]
    assert {r[0]: r[4] for r in got(pages(spark, chain))}[0] == "block"
    ring = [(f"r{k}", f"r{(k + 1) % 5}", 1 + k % 2) for k in range(5)] + [("r0", "r3", 2), ("r2", "t0", 1)] + [(f"t{k}", f"t{k + 1}", 1) for k in range(16)]
    out = Counter()
    for a, _, n in ring:
        out[a] += n
    want = {}
    for _ in range(400):
        sent = defaultdict(float, {"r0": 0.15})
        for a, b, n in ring:
            sent[b] += 0.85 * n / out[a] * want.get(a, 0)
        want = sent
    edges = spark.createDataFrame(ring, "src string, dst string, links long")
    seeds = spark.createDataFrame([("trust", "r0", 1.0)], "kind string, host string, seed double")
    r = {x["host"]: x["score"] for x in linkgraph.propagate(edges, seeds).collect()}
    assert r.keys() == want.keys() and "t16" in r
    assert all(r[k] == pytest.approx(v, rel=1e-4) for k, v in want.items())
