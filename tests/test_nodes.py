"""Links, headings and extracted fields in Spark against walks of the tree."""

import json
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gondola import shop_queries  # noqa: F401 registers its queries
from gondola.functions import cards
from gondola.functions.urls import join_url
from gondola.operators import nodes
from gondola.queries import ORACLE_SQL, QUERIES
from tests import plain_cards
from tests.test_functions import PAGE


def htmls() -> list:
    rng = random.Random(6)
    tags = ["div", "section", "article", "ul", "li", "p", "a href=/x", "a href='https://b/y?z'", "a", "span class='title big'", "h2", "h3 class=heading", "div class='shelf x'", "div class=carousel-a", "nav", "header", "img src=/i.png alt=foto", "b hidden", "i style='display: none'", "td", "tr", "table", "script", "div id=top data-k='v w'", "br"]
    words = ["Arroz", " ", "R$ 5,00", "Ver   tudo", "&amp; mais", "Categoria de coisas", "x" * 90, "\n"]

    def some(depth):
        out = ""
        for _ in range(rng.randint(0, 5)):
            tag = rng.choice(tags)
            close = f"</{tag.split()[0]}>" if rng.random() < 0.85 else ""
            out += rng.choice(words) + f"<{tag}>" + (some(depth + 1) if depth < 6 else "") + rng.choice(words) + close
        return out

    return [PAGE, None, "", "no tags", "<p>open <b>ends", *(some(0) for _ in range(60))]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(k, "http://loja.example/a/b?c", h) for k, h in enumerate(htmls())], "page_id long, url string, html string").repartition(3).cache()


def test_labels_are_intervals():
    for html in htmls():
        found, texts = nodes.labelled(html)
        for x in found:
            inside = [y["at"] for y in found if x["at"] in y["above"]]
            assert inside == list(range(x["at"] + 1, x["last"] + 1))
            assert x["n_links"] == sum(found[i]["tag"] == "a" and bool(found[i]["attrs"].get("href")) for i in inside)


def test_links_equal_walks(pages):
    got = {(r["page_id"], r["seq"]): (r["href"], r["text"], r["has_image"], r["in_frame"]) for r in nodes.links(pages).collect()}
    want = {}
    for k, html in enumerate(htmls()):
        for seq, x in enumerate(plain_cards.page_links(cards.tree(html))):
            if href := join_url(x["href"], "http://loja.example/a/b?c"):
                want[k, seq] = (href, x["text"], x["has_image"], x["in_frame"])
    assert got == want and len(want) > 100


def test_headings_equal_walks(pages):
    got = {(r["page_id"], r["heading"]): (r["label"], [(p["first"], p["last"]) for p in r["places"]]) for r in nodes.headings(pages).collect()}
    want = {(k, i): (h["label"], h["places"]) for k, html in enumerate(htmls()) for i, h in enumerate(plain_cards.headings(cards.tree(html)))}
    assert got == want and len(want) > 50 and any(len(p) > 1 for _, p in want.values())


CONFIG = {
    "pageText": True,
    "fields": {
        "title": {"type": "pageTitle"}, "url": {"type": "pageUrl"}, "first": {"selector": "div a", "type": "href"}, "all": {"selector": "section .title", "multiple": True}, "top": {"selector": "#top[data-k]", "type": "exists"}, "deep": {"selector": "div div a[href]", "type": "html", "multiple": True},
        "kv": {"selector": "div[data-k='v w']", "type": "attribute", "attribute": "data-k"}, "img": {"selector": "*[alt=foto]", "type": "src"}, "odd": {"selector": "a:hover"},
    },
    "collection": {"selector": "li", "limit": 4, "fields": {"text": {}, "links": {"selector": "a", "type": "href", "multiple": True}, "b": {"selector": "b", "type": "exists"}}},
}


def test_extraction_equals_walks(pages):
    got = {r["page_id"]: json.loads(r["data"]) for r in nodes.extracted(pages, CONFIG).collect()}
    for k, html in enumerate(htmls()):
        assert got[k] == plain_cards.extract(html, CONFIG, "http://loja.example/a/b?c"), html
    with pytest.raises(ValueError):
        nodes.extracted(pages, {"fields": {"x": {"type": "odd"}}})


def test_html_is_kept_on_request(pages):
    got = nodes.extracted(pages, {"pageHtml": True}).where(F.col("page_id") == 4).first()["data"]
    assert json.loads(got) == {"pageHtml": "<p>open <b>ends"}


CUT = "<html><head><title>Um&amp;&amp; dois&amp</title></head><body><h1>Um&amp;&amp; dois&amp</h1><h2>a &lt;b &copy; &ampx; &#38; &l</h2><a href='/x?a=1&amp;b=2&copy=3'>ver</a></body></html>"


@pytest.mark.parametrize("name", ["page_headings", "page_extraction"])
def test_cut_references_are_as_in_the_sql(spark, tmp_path, name):
    rows = [(1, "http://a.example/b", CUT.replace("<h2>", "<!--").replace("</h2>", "-->")), (2, "http://a.example/c", "<title>x &lt y</title><h1>x &lt y</h1>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = {repr(tuple(r)[:3]) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == {repr(r[:3]) for r in con.sql(ORACLE_SQL[name]).fetchall()}


def test_references_without_semicolons(spark):
    df = spark.createDataFrame([(1, "http://a.example/b", CUT)], "page_id long, url string, html string")
    labels = lambda bare: [r["label"] for r in nodes.headings(df, bare).orderBy("heading").collect()]
    assert labels(True) == ["Um&& dois&", "a <b © &x; & &l"] and labels(False) == ["Um&& dois&amp", "a <b © &ampx; & &l"]


def test_few_pages_are_held_unpacked():
    """Pages leave a worker in small parts, by number and by size, before more of a batch are parsed."""
    html = ["<a href='/x' class='c'>A</a>"] * 120 + [None, ""] + ["<p>" + "x" * 700_000 + "</p>"] * 5
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(len(html))), "url": ["http://a.com/"] * len(html), "html": html})
    out = list(nodes.unpacked(iter([batch, batch.slice(0, 3), batch.slice(0, 0)]), ["page_id", "url"]))
    assert [b.num_rows for b in out] == [50, 50, 24, 2, 1, 3]
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["page_id"] for r in rows] == [*range(len(html)), 0, 1, 2]
    for r in rows:
        for x in r["nodes"]:
            x["attrs"] = dict(x["attrs"])
        assert (r["nodes"], r["texts"]) == nodes.labelled(html[r["page_id"]])
