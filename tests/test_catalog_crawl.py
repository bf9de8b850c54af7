"""Sections named by headings, the queue of a section, candidates and kept matches."""

import json

from pyspark.sql import functions as F

from gondola import schemas
from gondola.operators import pages
from gondola.plans import catalog
from tests.test_functions import ITEM, PAGE


def landed(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], schemas.PAGE)


def test_headings_name_sections(spark):
    html = """<header><h2>Menu topo</h2><a href="/listar/top">x</a></header>
    <div><section class="a"><h2>Bebidas</h2><p><a href="/x1">ver tudo</a><a href="/x2">nada</a></p></section>
    <section><h2>Minha conta</h2><a href="/x3">ver tudo</a></section><section><h3>Frios</h3><a href="/produto/9">ver mais</a></section></div>
    <a href="/categoria/z">Zeta</a>"""
    df = landed(spark, [("http://loja.com/", html)])
    got = {r["href"]: (r["text"], r["score"]) for r in pages.sections(pages.links(df), 5, pages.headings(df)).collect()}
    assert got["http://loja.com/x1"] == ("Bebidas", 114) and got["http://loja.com/categoria/z"] == ("Zeta", 28)
    assert got["http://loja.com/x3"] == ("ver tudo", 8) and len(got) == 3  # its heading is an account's, its own text is not


def test_related_links_join_the_queue(spark):
    link = lambda *to: "".join(f'<a href="{u}">produtos</a>' for u in to)
    many = [f"/s/listar/{k:02}" for k in range(20)]
    df = landed(spark, [("http://loja.com/s", link(*many)), ("http://loja.com/s/listar/00", link("/s/listar/03", "/s/listar/extra")), ("http://loja.com/s/listar/01", link("/s/listar/extra", "/s/listar/last"))])
    sections = spark.createDataFrame([("s", "S", "http://loja.com/s", "http://loja.com/s", 0)], "sectionId string, sectionLabel string, sectionUrl string, pageUrl string, place int")
    rows = catalog.section_queue(sections, pages.links(df), 4).orderBy("place").collect()
    assert [r["pageUrl"].removeprefix("http://loja.com") for r in rows] == ["/s", *many[:12], "/s/listar/extra", "/s/listar/last"]
    assert [r["place"] for r in rows] == list(range(15))
    assert catalog.section_queue(sections, pages.links(df), 1).count() == catalog.visit_cap(1)


def test_catalogue_reads_pages_that_were_found(spark):
    df = landed(spark, [("http://loja.com/s", '<a href="/s/listar/1">produtos</a>'), ("http://loja.com/s/listar/1", PAGE)])
    sections = spark.createDataFrame([("s", "S", "http://loja.com/s", "http://loja.com/s", 0)], "sectionId string, sectionLabel string, sectionUrl string, pageUrl string, place int")
    none = spark.createDataFrame([], "page_url string, seq int, url string, content_type string, body string")
    assert "Arroz 5kg" in {r["name"] for r in catalog.catalogue(df, none, sections).collect()}


def test_candidates_and_kept_matches(spark):
    items = lambda n: json.dumps([{**ITEM, "id": k, "nome": f"Item {k}"} for k in range(n)])
    df = landed(spark, [("http://a.com/x", "<p>a"), ("http://b.com/x", '<a href="/catalogo/1">produtos</a>'), ("http://p.com/best", "<p>a")])
    captures = spark.createDataFrame([(u, k, f"{u}/api/products", "application/json", items(n)) for u, k, n in (("http://a.com/x", 0, 6), ("http://b.com/x", 0, 2), ("http://p.com/best", 0, 9))] + [("http://a.com/x", k, f"http://a.com/api/products/{k}", "application/json", items(3)) for k in range(1, 12)], "page_url string, seq int, url string, content_type string, body string")
    inputs = spark.createDataFrame([("http://a.com/x", "arroz", None), ("http://b.com/x", "arroz", "http://p.com/best")], "inputUrl string, query string, profileUrl string")
    rows = catalog.investigated(inputs, df, captures).orderBy("inputUrl", "seq").collect()
    assert [r["url"] for r in rows if r["inputUrl"] == "http://a.com/x"] == ["http://a.com/x"]
    b = [r for r in rows if r["inputUrl"] == "http://b.com/x"]
    assert 2 < len(b) <= 8 and [r["url"] for r in b if r["best"]] == ["http://p.com/best"] and b[1]["n_items"] == 9
    kept = pages.payload_matches(captures).where(F.col("page_url") == "http://a.com/x").orderBy("rank").collect()
    assert len(kept) == 8 and [r["score"] for r in kept] == sorted((r["score"] for r in kept), reverse=True)
