"""Semantic vectors of the functions."""

import time

import pytest
from pyspark.sql import functions as F

from gondola.functions import badges, cards, payloads, prices, text, urls
from tests import plain_cards, plain_payloads
from gondola.operators import cities

NBSP = " "


def one(spark, column, value, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "value, generic, shelf",
    [
        ("R$ 1.299,90", 1299.9, 1299.9), ("1,299.90", 1299.9, 1.299), ("R$ 5,99", 5.99, 5.99), ("1.299", 1.299, 1299.0), ("12.5", 12.5, 12.5), ("1,2,3", 1.23, 1.2),
        ("-15%", -15.0, None), ("R$ 0,00", 0.0, None), ("10-20", 10.0, 10.0), ("abc", None, None), ("", None, None), ("S.A. 5", None, None), (None, None, None), (f"R${NBSP}7,50", 7.5, 7.5),
    ],
)
def test_parse_price(spark, value, generic, shelf):
    assert one(spark, prices.parse_price, value) == generic
    assert one(spark, prices.parse_shelf_price, value) == shelf
    assert plain_payloads.price_of(value or None) == generic


@pytest.mark.parametrize("value, want", [(1.005, "R$ 1,00"), (0.125, "R$ 0,13"), (0.375, "R$ 0,38"), (1299.9, "R$ 1299,90"), (2.5, "R$ 2,50"), (0.0, "R$ 0,00")])
def test_format_price(spark, value, want):
    assert one(spark, prices.format_price, value, "double") == want


@pytest.mark.parametrize("value, want", [("12,5", "R$ 12,50"), ("gratis", "gratis"), ("a partir R$ abc", "a partir R$ abc"), ("", None)])
def test_format_price_text(spark, value, want):
    assert one(spark, prices.format_price_text, value) == want


@pytest.mark.parametrize("given, current, original, want", [(None, 5.99, 7.99, 25), (None, 10.0, 16.0, 38), (None, 7.75, 8.0, 3), ("0", 5.0, 10.0, 0), ("-15%", 5.0, 10.0, -15), (None, 8.0, 8.0, None), ("-2.5", None, None, -2)])
def test_discount(spark, given, current, original, want):
    df = spark.createDataFrame([(given, current, original)], "g string, c double, o double")
    assert df.select(prices.discount_percent(F.col("g"), F.col("c"), F.col("o"))).first()[0] == want


def test_price_state(spark):
    s = one(spark, lambda x: prices.price_state(x, 3), "de R$ 7,99 por R$ 5,99")
    assert (s["current"], s["original"], s["n"]) == (5.99, 7.99, 2)
    assert one(spark, lambda x: prices.price_state(x, 3), "R$ 1,00 R$ 2,00 R$ 3,00 R$ 4,00") is None
    assert one(spark, prices.price_state, "R$ 3,00 R$ 3,00")["original"] is None


@pytest.mark.parametrize("value, slug, folded", [("Páscoa Feliz", "p-scoa-feliz", "pascoa-feliz"), ("https://www.loja.com/a?b=1", "www-loja-com-a-b-1", "https-www-loja-com-a-b-1"), ("  Açúcar  ", "a-car", "acucar"), ("HTTP://x.y", "http-x-y", "http-x-y"), ("a" * 100, "a" * 80, "a" * 100)])
def test_slugs(spark, value, slug, folded):
    assert one(spark, text.slug, value) == slug and one(spark, text.folded_slug, value) == folded


def test_texts(spark):
    assert one(spark, text.clean, f" a{NBSP}\t b\n") == "a b" and one(spark, text.clean, " \n ") is None
    assert one(spark, text.product_text, "Arroz R$ 5,99 5kg") == "Arroz  5kg"
    assert one(spark, text.title_case, "são bento DO sul") == "São Bento Do Sul"
    assert one(spark, text.folded, " ÉÇã ") == "eca"
    assert one(spark, text.first_line, "\n \n b \n c") == "b" and one(spark, text.first_line, " \n") is None
    assert one(spark, text.lines, "a\n\n b\na") == ["a", "b"]
    assert [one(spark, lambda x: text.whole_number(x, 1, 7), v) for v in ("12abc", "0", "x", None)] == [12, 7, 7, 7]
    assert [one(spark, lambda x: text.truth(x, None), v) for v in ("Yes", "off", "maybe")] == [True, False, None]


@pytest.mark.parametrize(
    "label, city, word",
    [
        ("Rede Azul - Balneario Camboriu, Centro", "Balneario Camboriu", "Balneario"), ("Mercado LJ01 - gaspar (Centro)", "Gaspar", "gaspar"), ("Retirar na loja: ILHOTA, SC", "Ilhota", None),
        ("Loja de Blumenau Retirada", "Blumenau", None), ("Cidade: são josé", "São José", None), ("nada", None, None),
    ],
)
def test_city_labels(spark, label, city, word):
    assert one(spark, cities.city_of, label) == city and one(spark, cities.city_first_word, label) == word


def test_coverage(spark):
    rows = [(None, "x"), ("Gaspar", None), ("São José", "SAO JOSE"), ("Gaspar", "Ilhota")]
    df = spark.createDataFrame(rows, "r string, e string").select(cities.coverage(F.col("r"), F.col("e")).alias("c"), cities.eligible(F.col("r"), F.col("e")).alias("ok"))
    assert [tuple(r) for r in df.collect()] == [("default", True), ("unknown", True), ("match", True), ("mismatch", False)]


def test_urls(spark):
    assert one(spark, urls.ensure_scheme, " loja.com ") == "https://loja.com" and one(spark, urls.ensure_scheme, "HTTP://x") == "HTTP://x" and one(spark, urls.ensure_scheme, "  ") is None
    assert one(spark, urls.host, "https://www.Loja.com:8080/a") == "loja.com" and one(spark, urls.host, "not a url") is None
    assert one(spark, lambda u: urls.numbered_pages(u, F.lit(5), 3), "http://a/b?page=9&x=1#f") == ["http://a/b?x=1&page=2", "http://a/b?x=1&page=3"]
    assert one(spark, lambda u: urls.numbered_pages(u, F.lit(1), 3), "http://a/b") == []
    assert one(spark, lambda u: urls.search_candidates(u, F.lit("arroz 5kg")), "http://a/b")[5] == "http://a/busca/arroz%205kg"
    assert [one(spark, lambda u: urls.product_link(u, F.lit("http://a/b/c")), v) for v in ("x-1", "/p/2", "https://z/q", "a b")] == ["http://a/produto/x-1", "http://a/p/2", "https://z/q", None]
    routed = lambda u: urls.adapter(u, F.lit("auto"), {"chain.example": "shelf"})
    assert one(spark, routed, "http://www.chain.example/x") == "shelf" and one(spark, routed, "http://b") == "generic"
    assert one(spark, urls.root_like, "http://a/") and not one(spark, urls.root_like, "http://a/b")


def test_badges_of_long_lists_take_little_time(spark):
    """40,000 rows of 500 words: with every word squeezed, matched and sorted this took minutes of one task."""
    words = F.transform(F.sequence(F.lit(1), F.lit(500)), lambda k: F.concat(F.lit("W"), k.cast("string")))
    rows = spark.range(0, 40_000, 1, 1).select(F.concat(F.array(F.lit("w1 "), F.lit(None), F.lit("R$ 5,00")), F.transform(words, lambda w: F.concat(w, F.col("id").cast("string")))).alias("words"))
    at = time.monotonic()
    assert rows.select(F.size(badges.badge_list(F.col("words"))).alias("n")).where("n <> 8").count() == 0
    assert time.monotonic() - at < 60
    assert one(spark, badges.badge_list, ["w1 ", None, "R$ 5,00", *(f"{c}{k}" for k in range(1, 12) for c in "Ww")], "array<string>") == ["w1", *(f"W{k}" for k in range(2, 9))]


def test_badges(spark):
    values = ["Oferta", "OFERTA", "R$ 5,00", "x", " Clube ", None, ""]
    assert one(spark, badges.badge_list, values, "array<string>") == ["Oferta", "Clube"]
    assert one(spark, badges.product_badges, values, "array<string>") == ["Oferta", "R$ 5,00", "x", "Clube"]
    assert one(spark, badges.club_offer, ["éclube"], "array<string>") is True and one(spark, badges.club_offer, ["clubes"], "array<string>") is False
    assert one(spark, lambda b: badges.campaign_label(F.lit("Promoção"), b), ["PÁSCOA feliz"], "array<string>") == "PÁSCOA feliz"
    assert one(spark, lambda b: badges.product_campaign(F.lit("oferta"), F.lit("Festival de Carnes"), b), ["novo"], "array<string>") == "Festival de Carnes"
    assert one(spark, badges.limit_text, "Máx 3 por CPF") == "Máx 3 por CPF" and one(spark, badges.limit_text, "novo") is None
    assert one(spark, badges.promotion_from_badges, ["desconto", "Clube"], "array<string>") == "Clube"


ITEM = {"id": 7, "nome": "Arroz Tipo 1", "pricing": {"price": "9,99", "promotionalPrice": 7.49, "promotion": {"name": "Festival"}}, "imagem": "/i.png", "slug": "arroz-1", "unidade": "kg", "tags": ["Novo", "R$ 1,00"], "clube": True}


def test_payloads():
    p = plain_payloads.raw_product(ITEM, "https://a/b")
    assert (p["id"], p["name"], p["current"], p["original"], p["promotion"], p["label"], p["unit"]) == ("7", "Arroz Tipo 1", 7.49, 9.99, True, "Festival", "kg")
    assert p["image"] == "https://a/i.png" and p["link"] == "https://a/produto/arroz-1" and p["club"] and p["badges"] == ["Novo", "R$ 1,00", "Festival", "Clube"]
    assert plain_payloads.raw_product({"nome": "Sem preço", "id": 1}, "https://a") is None and plain_payloads.raw_product({"nome": "Sem mais", "preco": 1}, "https://a") is None
    assert plain_payloads.raw_product({"nome": "store12: x", "preco": 1, "id": 1}, "https://a") is None
    (m,) = plain_payloads.product_arrays({"data": {"products": [ITEM, 3, {"x": 1}]}}, "https://a/search")
    assert (m["path"], m["score"], len(m["items"])) == ("$.data.products", 45, 1)
    assert plain_payloads.flatten({"a": [1, {"b": 2}, [3]], "c": None, "d": {"e": {"f": {"g": {"h": 1}}}}}) == [("a", 1), ("a.b", 2), ("a", 3)]
    assert plain_payloads.pick([("x.y.name", "long"), ("name", "short"), ("name", "later")], payloads.NAMES, lambda v: True) == "short"
    assert plain_payloads.pick([("q", "abc")], payloads.NAMES, lambda v: True, any_other=True) == "abc"


PAGE = """<html><title> Loja </title><body><nav><a href="/categorias/x">menu</a></nav><ul>
<li class="card big"><img src=/1.png alt="Foto"><h3>Arroz 5kg</h3><span>R$ 7,99</span><b>R$ 5,99</b><i class=badge>Clube</i><a href="/produto/11/arroz">ver</a>
<li class="card big"><img data-src=/2.png><p class=nome>Feijão preto<span>R$ 8,49</span><a href="/produto/12">ver</a>
<li class="card big" style="display: none"><h3>Oculto</h3><span>R$ 1,00</span></li></ul><a href="/categorias/y"><img src=z> Todos os produtos</a></body></html>"""


def test_cards_of_unclosed_html():
    found = dict(cards.page_groups(PAGE))["li.card.big"]
    assert [(c["id"], c["name"], c["current"], c["original"], c["link"], c["image"]) for c in found] == [("11", "Arroz 5kg", 5.99, 7.99, "/produto/11/arroz", "/1.png"), ("12", "Feijão preto", 8.49, None, "/produto/12", "/2.png")]
    assert "Clube" in found[0]["badges"] and found[0]["promotion"]
    assert cards.page_groups(None) == [] and cards.page_groups("<p>no cards R$ 1,00") == []


def test_extraction_config():
    config = {"pageText": True, "fields": {"title": {"type": "pageTitle"}, "url": {"type": "pageUrl"}, "has": {"selector": "li.card h3", "type": "exists"}, "all": {"selector": "li.card a", "type": "href", "multiple": True}}, "collection": {"selector": "li.card", "limit": 2, "fields": {"img": {"selector": "img", "type": "src"}, "none": {"selector": "em"}}}}
    out = plain_cards.extract(PAGE, config, "http://a")
    assert out["title"] == "Loja" and out["url"] == "http://a" and out["has"] and out["all"] == ["/produto/11/arroz", "/produto/12"]
    assert out["collection"] == [{"img": "/1.png", "none": None}, {"img": None, "none": None}] and "Arroz" in out["pageText"]
    with pytest.raises(ValueError):
        plain_cards.extract(PAGE, {"fields": {"x": {"type": "odd"}}})
