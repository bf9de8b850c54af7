"""Additive scores of URLs, links, sections and places: a list of patterns and weights each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gondola.functions import urls

# Patterns and what a match adds.
THEMED = "promoc|oferta|festival|clube|barato|carne|páscoa|pascoa"
INSTITUTIONAL = "formas-de-pagamento|pagamento|institucional|privacidade|cookie|contato|fale-conosco|blog|login|conta"
PRODUCT_PAGE = r"/produto/|/produtos/\d+|/p/|sku=|product_id="
PAGE_MARK = r"page=|pagina=|/page/\d+"
ACCOUNT = "login|conta|institucional|blog|contato|faq|privacidade|cookie|carrinho|cart|favorito|wishlist|formas-de-pagamento|pagamento"
SECTION_NOT = ACCOUNT + "|checkout"
SECTION_PRODUCT = r"/produto/|/p/|sku=|product_id="
SECTION_ABLE = "categoria|categorias|departamento|departamentos|secao|secoes|setor|catalog|category|department|shop|produto|produtos|mercado|promoc|ofertas?|festival|clube|especial|barato|carne|páscoa|pascoa|ver mais|ver tudo"
ROOT = (("categorias?|category|departamentos?|department", 180), ("produt|catalog|shop|listar", 60), ("oferta|encarte|promoc", -140), (INSTITUTIONAL, -420))
ROOT_INPUT = "categor|depart|produt|catalog|shop|busca"
ROOT_LANDED = "formas-de-pagamento|pagamento|institucional|privacidade|contato|blog|login"
SECTION = (("departamento|departamentos|department", 25), ("categoria|categorias|category", 20), ("produtos|catalog|shop", 12), (THEMED, 22))
SECTION_LINK = (("ver mais|ver tudo|mostrar mais|mostrar tudo", 34), (THEMED, 22), ("categor|depart|produt|busca|search|shop|listar", 18))
RELATED = (("todos os produtos|ver tudo|mostrar tudo", 42), ("ver mais|mostrar mais|mais produtos", 34), ("categoria|subcategoria|departamento", 20))
RELATED_LINK = (("/categorias?/", 16), (PAGE_MARK, 18))
RELATED_ABLE = r"page=|pagina=|/page/\d+|ver mais|mostrar mais|mais produtos|todos os produtos|ver tudo|mostrar tudo|categoria|subcategoria|departamento|produt|busca|search|shop|listar"
SECTION_RELATED = ((PAGE_MARK, 22), ("categor|subcategor|depart|busca|search|shop|produt|listar", 18), ("ver-mais|mostrar-mais|todos|tudo", 10), ("oferta|promoc|encarte", -28))
DISCOVERED = (("listar todos os produtos", 40), ("todos os produtos|ver tudo|mostrar tudo", 34), ("ver mais|mostrar mais|mais produtos", 28), ("produtos", 20), ("categoria|departamento|subcategoria", 18), ("ofertas|encarte", 6))
DISCOVERED_LINK = (("/categorias?/", 16), ("/departamentos?/", 12))
DISCOVERED_ABLE = "produto|produtos|oferta|ofertas|encarte|categoria|catalog|departamento|buscar|busca|search|listar|shop|loja|todos os produtos|ver mais|mostrar mais|mais produtos|ver tudo|subcategoria|colec"
DISCOVERED_NOT = "carrinho|cart|login|conta|privacidade|cookie|instagram|facebook|linkedin|blog|carreiras|fornecedor|contato|fale|portal|formas-de-pagamento|pagamento|institucional|quem-somos"
TRIGGER = (("cidade|loja|retirar|unidade|alterar loja|trocar loja|selecione sua cidade|onde voce esta|entrega", 80), ("retirar na loja|loja de|selecionar cidade|alterar cidade", 80), ("institucional|blog|contato|login|cadastre|fornecedor|trabalhe", -120))
IGNORED_CAPTURES = r"google-analytics|analytics\.google|doubleclick|googletagmanager|newrelic|recaptcha|onesignal|facebook|hotjar|clarity|bing|cloudflare|font|maps\.google|zendesk|zopim|vlibras|nr-data"


def like(x: Column, pattern: str) -> Column:
    return F.coalesce(x, F.lit("")).rlike(f"(?iu)(?:{pattern})")


def points(able: Column, weight: int) -> Column:
    return F.when(able, weight).otherwise(0)


def total(x: Column, rules: tuple) -> Column:
    out = F.lit(0)
    for pattern, weight in rules:
        out = out + points(like(x, pattern), weight)
    return out


def both(a: Column, b: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def catalog_link(url: Column) -> Column:
    """Whether a URL looks like a catalogue and not like offers."""
    return like(url, "depart|categoria|produt|catalog|shop|listar") & ~like(url, "oferta|encarte|promoc")


def discovered_able(href: Column, text: Column, origin: Column) -> Column:
    hay = both(href, text)
    return href.startswith(origin) & like(hay, DISCOVERED_ABLE) & ~like(hay, DISCOVERED_NOT)


def root_score(url: Column, input_url: Column, strategy: Column, n_items: Column, n_links: Column) -> Column:
    score = 9 * F.least(n_items, F.lit(120)) + 7 * F.least(n_links, F.lit(40)) + points(strategy == "network", 30) + total(url, ROOT)
    return score + points(url.endswith("/") & (n_items > 20), 32) + points(like(input_url, ROOT_INPUT) & like(url, ROOT_LANDED), -240)


def section_score(label: Column, url: Column, has_image: Column) -> Column:
    return total(both(label, url), SECTION) + points(has_image, 10) + points(F.length(label).between(3, 80), 8)


def section_link_score(text: Column, href: Column, has_image: Column) -> Column:
    return total(both(text, href), SECTION_LINK) + points(has_image, 10)


def related_score(text: Column, href: Column, current: Column) -> Column:
    return total(both(text, href), RELATED) + total(href, RELATED_LINK) + points(href.startswith(F.regexp_replace(current, "/+$", "")), 14)


def related_section_score(href: Column, section: Column) -> Column:
    """-1 for other origins, product and account pages."""
    link, own = urls.ensure_scheme(href), urls.ensure_scheme(section)
    link_path, own_path = (F.regexp_replace(urls.path(u), "/+$", "") for u in (link, own))
    barred = ~urls.origin(link).eqNullSafe(urls.origin(own)) | like(link, PRODUCT_PAGE) | like(link, ACCOUNT)
    return F.when(barred, -1).otherwise(points((own_path != "") & link_path.startswith(own_path), 34) + total(link, SECTION_RELATED))


def discovered_score(href: Column, text: Column) -> Column:
    return total(both(href, text), DISCOVERED) + total(href, DISCOVERED_LINK)


def city_anchor_score(text: Column, href: Column, city: Column, slug: Column) -> Column:
    """Of folded text and link, for a folded city name and its slug."""
    in_href = F.contains(href, F.concat(F.lit("/"), slug)) | F.contains(href, F.concat(F.lit("="), slug))
    score = points(text == city, 180) + points(F.contains(text, city), 80) + points(in_href, 140)
    return score + points(like(href, "cidade|loja|ofertas|encarte|regional|unidade"), 35) + points(like(text, "cidade|loja|unidade|retirar"), 25) + points(F.length(text).between(1, 60), 10)


def city_trigger_score(text: Column, is_select: Column, visible: Column) -> Column:
    return F.when(visible, total(F.lower(text), TRIGGER) + points(is_select, 50) + points(F.length(text).between(1, 120), 15)).otherwise(0)


def city_option_score(text: Column, city: Column, visible: Column) -> Column:
    score = points(text == city, 200) + points(like(text, "cidade|loja|unidade|filial|retirar"), 50) + points(F.length(text).between(1, 120), 20)
    return F.when(visible & F.contains(text, city), score).otherwise(0)


def capture_able(url: Column, content_type: Column, body: Column, limit: int = 1_200_000) -> Column:
    """Whether a captured response is worth parsing: cheap tests before the JSON."""
    json_like = like(content_type, r"json|graphql-response\+json") | like(url, "graphql|api|search|product|products|items|vitrine|catalog|ofertas|mercado|loja")
    return ~like(url, IGNORED_CAPTURES) & json_like & (F.length(body) <= limit)
