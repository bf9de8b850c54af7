"""URL functions."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gondola.functions.text import arrow_function, empty_to_null, squeeze

# The paths under which shops keep their catalogues, and those tried for a search.
ROOT_PATHS = ("produtos", "categorias", "categoria", "departamentos", "departamento", "shop", "catalog", "catalogo", "listar.php", "loja")
COMMON_PATHS = ("listar.php", "produtos", "ofertas", "ofertas-por-cidade")
SEARCH_PATHS = ("catalogsearch/result/?q=", "busca/", "busca?busca=", "search?q=", "pesquisa?busca=")


def ensure_scheme(url: Column) -> Column:
    """Trimmed, with https:// before it if it has no http scheme; null if empty."""
    u = empty_to_null(squeeze(url))
    return F.when(u.rlike("(?i)^https?://"), u).otherwise(F.concat(F.lit("https://"), u))


def origin(url: Column) -> Column:
    return empty_to_null(F.lower(F.regexp_extract(url, r"(?i)^([a-z][a-z0-9+.-]*://[^/?#]*)", 1)))


def host(url: Column) -> Column:
    """Lower-case host without www. at its start; null if the URL has none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def join_url(value: str | None, base: str | None) -> str | None:
    """An absolute URL of a link on a page, or None."""
    if not value:
        return None
    try:
        found = urljoin(base or "", value.strip())
        return found if urlsplit(found).netloc else None
    except ValueError:
        return None


@arrow_function("string")
def absolute(value: pd.Series, base: pd.Series) -> pd.Series:
    """Links made absolute; Spark has no function for it."""
    return pd.Series([join_url(v, b) for v, b in zip(value, base)], dtype=object)


def without_dots(path: Column) -> Column:
    """A rooted path whose . and .. parts are worked off."""
    parts = F.split(path, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda out, p: F.when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1)))).when(p == ".", out).otherwise(F.concat(out, F.array(p))))
    tail = F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise("")
    return F.when(path.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), F.concat(F.array_join(kept, "/"), tail)).otherwise(path)


def joined(value: Column, base: Column) -> Column:
    """A link made absolute against the page it stands on, as join_url() does, in SQL functions: null if that has no host."""
    v = F.trim(value, F.lit(" \t\n\r\f\u000b"))
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    scheme, plain = F.regexp_extract(site, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.regexp_extract(base, r"^[^?#]*", 0)
    folder = F.regexp_extract(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(.*)$", 1), r"^(.*/)", 1)
    path, rest = F.regexp_extract(v, r"^[^?#]*", 0), F.regexp_extract(v, r"^[^?#]*([\s\S]*)$", 1)
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    on_site = F.when(v.startswith("//"), F.concat(scheme, v)).when(v.startswith("?"), F.concat(plain, v)).when(v.startswith("#"), F.concat(F.regexp_extract(base, r"^[^#]*", 0), v)).otherwise(F.concat(site, without_dots(rooted), rest))
    return F.when(v.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(v.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]"), v)).when((v != "") & (site != ""), on_site)


def product_link(value: Column, base: Column) -> Column:
    """Absolute and rooted links as they are, bare slugs under /produto/, else null."""
    rooted = value.rlike("(?i)^https?://") | value.startswith("/")
    return joined(F.when(rooted, value).when(value.rlike("(?i)^[a-z0-9-]+$"), F.concat(F.lit("/produto/"), value)), base)


def root_candidates(url: Column) -> Column:
    return F.transform(F.array(*map(F.lit, ROOT_PATHS)), lambda p: F.concat(origin(url), F.lit("/"), p))


def encode_component(x: Column) -> Column:
    return F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))


def search_candidates(url: Column, query: Column) -> Column:
    """The common pages of a shop and its searches for a query."""
    found = [F.concat(origin(url), F.lit("/" + p)) for p in COMMON_PATHS]
    return F.array(*found, *(F.concat(origin(url), F.lit("/" + p), encode_component(query)) for p in SEARCH_PATHS))


def numbered_pages(url: Column, most: Column, limit: int) -> Column:
    """The URL with page=2 and so on up to the lesser of most and limit."""
    last = F.least(F.coalesce(most, F.lit(1)), F.lit(limit))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"([?&])page=[^&]*(&|$)", "$1"), "[?&]$", "")
    mark = F.when(F.contains(bare, F.lit("?")), "&page=").otherwise("?page=")
    return F.when(last > 1, F.transform(F.sequence(F.lit(2), last), lambda k: F.concat(bare, mark, k.cast("string")))).otherwise(F.array().cast("array<string>"))


def adapter(url: Column, hint: Column, by_host: dict[str, str], other: str = "generic") -> Column:
    """The hinted adapter unless it is auto or missing, else that of the host."""
    routed = F.lit(other)
    for name, found in sorted(by_host.items()):
        routed = F.when(host(url) == name, found).otherwise(routed)
    return F.when(F.coalesce(hint, F.lit("auto")) != "auto", hint).otherwise(routed)


def root_like(url: Column) -> Column:
    return F.regexp_replace(path(url), "/+$", "") == ""
