"""HTML as a table of nodes with interval labels: each page is parsed once, all questions after that are Spark columns.

A page's nodes stand in document order, so the nodes inside node x are the ones from x.at + 1 to x.last, its texts are
`n_texts` texts from `first_text` on, and the links inside it `n_links` from `first_link` on; `above` names its ancestors, the
nearest first. What lies inside a node is therefore a slice, and what lies around it a few look-ups. The nodes stay in
their page's row, so nothing is shuffled.

Defined results: null or empty html is a lone root; broken markup is closed as browsers do for lists, tables and
paragraphs; texts of scripts, styles and templates are left out; what static HTML hides is left out of the texts of the hidden
node and of all around it, not of nodes inside it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.functions import cards
from gondola.functions.payloads import let
from gondola.functions.text import clean
from gondola.functions.urls import joined

NODE = "at:int,last:int,above:array<int>,tag:string,attrs:map<string,string>,first_text:int,n_texts:int,first_link:int,n_links:int"
SCHEMA = f"nodes array<struct<{NODE}>>, texts array<struct<line:string,hidden:int>>"
_NODES = pa.list_(pa.struct([
    ("at", pa.int32()), ("last", pa.int32()), ("above", pa.list_(pa.int32())), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
    ("first_text", pa.int32()), ("n_texts", pa.int32()), ("first_link", pa.int32()), ("n_links", pa.int32()),
]))
_TEXTS = pa.list_(pa.struct([("line", pa.string()), ("hidden", pa.int32())]))
#: Pages that a Python worker holds parsed, and about how many bytes of HTML.
PAGES, PAGE_BYTES = 50, 1 << 20
REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?")
FRAMES = ("header", "nav", "footer")
HEADINGS = ("h1", "h2", "h3", "h4")
# The classes of places around a heading where its link may be, in order.
PLACES = ("section", "shelf", "carousel", "slider")


def ended_only(html: str | None) -> str | None:
    """HTML whose ampersands stand for themselves where they begin no reference that ends in a semicolon."""
    able = lambda name: name and (name[0] == "#" or name in html5)
    return REFERENCE.sub(lambda m: m[0] if able(m[1]) else "&amp;" + m[0][1:], html) if html else html


def labelled(html: str | None, bare: bool = True) -> tuple[list[dict], list[dict]]:
    """The nodes and texts of a page; a text's `hidden` is the innermost hidden node around it, or -1. bare: references without a semicolon count too, as in browsers."""
    nodes: list[dict] = []
    texts: list[dict] = []
    links = 0
    stack: list[tuple] = [(cards.tree(html if bare else ended_only(html)), [], -1)]
    while stack:
        x, above, hidden = stack.pop()
        if isinstance(x, dict):  # all below has been met
            x["last"], x["n_texts"], x["n_links"] = len(nodes) - 1, len(texts) - x["first_text"], links - x["first_link"]
        elif isinstance(x, str):
            if line := cards.squeezed(x):
                texts.append({"line": line, "hidden": hidden})
        else:
            at = len(nodes)
            links += x.tag == "a" and bool(x.attrs.get("href"))
            node = {"at": at, "last": at, "above": above, "tag": x.tag, "attrs": dict(x.attrs), "first_text": len(texts), "n_texts": 0, "first_link": links, "n_links": 0}
            nodes.append(node)
            stack.append((node, None, None))
            inner = at if cards.hidden(x) else hidden
            stack.extend((c, [at, *above], inner) for c in reversed(x.children))
    return nodes, texts


def unpacked(batches: Iterator[pa.RecordBatch], kept: list[str], bare: bool = True) -> Iterator[pa.RecordBatch]:
    """The kept columns, nodes and texts of batches with html, of at most PAGES pages and about PAGE_BYTES at once; a page's nodes become Arrow before the next page is parsed."""

    def row(html: str | None) -> tuple[pa.Array, pa.Array]:
        nodes, texts = labelled(html, bare)
        for x in nodes:
            x["attrs"] = list(x["attrs"].items())
        return pa.array([nodes], _NODES), pa.array([texts], _TEXTS)

    for batch in batches:
        lo, size, found = 0, 0, []
        for i, html in enumerate(batch.column("html")):
            html = html.as_py()
            found.append(row(html))
            size += len(html or "")
            if len(found) == PAGES or size >= PAGE_BYTES or i + 1 == batch.num_rows:
                own = [batch.column(c).slice(lo, len(found)) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, *(pa.concat_arrays(x) for x in zip(*found))], names=[*kept, "nodes", "texts"])
                lo, size, found = i + 1, 0, []


def parsed(pages: DataFrame, *columns: str, bare: bool = True) -> DataFrame:
    """(page_id, url, ...columns, nodes, texts) of each page (page_id, url, html); bare as in labelled."""
    kept = ["page_id", "url", *columns]
    rows = pages.select(*dict.fromkeys([*kept, "html"]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    return rows.mapInArrow(lambda batches: unpacked(batches, kept, bare), f"{kinds}, {SCHEMA}")


class Page:
    """The nodes and texts of a row."""

    def __init__(self, nodes: str = "nodes", texts: str = "texts"):
        self.nodes, self.texts = F.col(nodes), F.col(texts)

    def root(self) -> Column:
        return F.get(self.nodes, 0)

    def inside(self, x: Column) -> Column:
        return F.slice(self.nodes, x["at"] + 2, x["last"] - x["at"])

    def around(self, x: Column) -> Column:
        """The ancestors, the nearest first."""
        return F.transform(x["above"], lambda i: F.get(self.nodes, i))

    def lines(self, x: Column) -> Column:
        seen = F.filter(F.slice(self.texts, x["first_text"] + 1, x["n_texts"]), lambda t: t["hidden"] < x["at"])
        return F.transform(seen, lambda t: t["line"])

    def text(self, x: Column) -> Column:
        return F.array_join(self.lines(x), " ")

    def select(self, scope: Column, selector: str) -> Column:
        """The nodes inside scope that a selector of simple ones finds, each anywhere below the one before."""
        first, *rest = selector.split()
        found = F.filter(self.inside(scope), fits(first))
        for part in rest:
            found = self._below(scope, found, fits(part))
        return found

    def _below(self, scope: Column, upper: Column, able: Callable[[Column], Column]) -> Column:
        return let(F.transform(upper, lambda x: x["at"]), lambda held: F.filter(self.inside(scope), lambda x: able(x) & F.arrays_overlap(x["above"], held)))


def fits(simple: str) -> Callable[[Column], Column]:
    """One simple selector: a tag, classes, an id and attributes."""
    m = re.match(r"^([a-zA-Z0-9*]*)((?:[.#][\w-]+|\[[^\]]+\])*)$", simple)
    if not m:
        return lambda x: F.lit(False)

    def able(x: Column) -> Column:
        out = F.lit(True) if m[1] in ("", "*") else x["tag"] == m[1].lower()
        for part in re.findall(r"[.#][\w-]+|\[[^\]]+\]", m[2]):
            if part[0] == ".":
                out = out & F.array_contains(F.split(F.coalesce(x["attrs"]["class"], F.lit("")), r"\s+"), part[1:])
            elif part[0] == "#":
                out = out & x["attrs"]["id"].eqNullSafe(F.lit(part[1:]))
            else:
                key, _, value = part[1:-1].partition("=")
                value = value.strip("\"'")
                out = out & (x["attrs"][key].eqNullSafe(F.lit(value)) if value else F.map_contains_key(x["attrs"], key))
        return out

    return able


def is_link(x: Column) -> Column:
    return (x["tag"] == "a") & (F.coalesce(x["attrs"]["href"], F.lit("")) != "")


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url, seq, href, text, has_image, in_frame) of each link, absolute."""
    page = Page()

    def link(x: Column, i: Column) -> Column:
        framed, image = F.exists(page.around(x), lambda u: u["tag"].isin(*FRAMES)), F.exists(page.inside(x), lambda u: u["tag"] == "img")
        return F.struct(i.alias("seq"), x["attrs"]["href"].alias("href"), page.text(x).alias("text"), image.alias("has_image"), framed.alias("in_frame"))

    rows = parsed(pages).select("page_id", "url", F.explode(F.transform(F.filter(page.nodes, is_link), link)).alias("x"))
    return rows.select("page_id", "url", "x.seq", joined(F.col("x.href"), F.col("url")).alias("href"), "x.text", "x.has_image", "x.in_frame").where("href is not null")


def headings(pages: DataFrame, bare: bool = True) -> DataFrame:
    """(page_id, url, heading, label, places) of each heading outside of header, menu and footer with a label of 3 to 80 characters; places: the first and last seq of links() in each place around it, in the order they are tried."""
    page = Page()
    classes = lambda x: F.coalesce(x["attrs"]["class"], F.lit(""))
    of_class = lambda name: lambda u: classes(u).contains(name)
    able = F.filter(page.nodes, lambda x: x["tag"].isin(*HEADINGS) | classes(x).contains("title") | classes(x).contains("heading"))

    def places(around: Column) -> Column:
        near = [F.get(F.filter(around, lambda u: u["tag"].isin("section", "article")), 0)]
        near += [F.get(F.filter(around, of_class(name)), 0) for name in PLACES]
        tried = F.array_compact(F.array(*(x["at"] for x in [*near, F.get(around, 1), F.get(around, 2)])))
        held = F.filter(F.transform(F.array_distinct(tried), lambda i: F.get(page.nodes, i)), lambda u: u["n_links"] > 0)
        return F.transform(held, lambda u: F.struct(u["first_link"].alias("first"), (u["first_link"] + u["n_links"] - 1).alias("last")))

    def heading(x: Column) -> Column:
        def judged(around: Column) -> Column:
            framed = F.exists(around, lambda u: u["tag"].isin(*FRAMES))
            return F.struct(page.text(x).alias("label"), framed.alias("framed"), F.when(~framed, places(around)).alias("places"))

        return let(F.concat(F.array(x), page.around(x)), judged)

    found = F.filter(F.transform(able, heading), lambda h: F.length(h["label"]).between(3, 80) & ~h["framed"])
    return parsed(pages, bare=bare).select("page_id", "url", F.posexplode(found).alias("heading", "h")).select("page_id", "url", "heading", "h.label", "h.places")


def field(page: Page, scope: Column, config: dict) -> Column:
    """A field of an extraction config: text, html (as text), href, src, attribute, exists, pageTitle or pageUrl; several on request."""
    kind = config.get("type", "text")
    if kind == "pageUrl":
        return F.col("url")
    if kind == "pageTitle":
        return F.get(F.transform(F.filter(page.inside(scope), lambda x: x["tag"] == "title"), lambda x: clean(page.text(x))), 0)
    found = page.select(scope, config["selector"]) if config.get("selector") else F.array(scope)
    if kind == "exists":
        return F.size(found) > 0
    readers = {"text": lambda x: clean(page.text(x)), "html": page.text, "href": lambda x: x["attrs"]["href"], "src": lambda x: x["attrs"]["src"], "attribute": lambda x: x["attrs"][config.get("attribute", "")]}
    if kind not in readers:
        raise ValueError(f"field type {kind} is not known")
    values = F.transform(found, readers[kind])
    return values if config.get("multiple") else F.get(values, 0)


def fields(page: Page, scope: Column, wanted: dict) -> list[Column]:
    return [field(page, scope, f).alias(name) for name, f in wanted.items()]


def extracted(pages: DataFrame, config: dict, bare: bool = True) -> DataFrame:
    """(page_id, url, data): what an extraction config reads from each page (pageText, pageHtml, fields, collection), as JSON."""
    page = Page()
    out = [clean(page.text(page.root())).alias("pageText")] if config.get("pageText") else []
    out += [F.col("html").alias("pageHtml")] if config.get("pageHtml") else []
    out += fields(page, page.root(), config.get("fields") or {})
    if c := config.get("collection"):
        found = page.select(page.root(), c["selector"])
        found = F.slice(found, 1, c["limit"]) if c.get("limit") else found
        out.append(F.transform(found, lambda x: F.struct(*fields(page, x, c["fields"]))).alias("collection"))
    data = F.to_json(F.struct(*out), {"ignoreNullFields": "false"}) if out else F.lit("{}")
    return parsed(pages, *(["html"] if config.get("pageHtml") else []), bare=bare).select("page_id", "url", data.alias("data"))
