"""Brute force for gondola.operators.nodes: links, headings and extraction configs by walking the tree of one page."""

from __future__ import annotations

from gondola.functions.cards import Node, select, squeezed, tree


def page_links(root: Node) -> list[dict]:
    """Links with text, in order; whether an image is inside, and whether a header, menu or footer is around."""
    out = []
    for x in root.walk():
        if x.tag == "a" and x.attrs.get("href"):
            around = {u.tag for u in x.up()}
            out.append({"href": x.attrs["href"], "text": squeezed(x.text()) or "", "has_image": any(y.tag == "img" for y in x.walk()), "in_frame": bool(around & {"header", "nav", "footer"})})
    return out


def headings(root: Node) -> list[dict]:
    """Headings outside of header, menu and footer with labels of 3 to 80 characters, in order. For each place around it where its link may be, the first and last of page_links() inside."""
    ranges: dict[int, list[int]] = {}
    for k, x in enumerate(x for x in root.walk() if x.tag == "a" and x.attrs.get("href")):
        for u in x.up():
            ranges.setdefault(id(u), [k, k])[1] = k
    out = []
    for x in root.walk():
        kind, label = x.attrs.get("class") or "", None
        if x.tag in ("h1", "h2", "h3", "h4") or "title" in kind or "heading" in kind:
            label = squeezed(x.text())
        if label and 3 <= len(label) <= 80:
            around = [x, *x.up()]
            if not {u.tag for u in around} & {"header", "nav", "footer"}:
                near = [next((u for u in around if u.tag in ("section", "article")), None)]
                near += [next((u for u in around if name in (u.attrs.get("class") or "")), None) for name in ("section", "shelf", "carousel", "slider")]
                places = {id(u): u for u in [*near, *around[1:3]] if u is not None}
                out.append({"label": label, "places": [tuple(ranges[i]) for i in places if i in ranges]})
    return out


def read_field(root: Node, config: dict, url: str | None):
    """A field of an extraction config: text, html (as text), href, src, attribute, exists, pageTitle or pageUrl; several on request."""
    kind = config.get("type", "text")
    if kind == "pageUrl":
        return url
    if kind == "pageTitle":
        return next((squeezed(x.text()) for x in root.walk() if x.tag == "title"), None)
    found = select(root, config["selector"]) if config.get("selector") else [root]
    if kind == "exists":
        return bool(found)
    readers = {"text": lambda x: squeezed(x.text()), "html": lambda x: x.text(), "href": lambda x: x.attrs.get("href"), "src": lambda x: x.attrs.get("src"), "attribute": lambda x: x.attrs.get(config.get("attribute", ""))}
    if kind not in readers:
        raise ValueError(f"field type {kind} is not known")
    values = [readers[kind](x) for x in found]
    return values if config.get("multiple") else next(iter(values), None)


def extract(html: str | None, config: dict, url: str | None = None) -> dict:
    """pageText, fields and collection of an extraction config."""
    root, out = tree(html), {}
    if config.get("pageText"):
        out["pageText"] = squeezed(root.text())
    if config.get("pageHtml"):
        out["pageHtml"] = html
    for name, f in (config.get("fields") or {}).items():
        out[name] = read_field(root, f, url)
    if c := config.get("collection"):
        nodes = select(root, c["selector"])[: c.get("limit")]
        out["collection"] = [{name: read_field(node, f, url) for name, f in c["fields"].items()} for node in nodes]
    return out
