"""Product cards, links and fields out of HTML. Spark's xpath functions reject real pages, so a small tree is built in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

from gondola.functions.text import PRICE, SPACE

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SKIPPED = {"script", "style", "noscript", "template"}
#: Tags that a new tag of the same kind ends.
ENDED = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
#: Tags that such an end does not reach beyond.
HOLDERS = {"ul", "ol", "table", "tbody", "thead", "body", "div", "section", "article", "select"}
_PRICE, _SPACES = re.compile(PRICE), re.compile(SPACE + "+")
_NUMBER = re.compile(r"-?(?:\d+(?:\.\d*)?|\.\d+)")
# Fixed values of card reading.
PRICE_NODES, ANCESTORS, LEAST_CARDS, MOST_CARDS, MOST_PRICES = 500, 5, 2, 200, 3
HEADS = re.compile(r"name|title|nome|titulo", re.I)
ACTIONS = re.compile(r"^(?:adicionar|comprar|ver mais|ver detalhes|adicionar ao carrinho|compre agora|detalhes)$", re.I)
PROMOTED = re.compile(r"oferta|promoc|clube|\boff\b|-\s*\d+\s*%", re.I)
BADGE_CLASS = re.compile(r"badge|tag|flag|selo|chip|label|stamp|promo|offer|club|discount|pill|ribbon", re.I)
BADGE_TEXT = re.compile(r"oferta|promo|clube|super barato|festival|real|sexta|carne|exclusiv|site|cpf|cliente|limite|máx|max|360|peso|unidade|leve|pague|desconto|especial", re.I)
BADGE_PERCENT = re.compile(r"^-\d+%$", re.ASCII)
BADGE_TAGS, BADGE_NODES, MOST_BADGES = {"span", "small", "strong", "div", "p", "button", "a"}, 80, 8


def price_of(text: str) -> float | None:
    """As prices.parse_price, for one text."""
    s = _SPACES.sub("", text)
    if "," in s and "." in s and s.rfind(",") < s.rfind("."):
        s = s.replace(",", "")
    elif "," in s:
        s = s.replace(".", "").replace(",", ".", 1)
    found = _NUMBER.match(re.sub(r"[^0-9.-]+", "", s))
    return float(found[0]) if found else None


def squeezed(text: str | None) -> str | None:
    return _SPACES.sub(" ", text).strip() or None if text is not None else None


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def lines(self) -> list[str]:
        """The texts below, as lines, in order."""
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                if line := squeezed(x):
                    out.append(line)
            elif not hidden(x):
                stack.extend(reversed(x.children))
        return out

    def text(self) -> str:
        return " ".join(self.lines())

    def up(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


def hidden(node: Node) -> bool:
    """What static HTML shows of visibility: the hidden attribute and inline styles."""
    style = node.attrs.get("style", "").replace(" ", "").lower()
    return "hidden" in node.attrs or "display:none" in style or "visibility:hidden" in style


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("#root", {})
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        for node in (self.now, *self.now.up()):
            if node.tag in ENDED.get(tag, ()):
                self.now = node.parent
                break
            if node.tag in HOLDERS or (tag == "p" and node.tag == "li"):
                break
        node = Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in SKIPPED and self.skip:
            self.skip -= 1
        for node in (self.now, *self.now.up()):
            if node.tag == tag:
                self.now = node.parent or self.root
                return

    def handle_data(self, data):
        if not self.skip:
            self.now.children.append(data)


def tree(html: str | None) -> Node:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.root


def selector(node: Node) -> str:
    """The tag and its first two classes."""
    return ".".join([node.tag, *node.attrs.get("class", "").split()[:2]])


def first_image(node: Node) -> str | None:
    for x in node.walk():
        if x.tag == "img":
            return next((v for k in ("src", "data-src", "data-lazy") if (v := x.attrs.get(k))), None)
    return None


def first_link(node: Node) -> str | None:
    own = [x for x in (node, *node.walk()) if x.tag == "a" and x.attrs.get("href")]
    outer = [x for x in node.up() if x.tag == "a" and x.attrs.get("href")]
    return next((x.attrs["href"] for x in [*own, *outer]), None)


def card_name(node: Node) -> str | None:
    able = lambda t: t is not None and 3 <= len(t) <= 180 and not _PRICE.search(t) and not ACTIONS.match(t)
    for x in node.walk():
        heading = x.tag in ("h1", "h2", "h3", "h4", "strong") or HEADS.search(x.attrs.get("class", "")) or "titulo" in x.attrs.get("id", "")
        if heading and able(t := squeezed(x.text())):
            return t
    for x in node.walk():
        if x.tag == "img" and able(t := squeezed(x.attrs.get("alt"))):
            return t
    return max((t for t in node.lines() if able(t)), key=len, default=None)


def card_badges(node: Node, name: str | None = None) -> list[str]:
    """At most 8 short texts without prices: of the first elements below that look like badges by class, id or words, then of the card's lines by their words alone; each once whatever its case, the name not among them."""
    told = lambda t: bool(BADGE_TEXT.search(t) or BADGE_PERCENT.match(t))
    inner = [x for x in node.walk() if x is not node and x.tag in BADGE_TAGS][:BADGE_NODES]
    marked = [(squeezed(x.text()), bool(BADGE_CLASS.search(f"{x.attrs.get('class', '')} {x.attrs.get('id', '')}"))) for x in inner]
    found = [t for t, by_class in marked if t and len(t) <= 80 and t.lower() != (name or "").lower() and (by_class or told(t))]
    found += [t for t in node.lines() if 2 <= len(t) <= 80 and told(t)]
    return list({t.lower(): t for t in reversed(found) if not _PRICE.search(t)}.values())[::-1][:MOST_BADGES] if found else []


def card(node: Node) -> dict | None:
    """The item of a card: lowest price as current, highest as original; None without a name or price or with more than three prices."""
    text = node.text()
    prices = [p for t in _PRICE.findall(text) if (p := price_of(t)) is not None]
    name = card_name(node)
    if not name or not 1 <= len(prices) <= MOST_PRICES:
        return None
    link, current, original = first_link(node), min(prices), max(prices)
    ids = [x.attrs[k] for x in node.walk() for k in ("data-idproduct", "data-product-id", "data-id") if x.attrs.get(k)]
    in_link = re.search(r"/(\d+)(?:/|$|\?)", link or "")
    return {
        "id": ids[0] if ids else in_link[1] if in_link else None,
        "name": name,
        "current": current,
        "original": original if original > current else None,
        "promotion": original > current or bool(PROMOTED.search(text)),
        "badges": card_badges(node, name),
        "image": first_image(node),
        "link": link,
    }


def hinted(node: Node) -> dict:
    """What a card of a known selector shows: its own id, the first image's alt, lines, text, and the texts of the first elements that may be badges, with their classes and ids."""
    image = next((x for x in node.walk() if x.tag == "img"), None)
    inner = [x for x in node.walk() if x is not node and x.tag in BADGE_TAGS][:BADGE_NODES]
    return {
        "id": node.attrs.get("data-idproduct") or node.attrs.get("data-product-id") or None,
        "alt": squeezed(image.attrs.get("alt")) if image else None,
        "lines": node.lines(),
        "text": node.text(),
        "marked": [{"text": squeezed(x.text()), "marks": f"{x.attrs.get('class', '')} {x.attrs.get('id', '')}"} for x in inner],
        "image": first_image(node),
        "link": next((x.attrs["href"] for x in node.walk() if x.tag == "a" and x.attrs.get("href")), None),
    }


def groups(root: Node) -> dict[str, list[Node]]:
    """Cards by selector: the ancestors of price texts, up to five above each."""
    out: dict[str, dict[int, Node]] = {}
    found = 0
    for node in root.walk():
        if hidden(node) or not any(isinstance(c, str) and _PRICE.search(c) for c in node.children):
            continue
        found += 1
        if found > PRICE_NODES:
            break
        for k, up in enumerate((node, *node.up())):
            if k > ANCESTORS or up.parent is None:
                break
            out.setdefault(selector(up), {})[id(up)] = up
    return {s: list(nodes.values()) for s, nodes in out.items() if LEAST_CARDS <= len(nodes) <= MOST_CARDS}


def page_groups(html: str | None) -> list[tuple[str, list[dict]]]:
    """The cards of each group, by its selector, in the order the groups are met."""
    return [(name, [c for node in nodes if (c := card(node))]) for name, nodes in groups(tree(html)).items()]


def matches(node: Node, wanted: str) -> bool:
    """One simple selector: a tag, classes, an id and attributes."""
    m = re.match(r"^([a-zA-Z0-9*]*)((?:[.#][\w-]+|\[[^\]]+\])*)$", wanted.strip())
    if not m or (m[1] not in ("", "*") and node.tag != m[1].lower()):
        return False
    for part in re.findall(r"[.#][\w-]+|\[[^\]]+\]", m[2]):
        if part[0] == ".":
            if part[1:] not in node.attrs.get("class", "").split():
                return False
        elif part[0] == "#":
            if node.attrs.get("id") != part[1:]:
                return False
        else:
            key, _, value = part[1:-1].partition("=")
            if key not in node.attrs or (value and node.attrs[key] != value.strip("\"'")):
                return False
    return True


def select(root: Node, wanted: str) -> list[Node]:
    """Nodes of a selector of simple ones, each anywhere below the one before."""
    found = [root]
    for part in wanted.split():
        seen: dict[int, Node] = {id(x): x for node in found for x in node.walk() if x is not node and matches(x, part)}
        found = list(seen.values())
    return found
