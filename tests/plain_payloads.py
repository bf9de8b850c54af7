"""Brute force for gondola.functions.payloads: the same rules over parsed JSON, one object at a time."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

from gondola.functions import cards
from gondola.functions.payloads import (
    ARRAY_WORDS, BADGES, DISCOUNT_PATHS, DISCOUNTS, FLAT_DEPTH, FLAT_ITEMS, FLAT_KEYS, IDS, IMAGES, LABEL_PATHS, LIMITS, LINKS, NAMES, ORIGINALS,
    PRICES, PROMOTION_PRICE_PATHS, PROMOTIONS, REGULAR_PRICE_PATHS, UNITS, URL_WORDS, WALK_DEPTH, WALK_ITEMS, WALK_KEYS,
)
from gondola.functions.text import PRICE, SPACE
from gondola.functions.urls import join_url


def ends_with(keys: tuple[str, ...]) -> re.Pattern:
    return re.compile(r"(?:^|\.)(?:" + "|".join(map(re.escape, keys)) + r")$", re.I)


_PRICE, _SPACES = re.compile(PRICE), re.compile(SPACE + "+")


def price_of(value) -> float | None:
    """As prices.parse_price, for one JSON value."""
    if isinstance(value, bool) or value is None or isinstance(value, (dict, list)):
        return None
    if isinstance(value, (int, float)):
        return float(value) if math.isfinite(value) else None
    return cards.price_of(value)


def flatten(value, limit: int = FLAT_DEPTH) -> list[tuple[str, object]]:
    """(path, scalar) in document order; array places are no part of a path."""
    out: list[tuple[str, object]] = []

    def visit(node, path: str, depth: int) -> None:
        if depth > limit or node is None:
            return
        if isinstance(node, dict):
            for key in list(node)[:FLAT_KEYS]:
                visit(node[key], f"{path}.{key}" if path else key, depth + 1)
        elif isinstance(node, list):
            for item in node[:FLAT_ITEMS]:
                if isinstance(item, (dict, list)):
                    visit(item, path, depth + 1)
                elif item is not None and path:
                    out.append((path, item))
        elif path:
            out.append((path, node))

    visit(value, "", 0)
    return out


def pick(flat: list[tuple[str, object]], keys: tuple[str, ...], able: Callable[[object], bool], any_other: bool = False):
    """The value of the shortest path that ends in one of the keys, the first among equals; or else the first able value at all."""
    pattern = ends_with(keys)
    found = [(len(p), k, v) for k, (p, v) in enumerate(flat) if pattern.search(p) and able(v)]
    if found:
        return min(found, key=lambda x: x[:2])[2]
    return next((v for _, v in flat if able(v)), None) if any_other else None


def at(item, path: str):
    for key in path.split("."):
        item = item.get(key) if isinstance(item, dict) else None
    return item


def _text(least: int, most: int | None = None) -> Callable[[object], bool]:
    return lambda v: isinstance(v, str) and len(v) >= least and (most is None or len(v) <= most)


def _scalar(v) -> bool:
    return isinstance(v, str) or (isinstance(v, (int, float)) and not isinstance(v, bool))


def shown(v) -> str:
    return v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False, sort_keys=True)


def squeezed(v) -> str | None:
    return _SPACES.sub(" ", shown(v)).strip() or None if v is not None and v is not False else None


def holds(v) -> bool:
    """Whether a value counts as true, as browsers have it."""
    return isinstance(v, (dict, list)) or bool(v)


def price_state(item: dict, flat: list[tuple[str, object]], fallback=None) -> dict:
    """Current and original price, promotion flag, label and discount of a product object."""
    first = lambda values: next((p for v in values if (p := price_of(v)) is not None), None)
    promoted, regular = (first(at(item, p) for p in paths) for paths in (PROMOTION_PRICE_PATHS, REGULAR_PRICE_PATHS))
    flat_current, flat_original = (price_of(pick(flat, keys, _scalar)) for keys in (PRICES, ORIGINALS))
    current = promoted if promoted is not None else first((regular, flat_current, fallback))
    candidate = first((regular, flat_original)) if promoted is not None else flat_original
    original = candidate if None not in (candidate, current) and candidate > current else None
    flag = any(holds(at(item, p)) for p in ("pricing.promotion", "em_oferta", "oferta"))
    return {
        "current": current,
        "original": original,
        "promotion": bool(flag) or original is not None,
        "label": next((v for p in LABEL_PATHS if holds(v := at(item, p))), None),
        "discount": next((v for p in DISCOUNT_PATHS if (v := at(item, p)) is not None), None),
    }


def raw_product(item: dict, source_url: str | None) -> dict | None:
    """The fields of a product object as they are found; None if it is none: no name or price, or neither image, link nor id."""
    flat = flatten(item)
    name = pick(flat, NAMES, lambda v: _text(3)(v) and not _PRICE.search(v), any_other=True)
    price = pick(flat, PRICES, _scalar)
    state = price_state(item, flat, price)
    image = pick(flat, IMAGES, lambda v: isinstance(v, str) and bool(re.match(r"/|https?://|base/|imgs/", v, re.I)))
    link = pick(flat, LINKS, lambda v: isinstance(v, str) and bool(re.match(r"https?://|/|[a-z0-9-]+$", v, re.I)))
    found_id = pick(flat, IDS, _scalar)
    clean_name = squeezed(_PRICE.sub("", squeezed(name) or "")) if name is not None else None
    if link and not re.match(r"https?://|/", link, re.I):
        link = "/produto/" + link
    image, link = join_url(image, source_url), join_url(link, source_url)
    if not clean_name or (state["current"] is None and squeezed(price) is None) or re.match(r"store\d+:", clean_name, re.I):
        return None
    if not image and not link and not found_id:
        return None
    badge = ends_with(BADGES)
    badges = [v for p, v in flat if badge.search(p) and _text(2, 80)(v)][:12]
    more = (state["label"], "Clube" if holds(item.get("clube")) else None, "Exclusivo do site" if holds(item.get("exclusive")) or holds(item.get("siteExclusive")) else None)
    discount = state["discount"] if state["discount"] is not None else pick(flat, DISCOUNTS, _scalar)
    return {
        "id": shown(found_id) if found_id else None,
        "name": clean_name,
        "current": state["current"],
        "original": state["original"],
        "promotion": state["promotion"],
        "label": squeezed(state["label"] if state["label"] is not None else pick(flat, PROMOTIONS, _text(2, 80))),
        "discount": None if discount is None else shown(discount),
        "badges": badges + [squeezed(x) for x in more if x],
        "limit_text": squeezed(pick(flat, LIMITS, _text(3, 80))),
        "club": holds(item.get("clube")),
        "exclusive": holds(item.get("exclusive")) or holds(item.get("siteExclusive")),
        "unit": squeezed(pick(flat, UNITS, _text(0, 20))),
        "image": image,
        "link": link,
    }


def product_arrays(payload, source_url: str | None) -> list[dict]:
    """The arrays of a payload that hold products: path, score, and the products."""
    out: list[dict] = []

    def visit(node, path: str, depth: int) -> None:
        if depth > WALK_DEPTH or node is None:
            return
        if isinstance(node, list):
            products = [p for x in node if isinstance(x, dict) and (p := raw_product(x, source_url))]
            if products:
                score = 10 * len(products) + 20 * bool(re.search(ARRAY_WORDS, path, re.I)) + 15 * bool(re.search(URL_WORDS, source_url or "", re.I))
                out.append({"path": path, "score": score, "items": products})
            for item in node[:WALK_ITEMS]:
                if isinstance(item, (dict, list)):
                    visit(item, f"{path}[]", depth + 1)
        elif isinstance(node, dict):
            for key in list(node)[:WALK_KEYS]:
                visit(node[key], f"{path}.{key}", depth + 1)

    visit(payload, "$", 0)
    return out


def parsed(text):
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def _kind(v) -> str:
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string"
