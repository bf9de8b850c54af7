"""Products out of JSON of any shape: flattening, picking fields by key patterns, price state, product arrays.

Columns of Spark's own JSON functions, no Python. A walk goes level by level: each object or array is read once as a map or
list of raw texts, which keeps the keys in the order of the document, and once as VARIANT, which tells strings from
numbers, objects and nulls. The nodes of all levels stay in the row as an array, so nothing is shuffled and the same
columns serve batches and streams.

Defined results: null, malformed or scalar JSON has no nodes; a repeated key counts each time; null values are left out but
count towards the limits of keys and items; numbers are compared as doubles.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gondola.functions.prices import parse_price
from gondola.functions.text import PRICE, clean, squeeze
from gondola.functions.urls import joined

# The last parts of key paths that name each field, as the payloads of shops have them.
NAMES = ("name", "nome", "title", "titulo", "description", "descricao", "productName", "nomeProduto", "descricao_produto", "produto")
PRICES = ("price", "pricing.price", "pricing.promotionalPrice", "priceFormatted", "preco", "valor", "salePrice", "currentPrice", "promotionPrice", "precoPor", "valorVenda", "unitPrice")
ORIGINALS = ("pricing.price", "pricing.originalPrice", "pricing.priceFrom", "originalPrice", "listPrice", "compareAtPrice", "preco_original", "oldPrice", "regularPrice", "basePrice", "oferta.preco_antigo")
IMAGES = ("image", "imagem", "img", "thumb", "thumbnail", "photo", "foto", "src", "urlImagem", "imagemPrincipal")
LINKS = ("url", "link", "href", "permalink", "productUrl", "slug")
IDS = ("id", "sku", "ean", "gtin", "codigo", "productId", "product_id", "_id")
UNITS = ("unit", "unitLabel", "unitType", "unidade", "unidade_sigla", "uom", "sellUnit")
DISCOUNTS = ("discount", "percentage", "percentual", "desconto")
PROMOTIONS = ("promotion.name", "promotion.title", "promotion.tag", "promotion.label", "promotionName", "promotionTitle", "promotionLabel", "oferta.nome", "oferta.tag")
BADGES = ("badge", "badges", "tag", "tags", "flag", "flags", "selo", "selos", "label", "labels", "chip", "chips", "highlight", "highlights", "stamp", "stamps", "ribbon", "marketing", "benefit", "benefits")
LIMITS = ("cpf", "limit", "limitText", "maxPerCpf", "max_per_cpf", "maxQuantity", "max_quantity", "purchaseLimit", "limite", "limite_por_cpf")
PROMOTION_PRICE_PATHS = ("pricing.promotionalPrice", "oferta.preco_oferta", "promotionPrice", "salePrice", "currentPrice")
REGULAR_PRICE_PATHS = ("oferta.preco_antigo", "preco_original", "pricing.price", "originalPrice", "listPrice", "compareAtPrice", "price", "preco", "valor")
LABEL_PATHS = ("pricing.promotion.name", "pricing.promotion.title", "pricing.promotion.tag", "oferta.nome", "oferta.tag")
DISCOUNT_PATHS = ("discount", "pricing.discount", "oferta.percentual_desconto", "oferta.desconto")
ARRAY_WORDS = "product|produto|products|produtos|hits|items|vitrine|search"
URL_WORDS = "product|produto|products|produtos|search|vitrine"
# Limits of the walks.
FLAT_DEPTH, FLAT_KEYS, FLAT_ITEMS = 4, 40, 5
WALK_DEPTH, WALK_KEYS, WALK_ITEMS = 6, 80, 20


NODE = "array<struct<at:array<int>,path:string,kind:string,text:string>>"
RAW = "id string, name string, current double, original double, promotion boolean, label string, discount string, badges array<string>, limit_text string, club boolean, exclusive boolean, unit string, image string, link string"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def kind_of(value: Column) -> Column:
    """The first letters of a VARIANT's type: OBJ, ARR, STR, BOO, VOI (a JSON null), of numbers others."""
    return F.substring(F.schema_of_variant(value), 1, 3)


def is_container(node: Column) -> Column:
    return node["kind"].isin("OBJ", "ARR")


def children(node: Column, keys: int, items: int, mark: str, scalars_alone: bool = False) -> Column:
    """The nodes right under a node: of objects the first `keys`, of arrays the first `items`, whose containers get `mark` after the path."""
    none = F.array().cast(NODE)
    below = lambda key: F.when(node["path"] == "", key).otherwise(F.concat(node["path"], F.lit("."), key))

    def entry(e: Column, i: Column) -> Column:
        return F.struct(F.concat(node["at"], F.array(i)).alias("at"), below(e["raw"]["key"]).alias("path"), kind_of(e["typed"]["value"]).alias("kind"), e["raw"]["value"].alias("text"))

    def item(e: Column, i: Column) -> Column:
        kind = kind_of(e["typed"])
        return F.struct(F.concat(node["at"], F.array(i)).alias("at"), F.concat(node["path"], F.when(kind.isin("OBJ", "ARR"), mark).otherwise("")).alias("path"), kind.alias("kind"), e["raw"].alias("text"))

    entries = F.arrays_zip(F.map_entries(F.from_json(node["text"], "map<string,string>")).alias("raw"), F.map_entries(F.from_json(node["text"], "map<string,variant>")).alias("typed"))
    listed = F.arrays_zip(F.from_json(node["text"], "array<string>").alias("raw"), F.from_json(node["text"], "array<variant>").alias("typed"))
    of_object = none if scalars_alone else F.transform(F.slice(entries, 1, keys), entry)
    found = F.coalesce(F.when(node["kind"] == "OBJ", of_object).when(node["kind"] == "ARR", F.transform(F.slice(listed, 1, items), item)).otherwise(none), none)
    return F.filter(found, lambda n: (n["kind"] != "VOI") & (~is_container(n) if scalars_alone else F.lit(True)))


def walked(body: Column, root: str, depth: int, keys: int, items: int, mark: str) -> Column:
    """All nodes of a JSON text down to so many levels under the root, in the order of the document. Scalars in an array are on its level."""
    start = F.regexp_extract(body, r"^\s*([\[{])", 1)
    first = F.array(F.struct(F.array().cast("array<int>").alias("at"), F.lit(root).alias("path"), F.when(start == "{", "OBJ").otherwise("ARR").alias("kind"), body.alias("text")))

    def under(nodes: Column, left: int) -> Column:
        more = lambda ns: F.flatten(F.transform(ns, lambda n: children(n, keys, items, mark, scalars_alone=left == 0)))
        return let(nodes, lambda ns: F.concat(ns, more(ns) if left == 0 else under(more(ns), left - 1)))

    return F.when(start != "", F.array_sort(under(first, depth))).otherwise(F.array().cast(NODE))


def flat_json(body: Column | str) -> Column:
    """(path, value, vtype) of the scalars of a JSON text in the order of the document; array places are no part of a path."""
    nodes = walked(F.col(body) if isinstance(body, str) else body, "", FLAT_DEPTH, FLAT_KEYS, FLAT_ITEMS, "")
    scalars = F.filter(nodes, lambda n: ~is_container(n) & (n["path"] != ""))
    name = lambda n: F.when(n["kind"] == "STR", "string").when(n["kind"] == "BOO", "boolean").otherwise("number")
    return F.transform(scalars, lambda n: F.struct(n["path"].alias("path"), n["text"].alias("value"), name(n).alias("vtype")))


def ends_with(keys: tuple[str, ...]) -> str:
    return r"(?i)(?:^|\.)(?:" + "|".join(map(re.escape, keys)) + r")$"


def pick(flat: Column, keys: tuple[str, ...], able: Callable[[Column], Column], any_other: bool = False) -> Column:
    """(value, vtype) of the shortest path of flat_json that ends in one of the keys, the first among equals; or else the first able value at all."""
    fits = F.filter(flat, lambda f: f["path"].rlike(ends_with(keys)) & able(f))
    best = F.array_min(F.transform(fits, lambda f, i: F.struct(F.length(f["path"]).alias("n"), i.alias("i"), f.alias("f"))))["f"]
    return F.coalesce(best, F.get(F.filter(flat, able), 0)) if any_other else best


def pick_path(flat: Column, keys: tuple[str, ...]) -> Column:
    return pick(flat, keys, lambda f: F.lit(True))["value"]


def a_text(least: int, most: int | None = None) -> Callable[[Column], Column]:
    size = lambda f: F.length(f["value"])
    return lambda f: (f["vtype"] == "string") & (size(f) >= least) & ((size(f) <= most) if most is not None else F.lit(True))


def a_scalar(f: Column) -> Column:
    return f["vtype"].isin("string", "number")


def like(pattern: str) -> Callable[[Column], Column]:
    return lambda f: (f["vtype"] == "string") & f["value"].rlike(pattern)


def price_of(f: Column) -> Column:
    """The price of a picked value."""
    return F.when(f["vtype"] == "number", f["value"].try_cast("double")).when(f["vtype"] == "string", parse_price(f["value"]))


#: Paths of keys that are asked for as they are.
ASKED = tuple(dict.fromkeys((*PROMOTION_PRICE_PATHS, *REGULAR_PRICE_PATHS, *LABEL_PATHS, *DISCOUNT_PATHS, "pricing.promotion", "em_oferta", "oferta", "clube", "exclusive", "siteExclusive")))


def asked(whole: Column) -> Column:
    """(value, vtype) at each path of ASKED; no type where nothing or null stands."""
    kind = lambda p: kind_of(F.try_variant_get(whole, f"$.{p}", "variant"))
    found = F.array(*(F.struct(F.try_variant_get(whole, f"$.{p}", "string").alias("value"), kind(p).alias("kind")) for p in ASKED))
    name = lambda k: F.when(k == "STR", "string").when(k == "BOO", "boolean").when(k.isin("OBJ", "ARR"), "container").when(k != "VOI", "number")
    return F.transform(found, lambda f: F.struct(f["value"].alias("value"), name(f["kind"]).alias("vtype")))


class Item:
    """A product object: what stands at the paths of ASKED, and its flat list for key patterns."""

    def __init__(self, found: Column, flat: Column):
        self.found, self.flat = found, flat

    def at(self, path: str) -> Column:
        """(value, vtype); without a type where nothing or null stands."""
        return F.get(self.found, ASKED.index(path))

    def holds(self, path: str) -> Column:
        """Whether a value that counts as true stands there: not false, 0 or an empty text."""
        f = self.at(path)
        no = ((f["vtype"] == "boolean") & (f["value"] == "false")) | ((f["vtype"] == "number") & (f["value"].try_cast("double") == 0)) | ((f["vtype"] == "string") & (f["value"] == ""))
        return f["vtype"].isNotNull() & ~no

    def price(self, paths: tuple[str, ...]) -> Column:
        return F.coalesce(*(price_of(self.at(p)) for p in paths))

    def picked(self) -> Column:
        """What the key patterns find."""
        flat = self.flat
        value = lambda keys, able, **more: pick(flat, keys, able, **more)["value"]
        badges = F.filter(flat, lambda f: f["path"].rlike(ends_with(BADGES)) & a_text(2, 80)(f))
        return F.struct(
            value(NAMES, lambda f: a_text(3)(f) & ~f["value"].rlike(PRICE), any_other=True).alias("name"),
            pick(flat, PRICES, a_scalar).alias("price"),
            pick(flat, ORIGINALS, a_scalar).alias("old"),
            pick(flat, IDS, a_scalar).alias("id"),
            value(LINKS, like(r"(?i)^(?:https?://|/|[a-z0-9-]+$)")).alias("link"),
            value(IMAGES, like(r"(?i)^(?:/|https?://|base/|imgs/)")).alias("image"),
            value(PROMOTIONS, a_text(2, 80)).alias("promotion"),
            value(DISCOUNTS, a_scalar).alias("discount"),
            value(LIMITS, a_text(3, 80)).alias("limit"),
            value(UNITS, a_text(0, 20)).alias("unit"),
            F.slice(F.transform(badges, lambda f: f["value"]), 1, 12).alias("badges"),
            F.coalesce(*(F.when(self.holds(p), self.at(p)["value"]) for p in LABEL_PATHS)).alias("label"),
        )

    def prices(self, p: Column) -> Column:
        """(current, original, promotion)."""
        seen = F.struct(self.price(PROMOTION_PRICE_PATHS).alias("promoted"), self.price(REGULAR_PRICE_PATHS).alias("regular"), price_of(p["price"]).alias("flat"), price_of(p["old"]).alias("old"))
        flag = self.holds("pricing.promotion") | self.holds("em_oferta") | self.holds("oferta")

        def state(s: Column) -> Column:
            current = F.coalesce(s["promoted"], s["regular"], s["flat"])
            before = F.when(s["promoted"].isNotNull(), F.coalesce(s["regular"], s["old"])).otherwise(s["old"])
            original = F.when(before > current, before)
            return F.struct(current.alias("current"), original.alias("original"), (flag | original.isNotNull()).alias("promotion"))

        return let(seen, state)

    def shaped(self, p: Column, source_url: Column) -> Column:
        """The fields of RAW out of what was picked, before it is known whether they make a product."""
        exclusive = self.holds("exclusive") | self.holds("siteExclusive")
        more = F.array_compact(F.array(squeeze(p["label"]), F.when(self.holds("clube"), F.lit("Clube")), F.when(exclusive, F.lit("Exclusivo do site"))))
        no_id = (p["id"]["value"] == "") | ((p["id"]["vtype"] == "number") & (p["id"]["value"].try_cast("double") == 0))
        link = F.when(p["link"].rlike(r"(?i)^(?:https?://|/)"), p["link"]).otherwise(F.concat(F.lit("/produto/"), p["link"]))
        return F.struct(
            F.when(~no_id, p["id"]["value"]).alias("id"),
            clean(F.regexp_replace(squeeze(p["name"]), PRICE, "")).alias("name"),
            self.prices(p).alias("state"),
            clean(p["price"]["value"]).alias("price"),
            clean(F.coalesce(p["label"], p["promotion"])).alias("label"),
            F.coalesce(*(self.at(x)["value"] for x in DISCOUNT_PATHS), p["discount"]).alias("discount"),
            F.concat(p["badges"], more).alias("badges"),
            clean(p["limit"]).alias("limit_text"),
            self.holds("clube").alias("club"),
            exclusive.alias("exclusive"),
            clean(p["unit"]).alias("unit"),
            let(p["image"], lambda x: joined(x, source_url)).alias("image"),
            let(link, lambda x: joined(x, source_url)).alias("link"),
        )

    def raw(self, source_url: Column) -> Column:
        """The fields of RAW; null if it is no product: no name or price, or neither image, link nor id."""

        def product(s: Column) -> Column:
            able = s["name"].isNotNull() & (s["state"]["current"].isNotNull() | s["price"].isNotNull()) & ~s["name"].rlike(r"(?i)^store\d+:") & F.coalesce(s["image"], s["link"], s["id"]).isNotNull()
            field = lambda c: s["state"][c] if c in ("current", "original", "promotion") else s[c]
            return F.when(able, F.struct(*(field(c).alias(c) for c in (x.split(" ")[0] for x in RAW.split(", ")))))

        return let(let(self.picked(), lambda p: self.shaped(p, source_url)), product)


def raw_product(text: Column, source_url: Column) -> Column:
    """The product that a JSON object is, or null."""
    return let(F.struct(let(F.try_parse_json(text), asked).alias("found"), flat_json(text).alias("flat")), lambda x: Item(x["found"], x["flat"]).raw(source_url))


def found_arrays(body: Column | str, url: Column | str) -> Column:
    """(path, score, items) of the arrays of a JSON body that hold products, in the order of the document."""
    body, url = (F.col(c) if isinstance(c, str) else c for c in (body, url))
    arrays = F.filter(walked(body, "$", WALK_DEPTH, WALK_KEYS, WALK_ITEMS, "[]"), lambda n: n["kind"] == "ARR")
    hint = lambda x, words: F.coalesce(x.rlike(f"(?i){words}"), F.lit(False)).cast("int")

    def found(n: Column) -> Column:
        objects = F.filter(F.arrays_zip(F.from_json(n["text"], "array<string>").alias("raw"), F.from_json(n["text"], "array<variant>").alias("typed")), lambda e: kind_of(e["typed"]) == "OBJ")
        products = F.filter(F.transform(objects, lambda e: raw_product(e["raw"], url)), lambda p: p.isNotNull())
        return let(products, lambda ps: F.struct(n["path"].alias("path"), (10 * F.size(ps) + 20 * hint(n["path"], ARRAY_WORDS) + 15 * hint(url, URL_WORDS)).alias("score"), ps.alias("items")))

    return F.filter(F.transform(arrays, found), lambda a: F.size(a["items"]) > 0)
