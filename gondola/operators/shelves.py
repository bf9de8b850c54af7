"""Shelf pages of one chain's shops: cards under a known selector, departments by their links."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola import schemas
from gondola.functions import cards, prices, text, urls
from gondola.operators import ranking

PAGES = "department_id string, department_label string, department_url string, page int, url string, html string, store_label string, effective_city string"
# Prices with cents, units and product numbers as these cards show them.
PRICE = r"R\$\s*\d[\d.]*,\d{2}"
UNIT = re.compile(r"/\s*([a-zA-Z]{1,6})\b")
NUMBER = r"/produto/(\d+)/"


def products(pages: DataFrame, card: str) -> DataFrame:
    """Shelf products (schemas.SHELF_PRODUCT) of PAGES rows: cards with a name and a price over 0."""
    keys = [f.split(" ")[0] for f in PAGES.split(", ") if not f.startswith("html")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                for k, node in enumerate(cards.select(cards.tree(row.html), card)):
                    link = next((x.attrs["href"] for x in node.walk() if x.tag == "a" and "/produto/" in x.attrs.get("href", "")), None)
                    alt = next((x.attrs["alt"] for x in node.walk() if x.tag == "img" and x.attrs.get("alt")), None)
                    label = next((t for x in node.walk() if x.tag == "span" and (t := x.text())), None)
                    unit = UNIT.search(node.text())
                    out.append((*(getattr(row, c) for c in keys), k + 1, label or alt, node.text(), unit[1].lower() if unit else None, urls.join_url(cards.first_image(node), row.url), urls.join_url(link, row.url)))
            yield pd.DataFrame(out, columns=[*keys, "at", "name", "text", "unit_name", "image_url", "product_url"])

    schema = ", ".join([f for f in PAGES.split(", ") if not f.startswith("html")]) + ", at int, name string, text string, unit_name string, image_url string, product_url string"
    found = F.filter(F.transform(F.regexp_extract_all("text", F.lit(PRICE), 0), prices.parse_shelf_price), lambda p: p.isNotNull())
    rows = pages.mapInPandas(run, schema).withColumn("name", text.clean(F.col("name"))).withColumn("found", found).where("name is not null and size(found) > 0")
    current, original = F.array_min("found"), F.array_max("found")
    higher, number = original > current, text.empty_to_null(F.regexp_extract("product_url", NUMBER, 1))
    return rows.select(
        F.concat_ws("-", "department_id", F.col("page").cast("string"), F.coalesce(number, F.col("at").cast("string"))).alias("row_id"), number.alias("product_id"), "name",
        prices.format_price(current).alias("price"), current.alias("price_value"), F.when(higher, prices.format_price(original)).alias("original_price"), F.when(higher, original).alias("original_price_value"),
        prices.discount_percent(F.lit(None).cast("string"), current, original).alias("discount_percent"), F.concat(F.lit("/"), "unit_name").alias("unit"), "image_url", "product_url",
        "department_id", "department_label", "department_url", "page", "store_label", "effective_city",
    ).select(*[f.split(" ")[0] for f in schemas.SHELF_PRODUCT.split(", ")])


def departments(links: DataFrame, most: int | None = None) -> DataFrame:
    """(page_id, id, label, url) of the department links of each page, each URL once, in order."""
    able = links.where(F.contains("href", F.lit("/departamentos/")) & (F.col("text") != ""))
    once = ranking.keep_first(able, ["page_id", "href"], [F.col("seq")])
    kept = ranking.top(once, ["page_id"], [F.col("seq")], most or 1 << 30)
    return kept.select("page_id", text.slug(F.col("text")).alias("id"), F.col("text").alias("label"), F.col("href").alias("url"))
