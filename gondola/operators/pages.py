"""Landed pages to items and links."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.functions import cards, payloads, urls
from gondola.functions.badges import LIMITS, badge_list, club_offer, first_like, product_badges, promotion_from_badges, site_exclusive
from gondola.functions.badges import campaign_label as badge_campaign
from gondola.functions.prices import format_price, price_state
from gondola.functions.text import SPACE, either
from gondola.operators import ranking, scoring
from gondola.operators.nodes import extracted, headings, links  # noqa: F401 read by name from here

# Lines that begin with a price, and those that are no names.
PRICE_FIRST = rf"(?i)^R\${SPACE}*\d"
NO_NAME = rf"(?i)^R\${SPACE}*\d|^(?:comprar|adicionar)$"
#: Arrays of a page that are kept.
MATCHES = 8
CARD = "id string, name string, current double, original double, promotion boolean, badges array<string>, image string, link string"


def page_groups(pages: DataFrame) -> DataFrame:
    """(page_id, url, groups) of each page (page_id, url, html): the cards of each group as they are found. Broken pages have none."""

    def item(c: dict, url: str | None) -> dict:
        return {**c, "image": urls.join_url(c["image"], url), "link": urls.join_url(c["link"], url)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [[{"selector": s, "cards": [item(c, url) for c in of]} for s, of in cards.page_groups(html)] for url, html in zip(pdf["url"], pdf["html"])]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "groups": found})

    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id long, url string, groups array<struct<selector:string,cards:array<struct<{','.join(':'.join(f.split(' ')) for f in CARD.split(', '))}>>>>")


def group_measures(found: Column) -> dict[str, Column]:
    """n, shares of cards with a price, a link and an image, and the mean length of names of a group's cards."""
    n = F.size(found)
    share = lambda has: F.size(F.filter(found, has)) / n
    length = F.aggregate(found, F.lit(0), lambda total, c: total + F.length(c["name"])) / n
    return {"n": n, "price": share(lambda c: c["current"].isNotNull()), "link": share(lambda c: c["link"] != ""), "image": share(lambda c: c["image"] != ""), "name_length": length}


def group_score(m: dict[str, Column]) -> Column:
    return 8 * m["n"] + 25 * m["price"] + 12 * m["link"] + 10 * m["image"] + F.least(m["name_length"], F.lit(80)) / 10


def able_groups(groups: Column) -> Column:
    return F.filter(groups, lambda g: F.size(g["cards"]) >= cards.LEAST_CARDS)


def page_items(pages: DataFrame) -> DataFrame:
    """Items of the best group of cards on each page (page_id, url, html), with its selector; the first among equals. A page's groups stay in its row, so nothing is shuffled."""
    ranked = F.transform(able_groups(F.col("groups")), lambda g, k: F.struct(group_score(group_measures(g["cards"])).alias("score"), (-k).alias("first"), g.alias("group")))
    best = page_groups(pages).select("page_id", "url", F.array_max(ranked)["group"].alias("best"))
    return best.select("page_id", "url", F.col("best.selector").alias("selector"), F.posexplode("best.cards").alias("seq", "card")).select("page_id", "url", "selector", "seq", "card.*")


def hinted_items(pages: DataFrame, selector: str, most: int) -> DataFrame:
    """Items of the cards that a known selector finds on each page (page_id, url, html), each item's key once, at most `most` a page. Unlike page_items(): the image's alt, then the longest line, is the name; any number of prices counts; the id is the card's own or none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
                nodes = cards.select(cards.tree(html), selector)
                for k, node in enumerate(nodes):
                    c = cards.hinted(node)
                    rows.append((page_id, url, k, len(nodes), c["id"], c["alt"], c["lines"], c["text"], c["marked"], urls.join_url(c["image"], url), urls.join_url(c["link"], url)))
            yield pd.DataFrame(rows, columns=["page_id", "url", "seq", "totalMatched", "id", "alt", "lines", "text", "marked", "image", "link"])

    schema = "page_id long, url string, seq int, totalMatched int, id string, alt string, lines array<string>, text string, marked array<struct<text:string,marks:string>>, image string, link string"
    named = F.filter("lines", lambda x: ~x.rlike(NO_NAME))
    longest = F.get(F.array_sort(F.transform(named, lambda x, i: F.struct((-F.length(x)).alias("size"), i.alias("i"), x.alias("line")))), 0)["line"]
    rows = pages.select("page_id", "url", "html").mapInPandas(run, schema).withColumn("name", F.coalesce("alt", longest)).withColumn("state", price_state(F.col("text")))
    told = lambda m: m["marks"].rlike(f"(?iu){cards.BADGE_CLASS.pattern}") | m["text"].rlike(f"(?iu){cards.BADGE_TEXT.pattern}") | m["text"].rlike(cards.BADGE_PERCENT.pattern)
    able = F.filter("marked", lambda m: (F.length(m["text"]) <= 80) & ~m["text"].rlike(PRICE_FIRST) & (F.lower(m["text"]) != F.lower("name")) & told(m))
    found = rows.where("name is not null and state is not null").withColumn("badges", product_badges(F.transform(able, lambda m: m["text"])))
    label, current, original = promotion_from_badges(F.col("badges")), F.col("state.current"), F.col("state.original")
    items = ranking.top(found, ["page_id"], [F.col("seq")], most).select(
        "page_id", "url", "seq", "totalMatched", "id", "name", format_price(current).alias("price"), current.alias("current"), original.alias("original"), format_price(original).alias("originalPrice"), original.isNotNull().alias("promotion"), label.alias("promotionLabel"), label.alias("campaignLabel"), "badges",
        first_like(F.col("badges"), either(*LIMITS)).alias("limitText"), club_offer(F.col("badges")).alias("isClubOffer"), site_exclusive(F.col("badges")).alias("isSiteExclusive"), F.lit(None).cast("int").alias("discountPercent"), F.lit(None).cast("string").alias("unit"), "image", "link",
    )
    return ranking.distinct_extracted(items, ["page_id"])


def group_stats(pages: DataFrame) -> DataFrame:
    """(page_id, selector, n, price, link, image, name_length, score) of each group of cards."""
    rows = page_groups(pages).select("page_id", F.explode(able_groups(F.col("groups"))).alias("g"))
    measures = group_measures(F.col("g.cards"))
    return rows.select("page_id", "g.selector", *(c.alias(name) for name, c in measures.items()), group_score(measures).alias("score"))


def href_values(html: Column) -> Column:
    """The double-quoted href values of a page, by pattern alone."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)


def discovered_links(found: DataFrame, n: int = 24) -> DataFrame:
    """The best n links of each page that stay on its origin, look like a catalogue's and were not seen before on it."""
    able = found.where(scoring.discovered_able(F.col("href"), F.col("text"), urls.origin(F.col("url")))).withColumn("score", scoring.discovered_score(F.col("href"), F.col("text")))
    best = ranking.top(able, ["page_id"], [F.col("score").desc(), F.col("seq")], n)
    return ranking.keep_first(best, ["page_id", "href"], [F.col("rank")])


def max_page_number(found: DataFrame, n: int = 500) -> DataFrame:
    """(page_id, pages): the largest whole number between 1 and n that is a link's text, else 1."""
    number = F.when(F.col("text").rlike(r"^\d{1,9}$"), F.col("text").try_cast("int"))
    return found.groupBy("page_id").agg(F.coalesce(F.max(F.when((number > 0) & (number < n), number)), F.lit(1)).alias("pages"))


def total_products(text: Column) -> Column:
    """The number in front of Produtos."""
    return F.regexp_extract(text, rf"(?i)(\d+){SPACE}+Produtos", 1).try_cast("int")


def heading_sections(found: DataFrame, heads: DataFrame, n: int = 60) -> DataFrame:
    """For each of a page's first n headings the best link of the first place around it that has one, labelled by the heading."""
    able = ranking.top(heads.where(~scoring.like(F.col("label"), scoring.SECTION_NOT)), ["page_id"], [F.col("heading")], n)
    places = able.select("page_id", "heading", "label", F.posexplode("places").alias("nth", "place"))
    on_site = found.where(F.col("href").startswith(urls.origin(F.col("url"))) & ~F.col("in_frame") & ~scoring.like(F.col("href"), scoring.SECTION_PRODUCT))
    scored = on_site.where(~scoring.like(scoring.both(F.col("text"), F.col("href")), scoring.SECTION_NOT)).withColumn("score", scoring.section_link_score(F.col("text"), F.col("href"), F.col("has_image")))
    near = scored.where("score > 0").join(places, "page_id").where(F.col("seq").between(F.col("place.first"), F.col("place.last")))
    best = ranking.keep_first(near, ["page_id", "heading"], [F.col("nth"), F.col("score").desc(), F.col("seq")])
    return best.withColumn("text", F.col("label")).withColumn("score", F.col("score") + 80).withColumn("seq", F.col("heading")).select(*found.columns, "score")


def sections(found: DataFrame, n: int, heads: DataFrame | None = None) -> DataFrame:
    """The best n section links of each page: those that its headings name, if given, and links on its origin that are no product or account page; each URL once."""
    on_site = found.where(F.col("href").startswith(urls.origin(F.col("url"))) & ~F.col("in_frame") & ~scoring.like(F.col("href"), scoring.SECTION_PRODUCT))
    hay = scoring.both(F.col("text"), F.col("href"))
    able = on_site.where(scoring.like(hay, scoring.SECTION_ABLE) & ~scoring.like(hay, scoring.SECTION_NOT))
    scored = able.withColumn("score", scoring.section_score(F.col("text"), F.col("href"), F.col("has_image")))
    best = ranking.top(scored, ["page_id"], [F.col("score").desc(), F.col("seq")], 3 * n).drop("rank").withColumn("kind", F.lit(1))
    if heads is not None:
        best = heading_sections(found, heads).withColumn("kind", F.lit(0)).unionByName(best)
    order = [F.col("score").desc(), F.col("kind"), F.col("seq")]
    once = ranking.keep_first(ranking.top(best, ["page_id"], order, 6 * n).drop("rank"), ["page_id", "href"], order)
    return ranking.top(once, ["page_id"], order, n).drop("kind")


def match_rows(captures: DataFrame) -> DataFrame:
    """(page_url, seq, responseUrl, n, path, score, normalizedCount) of each product array of captures (page_url, seq, url, content_type, body)."""
    able = captures.where(scoring.capture_able(F.col("url"), F.col("content_type"), F.col("body")))
    arrays = able.select("page_url", "seq", F.col("url").alias("responseUrl"), F.posexplode(payloads.found_arrays("body", "url")).alias("n", "found"))
    return arrays.select("page_url", "seq", "responseUrl", "n", "found.path", "found.score", F.size("found.items").alias("normalizedCount"))


def payload_matches(captures: DataFrame, n: int = MATCHES) -> DataFrame:
    """(page_url, rank, path, responseUrl, score, normalizedCount) of the best n arrays of each page_url's captures."""
    return ranking.top(match_rows(captures), ["page_url"], [F.col("score").desc(), F.col("seq"), F.col("n")], n).select("page_url", "rank", "path", "responseUrl", "score", "normalizedCount")


def payload_items(captures: DataFrame, most: int) -> DataFrame:
    """Items of captured JSON responses (url, content_type, body): arrays by score, each item's key once, at most `most` a page_url."""
    able = captures.where(scoring.capture_able(F.col("url"), F.col("content_type"), F.col("body")))
    arrays = able.select("page_url", "seq", F.posexplode(payloads.found_arrays("body", "url")).alias("n", "found")).select("page_url", "seq", "n", "found.*")
    best = ranking.top(arrays, ["page_url"], [F.col("score").desc(), F.col("seq"), F.col("n")], 1 << 30)
    items = best.select("page_url", "rank", F.posexplode("items").alias("k", "item")).select("page_url", F.struct("rank", "k").alias("seq"), "item.*")
    shaped = items.select("*", format_price(F.col("current")).alias("price"), F.col("original").alias("originalPrice"), F.col("discount").alias("discountPercent"), F.col("label").alias("promotionLabel"), F.col("limit_text").alias("limitText"), F.col("label").alias("campaignLabel"), F.col("club").alias("isClubOffer"), F.col("exclusive").alias("isSiteExclusive"))
    once = ranking.distinct_extracted(shaped.withColumn("badges", badge_list(F.col("badges"))), ["page_url"])
    return ranking.top(once, ["page_url"], [F.col("seq")], most).select("page_url", F.col("rank").alias("seq"), "id", "name", "current", "original", "promotion", F.col("label"), badge_campaign(F.col("label"), F.col("badges")).alias("campaign"), "discount", "badges", F.col("limit_text"), "club", "exclusive", "unit", "image", "link")
