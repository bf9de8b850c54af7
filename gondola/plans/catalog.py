"""From landed pages and captures to a catalogue of products, and the frontier of pages to land next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.functions import badges, prices, text, urls
from gondola.operators import pages as page_ops
from gondola.operators import ranking, scoring
from gondola.shared import written

PAGES, ITEMS, ROOTS, LINKS_A_PAGE, INSPECTED = 8, 250, 10, 12, 8


def visit_cap(pages: int) -> int:
    return max(pages, 4 * pages, pages + 6)


def normalised_products(items: DataFrame) -> DataFrame:
    """Items (with section and page columns) as products: without those that have no name or no price over 0."""
    own = badges.product_badges(F.col("badges"))
    higher = F.col("original") > F.col("current")
    limit = F.coalesce(badges.limit_text(F.col("limit_text")), badges.first_like(own, text.either(*badges.LIMITS)))
    rows = items.where(F.col("current") > 0).withColumn("badges", own).withColumn("name", text.product_text(F.col("name"))).where("name is not null")
    return rows.select(
        text.empty_to_null(F.col("id")).alias("id"), "name", prices.format_price(F.col("current")).alias("price"), F.col("current").alias("priceValue"),
        F.when(higher, prices.format_price(F.col("original"))).alias("originalPrice"), F.when(higher, F.col("original")).alias("originalPriceValue"),
        (F.coalesce("promotion", F.lit(False)) | F.coalesce(higher, F.lit(False))).alias("isPromotion"), F.col("label").alias("promotionLabel"), "badges",
        badges.product_campaign(F.coalesce("campaign", "label"), F.col("sectionLabel"), F.col("badges")).alias("campaignLabel"), limit.alias("limitText"),
        (F.coalesce("club", F.lit(False)) | badges.club_offer(F.col("badges"))).alias("isClubOffer"), (F.coalesce("exclusive", F.lit(False)) | badges.site_exclusive(F.col("badges"))).alias("isSiteExclusive"),
        prices.discount_percent(F.col("discount"), F.col("current"), F.col("original")).alias("discountPercent"), text.empty_to_null(F.col("unit")).alias("unit"),
        "image", "link", "sectionId", "sectionLabel", "sectionUrl", "pageUrl", "seq",
    )


def page_candidates(pages: DataFrame, captures: DataFrame, most: int = ITEMS) -> DataFrame:
    """For each page its items, from the captures only if those gave strictly more. captures: (page_url, seq, url, content_type, body)."""
    dom = ranking.top(page_ops.page_items(pages), ["url"], [F.col("seq")], most).drop("rank")
    dom = dom.select(F.col("url").alias("pageUrl"), "seq", "id", "name", "current", "original", "promotion", badges.promotion_from_badges(F.col("badges")).alias("label"), badges.promotion_from_badges(F.col("badges")).alias("campaign"), F.lit(None).cast("string").alias("discount"), "badges", F.lit(None).cast("string").alias("limit_text"), F.lit(None).cast("boolean").alias("club"), F.lit(None).cast("boolean").alias("exclusive"), F.lit(None).cast("string").alias("unit"), "image", "link", F.lit("dom").alias("strategy"))
    network = page_ops.payload_items(captures, most).withColumnRenamed("page_url", "pageUrl").withColumn("strategy", F.lit("network"))
    every = dom.unionByName(network)
    n = every.groupBy("pageUrl").agg(F.count_if(F.col("strategy") == "dom").alias("dom"), F.count_if(F.col("strategy") == "network").alias("network"))
    chosen = n.select("pageUrl", ranking.chosen_strategy(F.col("dom"), F.col("network")).alias("strategy"))
    return every.join(chosen, ["pageUrl", "strategy"])


def section_queue(sections: DataFrame, links: DataFrame, most_pages: int = PAGES, most_links: int = LINKS_A_PAGE) -> DataFrame:
    """The pages that the crawl of each section visits, in order: those of sections, then, page after page, the at most `most_links` best related links of each that are not queued yet, up to the cap. links: those of the landed pages."""
    cap, own = visit_cap(most_pages), ["sectionId", "sectionLabel", "sectionUrl"]
    found = written(page_ops.discovered_links(links).select(F.col("url").alias("pageUrl"), "href", F.col("rank").alias("nth")), "page-links")
    first = ranking.top(ranking.keep_first(sections, ["sectionId", "pageUrl"], [F.col("place")]), ["sectionId"], [F.col("place")], cap)
    queue = written(first.select(*own, "pageUrl", (F.col("rank") - 1).alias("place")), "section-queue")
    for at in range(cap):  # one page of every section a round
        now = queue.where(F.col("place") == at)
        if now.isEmpty():
            break
        related = now.join(found, "pageUrl").withColumn("score", scoring.related_section_score(F.col("href"), F.col("sectionUrl"))).where("score > 0")
        order = [F.col("score").desc(), F.col("nth")]
        once = ranking.keep_first(ranking.top(related, ["sectionId"], order, 2 * most_links).drop("rank"), ["sectionId", "href"], order)
        fresh = once.select(*own, F.col("href").alias("pageUrl"), "score", "nth").join(queue.select("sectionId", "pageUrl"), ["sectionId", "pageUrl"], "left_anti")
        size = queue.groupBy("sectionId").agg(F.count("*").alias("size"))
        more = ranking.top(fresh, ["sectionId"], order, most_links).join(size, "sectionId").withColumn("place", (F.col("size") + F.col("rank") - 1).cast("int")).where(F.col("place") < cap)
        more = written(more.select(*queue.columns), "section-more")
        if not more.isEmpty():
            queue = written(queue.unionByName(more), "section-queue")
    return queue


def catalogue(pages: DataFrame, captures: DataFrame, sections: DataFrame, most_pages: int = PAGES) -> DataFrame:
    """Products of all sections. sections: (sectionId, sectionLabel, sectionUrl, pageUrl, place): the first pages of each, whose related links join the section's queue up to the cap; pages whose items an earlier page of the section had are left out."""
    visited = section_queue(sections, page_ops.links(pages), most_pages)
    items = page_candidates(pages, captures).withColumn("price", F.col("current"))
    marks = visited.join(ranking.fingerprints(items, ["pageUrl"]), "pageUrl", "left")
    fresh = ranking.first_pages(marks, ["sectionId"], "place").drop("fingerprint")
    placed = items.drop("price", "strategy").join(fresh, "pageUrl")
    ordered = placed.withColumn("seq", F.struct("sectionId", "place", "seq")).drop("place")
    return ranking.distinct_products(normalised_products(ordered)).drop("seq")


def section_pages(links: DataFrame, most: int = PAGES) -> DataFrame:
    """(sectionUrl, pageUrl, place): the section's own page, related pages by score, explicit numbered pages and those that page numbers imply; each URL once, at most `most` a section. links: (url, seq, href, text) of each section's page."""
    hay = scoring.both(F.col("text"), F.col("href"))
    on_site = links.where(F.col("href").startswith(urls.origin(F.col("url"))) & ~scoring.like(F.col("href"), scoring.PRODUCT_PAGE) & ~scoring.like(hay, scoring.ACCOUNT))
    own = links.select(F.col("url").alias("sectionUrl"), F.col("url").alias("pageUrl")).distinct().withColumn("kind", F.lit(0)).withColumn("at", F.lit(0))
    related = on_site.where(scoring.like(hay, scoring.RELATED_ABLE)).withColumn("score", scoring.related_score(F.col("text"), F.col("href"), F.col("url")))
    related = ranking.top(related, ["url"], [F.col("score").desc(), F.col("seq")], 2 * most).select(F.col("url").alias("sectionUrl"), F.col("href").alias("pageUrl"), F.lit(1).alias("kind"), F.col("rank").alias("at"))
    explicit = on_site.where(scoring.like(F.col("href"), scoring.PAGE_MARK)).select(F.col("url").alias("sectionUrl"), F.col("href").alias("pageUrl"), F.lit(2).alias("kind"), F.col("seq").alias("at"))
    number = F.regexp_extract("text", r"^\s*(\d{1,9})", 1).try_cast("int")
    last = on_site.groupBy("url").agg(F.max(F.when(number.between(2, most), number)).alias("last"))
    implied = last.select(F.col("url").alias("sectionUrl"), F.posexplode(urls.numbered_pages(F.col("url"), F.col("last"), most)).alias("at", "pageUrl")).select("sectionUrl", "pageUrl", F.lit(3).alias("kind"), "at")
    every = own.unionByName(related).unionByName(explicit).unionByName(implied)
    once = ranking.keep_first(every, ["sectionUrl", "pageUrl"], [F.col("kind"), F.col("at")])
    return ranking.top(once, ["sectionUrl"], [F.col("kind"), F.col("at")], max(most, 1)).select("sectionUrl", "pageUrl", F.col("rank").alias("place"))


def enough(n_items: Column, url: Column) -> Column:
    """Whether the first candidate's items suffice: 20, or 5 on a page that isn't the site's root."""
    return (n_items >= 20) | (~urls.root_like(url) & (n_items >= 5))


def investigated(inputs: DataFrame, pages: DataFrame, captures: DataFrame, most: int = INSPECTED) -> DataFrame:
    """(inputUrl, url, seq, n_items, strategy, error, best) of the candidates inspected for each input: its own page; unless that has enough items, then the known profile's, the common pages and the first page's links, `most` in all. inputs: (inputUrl, query, profileUrl). pages may have an error column: a page that failed is a candidate without items that tells its error."""
    failed = (pages if "error" in pages.columns else pages.withColumn("error", F.lit(None).cast("string"))).where("error is not null").groupBy("url").agg(F.min("error").alias("error"))
    pages = pages.join(failed.select("url"), "url", "left_anti")
    captures = captures.join(failed.select(F.col("url").alias("page_url")), "page_url", "left_anti")
    links = page_ops.discovered_links(page_ops.links(pages)).select(F.col("url").alias("inputUrl"), F.col("href").alias("url"), F.lit(3).alias("kind"), F.col("rank").alias("at"))
    own = inputs.select("inputUrl", F.col("inputUrl").alias("url"), F.lit(0).alias("kind"), F.lit(0).alias("at"))
    known = inputs.where("profileUrl <> ''").select("inputUrl", F.col("profileUrl").alias("url"), F.lit(1).alias("kind"), F.lit(0).alias("at"))
    common = inputs.select("inputUrl", F.posexplode(urls.search_candidates(F.col("inputUrl"), F.col("query"))).alias("at", "url")).select("inputUrl", "url", F.lit(2).alias("kind"), "at")
    every = own.unionByName(known).unionByName(common).unionByName(links.join(inputs.select("inputUrl"), "inputUrl", "left_semi"))
    order = [F.col("kind"), F.col("at")]
    listed = ranking.top(ranking.keep_first(every, ["inputUrl", "url"], order), ["inputUrl"], order, most).select("inputUrl", "url", (F.col("rank") - 1).alias("seq"))
    items = page_candidates(pages, captures).groupBy(F.col("pageUrl").alias("url")).agg(F.count("*").alias("n_items"), F.first("strategy").alias("strategy"))
    listed = listed.join(items, "url", "left").fillna({"n_items": 0, "strategy": "none"}).join(failed, "url", "left")
    stops = listed.where((F.col("seq") == 0) & enough(F.col("n_items"), F.col("inputUrl"))).select("inputUrl", F.lit(True).alias("stop"))
    seen = listed.join(stops, "inputUrl", "left").where((F.col("seq") == 0) | F.col("stop").isNull()).drop("stop")
    best = ranking.best_candidate(seen, ["inputUrl"]).select("inputUrl", "seq", F.lit(True).alias("best"))
    return seen.join(best, ["inputUrl", "seq"], "left").fillna(False, ["best"]).select("inputUrl", "url", "seq", "n_items", "strategy", "error", "best")


def frontier(links: DataFrame, seeds: DataFrame, able: Column | None = None, rounds: int = 10, most: int = ROOTS) -> DataFrame:
    """(url, depth) of at most `most` pages reached from seeds (url) over links (url, href), breadth first, each once.

    The edges are written once, and so are the pages of each round, which keeps the plan small; a round is one join.
    """
    able = scoring.catalog_link(F.col("href")) if able is None else able
    edges = written(links.where(able & (F.col("url") != F.col("href"))).select("url", F.col("href").alias("to")).distinct(), "frontier-edges")
    seen = written(seeds.select("url").distinct().withColumn("depth", F.lit(0)).orderBy("url").limit(most), "frontier")
    n = seen.count()
    for depth in range(1, rounds + 1):
        new = seen.where(F.col("depth") == depth - 1).join(edges, "url").select(F.col("to").alias("url")).distinct()
        new = new.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth))
        more = written(new.orderBy("url").limit(most - n), "frontier") if n < most else None
        grown = more.count() if more is not None else 0
        if not grown:
            break
        seen, n = seen.unionByName(more), n + grown
    return seen
