"""Discovery of each site's catalogue root: a scored frontier of candidates, then the best of those inspected.

All sites move on in the same rounds, each with a budget of pages of its own. A site's state is never more than its budget
of rows: what waits behind as many better candidates as the budget still allows can't be reached any more, so it is
dropped, which changes nothing.

Defined results: a site's repeated candidates count once, at their first place; null sites, urls and links are left out; links of
pages that nobody landed are none; a site without candidates has no row; of equal scores the first found is inspected, and
of equal root scores the first inspected is chosen; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.functions import urls
from gondola.operators import ranking, scoring
from gondola.plans.catalog import ROOTS
from gondola.shared import scratch


def candidates(sites: DataFrame) -> DataFrame:
    """(site, url, place): the roots that are preferred for a site, its own page, then the usual roots. sites: (site, preferred array<string>)."""
    every = F.concat(F.coalesce("preferred", F.array().cast("array<string>")), F.array("site"), urls.root_candidates(F.col("site")))
    return sites.select("site", F.posexplode(every).alias("place", "url"))


def inspected(starts: DataFrame, links: DataFrame, able: Column | None = None, score: Column | None = None, budget: int = ROOTS) -> DataFrame:
    """(site, url, at) of the pages that each site's discovery inspects, in order. starts: (site, url, place); links: (url, href, nth)
    of landed pages. Without a score pages are met first in, first out, and a round takes all that wait; with one (an
    expression over url) a round takes the best that waits of each site, so there are at most `budget` rounds."""
    able = scoring.catalog_link(F.col("href")) if able is None else able
    step = budget if score is None else 1
    score = F.lit(0) if score is None else score
    order = [F.col("score").desc_nulls_last(), F.col("place")]
    with scratch(starts.sparkSession) as keep:
        ways = ranking.keep_first(links.where(able & F.col("url").isNotNull() & F.col("href").isNotNull()).select("url", "href", "nth"), ["url", "href"], [F.col("nth")])
        ways = keep(ways, "root-links")
        first = ranking.keep_first(starts.where("site is not null and url is not null").select("site", "url", F.col("place").cast("long").alias("place")), ["site", "url"], [F.col("place")])
        first = first.withColumn("score", score.cast("double")).withColumn("at", F.lit(None).cast("int"))
        state = keep(ranking.top(first, ["site"], order, budget).drop("rank"), "root-state")
        while True:
            own = state.groupBy("site").agg(F.count("at").cast("int").alias("done"), F.max("place").alias("last"))
            waiting = ranking.top(state.where("at is null").drop("at").join(own, "site").where(F.col("done") < budget), ["site"], order, step)
            now = keep(waiting.where(F.col("done") + F.col("rank") <= budget).withColumn("at", F.col("done") + F.col("rank")), "root-now")
            if now.isEmpty():
                break
            met = now.select("site", F.col("url").alias("from"), "at", "last").join(ways.withColumnRenamed("url", "from"), "from").select("site", F.col("href").alias("url"), "at", "nth", "last")
            fresh = ranking.keep_first(met, ["site", "url"], [F.col("at"), F.col("nth")]).join(state.select("site", "url"), ["site", "url"], "left_anti")
            fresh = fresh.withColumn("score", score.cast("double"))
            # Places go on in the order of meeting; a row's rank among all that are fresh, of which only the budget's best stay.
            fresh = _placed(fresh, budget)
            moved = state.join(now.select("site", "url", F.col("at").alias("_now")), ["site", "url"], "left").withColumn("at", F.coalesce("at", "_now")).drop("_now")
            grown = moved.unionByName(fresh.select("site", "url", "place", "score", F.lit(None).cast("int").alias("at")))
            # Inspected pages first, then the best that wait: never more than the budget.
            state = keep(ranking.top(grown, ["site"], [F.col("at").asc_nulls_last(), *order], budget).drop("rank"), "root-state")
        return keep(state.where("at is not null").select("site", "url", "at"), "root-inspected", last=True)


def _placed(fresh: DataFrame, budget: int) -> DataFrame:
    """The best `budget` fresh links of each site with their places. Links of equal score keep the order in which they were met, so the best are found before they are placed."""
    best = ranking.top(fresh, ["site"], [F.col("score").desc_nulls_last(), F.col("at"), F.col("nth"), F.col("url")], budget).drop("rank")
    return ranking.top(best, ["site"], [F.col("at"), F.col("nth"), F.col("url")], budget).withColumn("place", F.col("last") + F.col("rank"))


def scored(visited: DataFrame, pages: DataFrame) -> DataFrame:
    """(site, url, at, finalUrl, strategy, n_items, n_links, score) of each inspected page. pages: (url, finalUrl, strategy, n_items, n_links), one row a url; pages that nobody landed have neither items nor links."""
    found = visited.join(pages.select("url", "finalUrl", "strategy", "n_items", "n_links"), "url", "left").fillna({"strategy": "none", "n_items": 0, "n_links": 0})
    found = found.withColumn("finalUrl", F.coalesce("finalUrl", "url"))
    score = scoring.root_score(F.col("finalUrl"), F.col("url"), F.col("strategy"), F.col("n_items"), F.col("n_links"))
    return found.select("site", "url", "at", "finalUrl", "strategy", "n_items", "n_links", score.cast("long").alias("score"))


def chosen(candidates: DataFrame) -> DataFrame:
    """(site, rootUrl, score, inspected): the best of each site's scored pages, the first among equals."""
    best = F.max_by("finalUrl", F.struct("score", -F.col("at")))
    return candidates.groupBy("site").agg(best.alias("rootUrl"), F.max("score").alias("score"), F.count("*").alias("inspected"))
