"""How a source gets its city: strategies one after the other, each of which is only ranked for the sources still open.

Every strategy gives a result per open source; a source stays open until a result is eligible, so later strategies' candidates are
joined with open sources alone. Of each strategy's candidates a few are kept a source (1 link, 12 triggers, 1 option), which Spark
does in each task before the shuffle.

Defined results: a source without a requested city gets the strategy `default` and is eligible; candidates with null texts count as
empty; candidates of sources that aren't asked for are ignored; of equal scores the first seq counts; a repeated source counts once; a
source without candidates keeps its last result, or `city-selection-unavailable` without any; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.functions import urls
from gondola.functions.text import empty_to_null, folded, folded_slug, squeeze, title_case
from gondola.operators import cities, ranking, scoring
from gondola.shared import scratch

TRIGGERS = 12
RESULT = ("site", "strategy", "storeLabel", "effectiveCity", "contextUrl", "cityCoverage", "cityEligible", "step")


def result(rows: DataFrame, strategy: str, step: int) -> DataFrame:
    """Rows (site, requestedCity, storeLabel, effectiveCity, contextUrl) with their coverage; a requested city that nothing confirms isn't eligible."""
    covered = rows.withColumn("effectiveCity", title_case(F.col("effectiveCity"))).withColumn("cityCoverage", cities.coverage(F.col("requestedCity"), F.col("effectiveCity")))
    return covered.withColumn("cityEligible", F.col("cityCoverage").isin("default", "match")).withColumn("strategy", F.lit(strategy)).withColumn("step", F.lit(step)).select(*RESULT)


def _named(rows: DataFrame) -> DataFrame:
    """Open sources with the folded city and its slug, worked out once a source."""
    return rows.select("site", "requestedCity", folded(F.trim("requestedCity")).alias("city"), folded_slug(F.col("requestedCity")).alias("slug"))


def _labels(labels: DataFrame, strategy: str) -> DataFrame:
    return labels.where(F.col("strategy") == strategy).groupBy("site").agg(F.min("label").alias("inferred"))


def directory(sources: DataFrame, links: DataFrame, labels: DataFrame) -> DataFrame:
    """The best link of each source that leads to its city. links: (site, seq, text, href)."""
    own = links.where(F.col("href").startswith(urls.origin(F.col("site")))).withColumn("text", F.coalesce(squeeze(F.col("text")), F.lit("")))
    rows = own.join(_named(sources), "site").withColumn("score", scoring.city_anchor_score(folded(F.col("text")), folded(squeeze(F.col("href"))), F.col("city"), F.col("slug"))).where("score > 0")
    best = ranking.keep_first(rows, ["site"], [F.col("score").desc(), F.col("seq")]).select("site", F.col("text").alias("label"), "href")
    found = sources.join(best, "site", "left").join(_labels(labels, "generic-city-directory"), "site", "left")
    label = empty_to_null(F.col("label"))
    city = F.when(F.col("href").isNotNull(), F.coalesce(cities.city_of(F.coalesce("inferred", label)), F.col("requestedCity")))
    return found.select("site", "requestedCity", F.when(F.col("href").isNotNull(), F.coalesce(label, F.col("inferred"))).alias("storeLabel"), city.alias("effectiveCity"), F.col("href").alias("contextUrl"))


def best_triggers(sources: DataFrame, triggers: DataFrame, most: int = TRIGGERS) -> DataFrame:
    """(site, trigger, text, rank) of the controls of each source that most likely open its list of cities. triggers: (site, seq, text, is_select, visible)."""
    rows = triggers.join(sources.select("site"), "site", "left_semi").withColumn("text", squeeze(F.col("text"))).where("text <> ''")
    scored = rows.withColumn("score", scoring.city_trigger_score(F.col("text"), F.col("is_select"), F.col("visible"))).where("score > 0")
    return ranking.top(scored, ["site"], [F.col("score").desc(), F.col("seq")], most).select("site", F.col("seq").alias("trigger"), "text", "rank")


def chosen_option(sources: DataFrame, opened: DataFrame, options: DataFrame) -> DataFrame:
    """(site, trigger, label, triggerText): what is chosen under the first trigger of each source that offers its city: the first fitting option of a select, else the node with the best score. options: (site, trigger, seq, text, in_select, visible), seen when that trigger was opened."""
    rows = options.join(opened.select("site", "trigger", F.col("text").alias("triggerText"), "rank"), ["site", "trigger"]).join(_named(sources), "site")
    rows = rows.withColumn("text", squeeze(F.col("text"))).withColumn("plain", folded(F.col("text"))).where("text <> ''")
    score = F.when(F.col("in_select"), F.when(F.col("visible") & F.contains("plain", "city"), 1).otherwise(0)).otherwise(scoring.city_option_score(F.col("plain"), F.col("city"), F.col("visible")))
    order = [F.col("rank"), F.col("in_select").desc(), F.col("score").desc(), F.col("seq")]
    best = ranking.keep_first(rows.withColumn("score", score).where("score > 0"), ["site"], order)
    return best.select("site", "trigger", F.col("text").alias("label"), "triggerText")


def trigger(sources: DataFrame, triggers: DataFrame, options: DataFrame, labels: DataFrame) -> DataFrame:
    found = chosen_option(sources, best_triggers(sources, triggers), options)
    rows = sources.join(found, "site", "left").join(_labels(labels, "generic-city-trigger"), "site", "left")
    label = F.when(F.col("trigger").isNotNull(), F.coalesce("inferred", "label", "triggerText"))
    city = F.when(label.isNotNull(), F.coalesce(cities.city_of(label), F.col("requestedCity")))
    return rows.select("site", "requestedCity", label.alias("storeLabel"), city.alias("effectiveCity"), F.lit(None).cast("string").alias("contextUrl"))


def _open(sources: DataFrame, results: DataFrame) -> DataFrame:
    return sources.join(results.where("cityEligible").select("site"), "site", "left_anti")


def contexts(sources: DataFrame, links: DataFrame, triggers: DataFrame, options: DataFrame, labels: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """One result (RESULT without step) of each source (site, requestedCity): its own strategy's, where `own` (site, strategy, storeLabel, effectiveCity, contextUrl) has one, the link directory's, then the triggers': the first that is eligible, else the best. labels: (site, strategy, label) that the page shows once a strategy was applied."""
    with scratch(sources.sparkSession) as keep:
        once = ranking.keep_first(sources.select("site", "requestedCity").where("site is not null"), ["site"], [F.col("requestedCity").asc_nulls_last()])
        asked = F.coalesce(F.trim("requestedCity"), F.lit("")) != ""
        asked_for = keep(once.where(asked), "city-sources")
        nothing = F.lit(None).cast("string")
        free = once.where(~asked).select("site", "requestedCity", nothing.alias("storeLabel"), nothing.alias("effectiveCity"), nothing.alias("contextUrl"))
        results = result(free, "default", 0)
        left = asked_for
        if own is not None:
            first = asked_for.join(ranking.keep_first(own, ["site"], [F.col("strategy")]).withColumnRenamed("strategy", "_own"), "site")
            names = result(first, "own", 0).drop("strategy").join(first.select("site", F.col("_own").alias("strategy")), "site").select(*RESULT)
            done = keep(names, "city-own")
            results, left = results.unionByName(done), _open(left, done)
        by_link = keep(result(directory(left, links, labels), "generic-city-directory", 1), "city-links")
        left = _open(left, by_link)
        by_trigger = result(trigger(left, triggers, options, labels), "generic-city-trigger", 2)
        best = ranking.best_city(results.unionByName(by_link).unionByName(by_trigger), ["site"], "step")
        none = ~F.col("cityEligible") & F.col("effectiveCity").isNull() & F.col("storeLabel").isNull()
        best = best.withColumn("strategy", F.when(none, "city-selection-unavailable").otherwise(F.col("strategy")))
        return keep(best.select(*RESULT[:-1]), "city-contexts", last=True)
