"""Cities of shops: names out of labels, coverage, and the best of several results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.functions.text import empty_to_null, folded, squeeze, title_case
from gondola.operators import ranking

# How labels give a city, in order.
LABELS = (r"-\s*([^(,]+?)(?:\s*\(|,|$)", r"(?iu)retirar na loja:\s*([^,]+?)(?:,|$)", r"(?iu)loja de\s*([^\n]+?)\s*(?:retirada|$)", r"(?iu)cidade[:\s]+([^\n]+?)$")
TO_BRACKET = r"-\s*([^(]+?)(?:\s*\(|$)"
CONFIRMS = r"(?i)confirmar|continuar|aplicar|salvar|fechar|ok|escolher|selecionar|alterar|prosseguir"
FIRST_WORD = r"-\s*([\p{L}]+)"


def _found(label: Column, pattern: str) -> Column:
    return empty_to_null(F.trim(F.regexp_extract(squeeze(label), pattern, 1)))


def city_of(label: Column) -> Column:
    """The city that a label names, title case; null if none."""
    return F.coalesce(*(title_case(_found(label, p)) for p in LABELS))


def city_to_bracket(label: Column) -> Column:
    return title_case(_found(label, TO_BRACKET))


def city_first_word(label: Column) -> Column:
    """The first word after the dash."""
    return _found(label, FIRST_WORD)


def coverage(requested: Column, effective: Column) -> Column:
    """default, unknown, match or mismatch; accents and case don't matter."""
    none = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    return F.when(none(requested), "default").when(none(effective), "unknown").when(folded(requested) == folded(effective), "match").otherwise("mismatch")


def eligible(requested: Column, effective: Column) -> Column:
    return coverage(requested, effective) != "mismatch"


def confirm_button(buttons: DataFrame, group: list[str]) -> DataFrame:
    """The button (text, seq) of each group that confirms a choice: the one with the shortest text, the first among equals."""
    able = buttons.withColumn("text", squeeze(F.col("text"))).where(F.col("text").rlike(CONFIRMS))
    return ranking.keep_first(able, group, [F.length("text"), F.col("seq")])


def site_context(results: DataFrame) -> DataFrame:
    """Adds cityCoverage, cityEligible and inferred; without a city in the label the requested one is taken."""
    out = results.withColumn("inferred", F.col("labelCity").isNull()).withColumn("effectiveCity", F.coalesce("labelCity", "requestedCity"))
    return out.withColumn("cityCoverage", coverage(F.col("requestedCity"), F.col("effectiveCity"))).withColumn("cityEligible", F.col("cityCoverage") != "mismatch")


def label_lines(pages: DataFrame, text: str, prefixes: list[str]) -> DataFrame:
    """Lines that begin with one of the prefixes, each with the line after it."""
    rows = pages.select("page_id", F.posexplode(F.split(text, r"\r?\n")).alias("seq", "line")).withColumn("line", squeeze(F.col("line"))).where("line <> ''")
    after = rows.withColumn("next_line", F.lead("line").over(Window.partitionBy("page_id").orderBy("seq")))
    able = F.lit(False)
    for p in prefixes:
        able = able | F.lower("line").startswith(p)
    return after.where(able).select("page_id", "seq", F.concat_ws(" ", "line", "next_line").alias("label"))
