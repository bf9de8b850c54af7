"""Badge lists and the labels that come of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gondola.functions.text import EDGE_AFTER, EDGE_BEFORE, PRICE, clean, either, squeeze

# Words of promotions, clubs and limits.
THEMES = ("festival", "sexta", "carne", "super barato", "exclusiv", "clube", "real", "páscoa", "pascoa", "site")
SECTION_THEMES = ("festival", "sexta", "carne", "super barato", "clube", "promo", "oferta", "páscoa", "pascoa")
GENERIC = r"(?iu)^oferta$|^promo(?:c|ç)ão$|^promo(?:c|ç)oes$|^clube$"
LIMITS = ("cpf", "cliente", "limite", "máx", "max")
CLUB = f"(?iu){EDGE_BEFORE}clube?{EDGE_AFTER}"
EXCLUSIVE = either("exclusiv", "site")
MOST = 8


def _each_once(values: Column, able: Callable[[Column], Column]) -> Column:
    """First spellings of the able squeezed values that differ in more than case, at most MOST. Once those are found, the rest is passed over unread."""

    def add(found: Column, value: Column) -> Column:
        known = lambda b: F.exists(found, lambda x: F.lower(x) == F.lower(b))
        new = F.filter(F.transform(F.array(value), squeeze), lambda b: able(b) & ~known(b))
        return F.when(F.size(found) >= MOST, found).otherwise(F.concat(found, new))

    none = F.array().cast("array<string>")
    return F.coalesce(F.aggregate(values, none, add), none)


def badge_list(values: Column) -> Column:
    """Squeezed badges of 2 to 80 characters without prices, each once whatever its case, at most 8."""
    return _each_once(values, lambda b: F.length(b).between(2, 80) & ~b.rlike(PRICE))


def product_badges(values: Column) -> Column:
    """As badge_list, but prices and single characters stay."""
    return _each_once(values, lambda b: F.length(b).between(1, 80))


def first_like(badges: Column, pattern: str) -> Column:
    return F.get(F.filter(badges, lambda b: b.rlike(pattern)), 0)


def campaign_label(promotion: Column, badges: Column) -> Column:
    """The first themed label, else the first that isn't generic, else the promotion's."""
    every = F.filter(F.concat(F.array(clean(promotion)), F.transform(badges, clean)), lambda b: b.isNotNull())
    other = F.get(F.filter(every, lambda b: ~b.rlike(GENERIC)), 0)
    return F.coalesce(first_like(every, either(*THEMES)), other, clean(promotion))


def product_campaign(direct: Column, section_label: Column, badges: Column) -> Column:
    """The direct label unless it just says oferta, else a themed badge, a themed section, or the direct label after all."""
    own = clean(direct)
    themed = F.when(section_label.rlike(either(*SECTION_THEMES)), section_label)
    return F.coalesce(F.when(~own.rlike("(?iu)^oferta$"), own), first_like(badges, either(*THEMES)), themed, own)


def promotion_from_badges(badges: Column) -> Column:
    return F.coalesce(first_like(badges, either(*THEMES)), first_like(badges, either("oferta", "promo", "desconto")))


def limit_text(x: Column) -> Column:
    own = clean(x)
    return F.when(own.rlike(either(*LIMITS)), own)


def club_offer(badges: Column) -> Column:
    return F.coalesce(F.exists(badges, lambda b: b.rlike(CLUB)), F.lit(False))


def site_exclusive(badges: Column) -> Column:
    return F.coalesce(F.exists(badges, lambda b: b.rlike(EXCLUSIVE)), F.lit(False))
