"""Prices: parsing, formatting, discounts, and the prices inside a text. Values are doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gondola.functions.text import PRICE, SPACE, clean

_NUMBER = r"^-?(?:\d+(?:\.\d*)?|\.\d+)"


def _leading_number(x: Column) -> Column:
    return F.regexp_extract(x, _NUMBER, 0).try_cast("double")


def _first_comma_to_point(x: Column) -> Column:
    return F.regexp_replace(x, r"^([^,]*),", r"$1.")


def parse_price(x: Column) -> Column:
    """The number in a text: of comma and point the later one is the decimal mark; a lone point is one too. Null if there is none."""
    s = F.regexp_replace(x.cast("string"), SPACE + "+", "")
    no_points, comma_last = F.replace(s, F.lit("."), F.lit("")), F.instr(F.reverse(s), ",") < F.instr(F.reverse(s), ".")
    both = F.contains(s, F.lit(",")) & F.contains(s, F.lit("."))
    mark = F.when(both & ~comma_last, F.replace(s, F.lit(","), F.lit(""))).when(F.contains(s, F.lit(",")), _first_comma_to_point(no_points)).otherwise(s)
    return _leading_number(F.regexp_replace(mark, "[^0-9.-]+", ""))


def parse_shelf_price(x: Column) -> Column:
    """As shops of one chain write it: a point before three digits parts thousands, a comma is the decimal mark, and only prices over 0 count."""
    kept = F.regexp_replace(x.cast("string"), "[^0-9,.-]+", "")
    n = _leading_number(_first_comma_to_point(F.regexp_replace(kept, r"\.(?=\d{3}(?:\D|$))", "")))
    return F.when(n > 0, n)


def first_price(*values: Column) -> Column:
    return F.coalesce(*map(parse_price, values))


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def two_decimals(x: Column) -> Column:
    """Two decimals with a point, halves away from zero on exact ties."""
    tie = (x * 8 == F.floor(x * 8)) & (F.pmod(F.floor(x * 8), F.lit(2)) == 1)
    return F.call_function("format_number", F.when(tie, x + F.signum(x) * 0.001).otherwise(x), F.lit("0.00"))


def format_price(x: Column) -> Column:
    """R$ and two decimals after a comma."""
    return F.concat(F.lit("R$ "), F.replace(two_decimals(x.cast("double")), F.lit("."), F.lit(",")))


def format_price_text(x: Column) -> Column:
    """The price in a text; of texts without a number the first price token or else the squeezed text."""
    return F.coalesce(format_price(parse_price(x)), clean(F.regexp_extract(x, PRICE, 0)), clean(x))


def discount_percent(given: Column, current: Column, original: Column) -> Column:
    """The given discount if it has a number (0 counts), else the one that the prices show."""
    shown = F.when(original > current, round_half_up((original - current) / original * 100))
    return F.coalesce(round_half_up(parse_price(given)), shown)


def prices_in(x: Column) -> Column:
    """All prices in a text, in order."""
    return F.filter(F.transform(F.regexp_extract_all(x, F.lit(PRICE), 0), parse_price), lambda p: p.isNotNull())


def price_state(x: Column, most: int | None = None) -> Column:
    """The lowest price of a text as current, the highest as original if it is higher; nothing for texts of more than so many prices."""


    def state(found: Column) -> Column:
        able = F.size(found) > 0 if most is None else F.size(found).between(1, most)
        current, original = F.array_min(found), F.array_max(found)
        return F.when(able, F.struct(current.alias("current"), F.when(original > current, original).alias("original"), F.size(found).alias("n")))

    # As the element of an array the prices are found once, not once for each use.
    return F.get(F.transform(F.array(prices_in(x)), state), 0)
