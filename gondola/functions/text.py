"""Text functions. White space is the web's: no-break space and the other Unicode spaces count."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import wraps

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s   -     　﻿]"
NOT_SPACE = "[^" + SPACE[1:]
PRICE = r"(?i)R\$" + SPACE + r"*\d[\d.,]*"
#: A word edge as browsers see it: only ASCII letters, digits and _ are word characters.
EDGE_BEFORE, EDGE_AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def arrow_function(kind: str) -> Callable:
    """A column function of a function of pandas series; made when it is first used, since types need a session."""

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def call(*columns) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        return call

    return wrap


def either(*words: str) -> str:
    """A case-insensitive pattern of any of the words, accented letters included."""
    return f"(?iu)(?:{'|'.join(words)})"


def empty_to_null(x: Column) -> Column:
    return F.when(x != "", x)


def squeeze(x: Column) -> Column:
    """White space runs as one blank, none at the ends. A lone blank is left where it is: most are."""
    # Most characters are no space, which one range tells sooner than the list of all spaces.
    return F.trim(F.regexp_replace(x, f"(?![!-~])(?:{SPACE}{{2,}}|(?! ){SPACE})", " "))


def clean(x: Column) -> Column:
    """Squeezed text; null if nothing is left."""
    return empty_to_null(squeeze(x))


def product_text(x: Column) -> Column:
    """Squeezed text without price tokens; blanks that stood around a token stay."""
    return empty_to_null(F.trim(F.regexp_replace(squeeze(x), PRICE, "")))


def fold(text: str | None) -> str | None:
    """Without accents (combining marks U+0300 to U+036F), lower case, trimmed."""
    if text is None:
        return None
    return "".join(c for c in unicodedata.normalize("NFD", text) if not "̀" <= c <= "ͯ").lower().strip()


@arrow_function("string")
def folded(x: pd.Series) -> pd.Series:
    """Text for comparisons. Spark has no function that takes accents off, hence Arrow batches."""
    return x.map(fold, na_action="ignore")


def title_case(x: Column) -> Column:
    return F.initcap(squeeze(x))


def slug(x: Column, cap: int | None = 80) -> Column:
    """Without a lower-case scheme, runs of other than ASCII letters and digits as one dash, lower case."""
    bare = F.regexp_replace(F.regexp_replace(x, "^https?://", ""), "[^a-zA-Z0-9]+", "-")
    out = F.lower(F.regexp_replace(bare, "^-+|-+$", ""))
    return F.substring(out, 1, cap) if cap else out


def folded_slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(folded(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def lines(x: Column) -> Column:
    """Squeezed lines that have text, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(x, r"\n+"), squeeze), lambda line: line != ""))


def first_line(x: Column) -> Column:
    return F.get(F.filter(F.transform(F.split(x, r"\n+"), squeeze), lambda line: line != ""), 0)


def whole_number(x: Column, least: int, fallback) -> Column:
    """The whole number that the text begins with, if it is at least so large."""
    n = F.regexp_extract(F.coalesce(x.cast("string"), F.lit("")), rf"^{SPACE}*([+-]?\d+)", 1).try_cast("int")
    return F.when(n >= least, n).otherwise(F.lit(fallback) if not isinstance(fallback, Column) else fallback)


def truth(x: Column, fallback) -> Column:
    """true, 1, yes, on and false, 0, no, off as booleans; else the fallback."""
    word = F.lower(F.trim(x.cast("string")))
    other = fallback if isinstance(fallback, Column) else F.lit(fallback).cast("boolean")
    return F.when(word.isin("true", "1", "yes", "on"), True).when(word.isin("false", "0", "no", "off"), False).otherwise(other)
