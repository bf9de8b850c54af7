"""Quality rules: a table of thresholds compiled into one projection of length, symbol, stop-word and line ratios.

Every rule is a row of RULES: two counts of the text and the range that their ratio must lie in, in thousandths, so that
all arithmetic is in whole numbers. The table becomes one Spark expression for the first rule that fails and one for
the verdict; new rows need no code unless they need a new count. Built-in functions only, nothing is shuffled.

Defined results:
- null text has no words, as the empty one: every count is 0, both fail the base rule; a ratio over nothing is 0 / 1;
- texts of any length are counted whole; words are compared as they are, stop words in lower case or with a capital;
- repeated rows each get a row; null ids stay null; an empty table gives no rows; extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import WORD_RE

LEAST_WORDS = 50
#: Percent of words in repeated windows beyond which the base rule fails.
MOST_REPEATED = 50
WINDOW = 3
SYMBOL_RE = r"[#*$%&|<>]"
#: Any character beyond ASCII counts as a letter.
LETTER_RE = r"[A-Za-z\x{80}-\x{10FFFF}]"
#: (name, count, count it is a share of, least, most): the ratio in thousandths; None is no bound.
RULES = (
    ("word_length", "word_chars", "n_words", 2000, 15_000),
    ("symbols", "n_symbols", "n_words", None, 150),
    ("letters", "n_letterless", "n_words", None, 300),
    ("stop_words", "n_stop_words", "n_words", 20, None),
    ("same_lines", "n_dup_lines", "n_lines", None, 500),
    ("bullet_lines", "n_bullets", "n_lines", None, 900),
    ("open_lines", "n_ellipses", "n_lines", None, 300),
)
#: Frequent words of the languages.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with", "on", "by", "at", "are", "this", "be",
    "le", "la", "les", "et", "des", "du", "un", "une", "que", "qui", "dans", "pour", "est", "pas", "avec", "elle",
    "der", "die", "das", "und", "ein", "eine", "nicht", "ist", "den", "dem", "zu", "von", "mit", "auf", "sich", "auch",
    "el", "los", "las", "y", "en", "una", "por", "con", "para", "se", "del", "como", "su", "al",
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and every count that RULES name, of docs (doc_id, text)."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"], text.alias("text"))
    rows = rows.select("doc_id", "text", F.regexp_extract_all("text", F.lit(WORD_RE), F.lit(0)).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD_RE)).alias("lines"))
    rows = rows.withColumn("n_words", F.size("words").cast("long")).withColumn("n_lines", F.size("lines").cast("long"))
    at = lambda i: F.get("words", i)
    # A window can only be repeated where its hash is. Most texts repeat none, and are done; of the others, places in order
    # of their hashes have equal ones as neighbours. Those few windows are compared as they are.
    hashed = F.transform(F.slice("words", 1, F.greatest(F.col("n_words").cast("int") - WINDOW + 1, F.lit(0))), lambda w, i: F.xxhash64(w, *(at(i + k) for k in range(1, WINDOW))))
    rows = rows.withColumn("hashes", hashed)
    none = F.lit(None).cast("array<struct<hash:bigint,at:int>>")
    placed = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
    rows = rows.withColumn("hashes", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), placed).otherwise(none))
    near = lambda c, key: lambda x, i: (x[key] == F.get(c, i - 1)[key]) | (x[key] == F.get(c, i + 1)[key])
    windows = F.transform(F.filter("hashes", near("hashes", "hash")), lambda x: F.struct(F.concat_ws(" ", *(at(x["at"] + k) for k in range(WINDOW))).alias("window"), x["at"].alias("at")))
    rows = rows.withColumn("windows", F.sort_array(windows))
    rows = rows.withColumn("places", F.sort_array(F.transform(F.filter("windows", near("windows", "window")), lambda x: x["at"])))
    cover = F.transform("places", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("places", i + 1) - p, F.lit(WINDOW))))
    return rows.select(
        "doc_id",
        "n_words",
        total(F.transform("words", lambda w: F.char_length(w))).alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL_RE)).cast("long").alias("n_symbols"),
        (F.col("n_lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(total(cover), F.lit(0)).alias("n_repeat_words"),
        "n_lines",
        F.size(F.filter("words", lambda w: ~w.rlike(LETTER_RE))).cast("long").alias("n_letterless"),
        F.size(F.filter("words", lambda w: w.isin(*STOP_WORDS, *map(str.capitalize, STOP_WORDS)))).cast("long").alias("n_stop_words"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09]*([-*]|\x{2022})[\x20\x09]"))).cast("long").alias("n_bullets"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|\x{2026})[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipses"),
    )


def fails(rule: tuple) -> Column:
    _, count, of, least, most = rule
    share, whole = F.col(count) * 1000, F.greatest(F.col(of), F.lit(1))
    bounds = [share < whole * least] if least is not None else []
    bounds += [share > whole * most] if most is not None else []
    return bounds[0] if len(bounds) == 1 else bounds[0] | bounds[1]


def judged(docs: DataFrame, rules=RULES, least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept, failed (the first rule that fails, else null) of each row of docs (doc_id, text)."""
    base = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated)
    failed = F.coalesce(F.when(base, F.lit("base")), *(F.when(fails(r), F.lit(r[0])) for r in rules), F.lit(None).cast("string"))
    return counted(docs).select("doc_id", *COUNTS, base.alias("base_failed"), failed.alias("failed")).withColumn("kept", F.col("failed").isNull())


_SHARES = " ".join(
    f"WHEN {' OR '.join(([f'{count} * 1000 < greatest({of}, 1) * {least}'] if least is not None else []) + ([f'{count} * 1000 > greatest({of}, 1) * {most}'] if most is not None else []))} THEN '{name}'"
    for name, count, of, least, most in RULES
)
_STOP = ", ".join(f"'{w}'" for x in STOP_WORDS for w in (x, x.capitalize()))
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, doc_id, text, regexp_extract_all(text, '{WORD_RE}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD_RE}')) AS lines FROM d),
g AS (SELECT row, i, words[i : i + {WINDOW - 1}] AS g FROM (SELECT row, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
t AS (SELECT DISTINCT row, unnest(range(i, i + {WINDOW})) AS at FROM (SELECT row, i FROM g QUALIFY count(*) OVER (PARTITION BY row, g) > 1)),
r AS (SELECT row, count(*) AS n_repeat_words FROM t GROUP BY row),
c AS (SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '{SYMBOL_RE}')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
             len(list_filter(words, lambda x: NOT regexp_matches(x, '{LETTER_RE}'))) AS n_letterless, len(list_filter(words, lambda x: x IN ({_STOP}))) AS n_stop_words,
             len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*([-*]|\x{{2022}})[\x20\x09]'))) AS n_bullets, len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09-\x0D]*$'))) AS n_ellipses
      FROM w LEFT JOIN r USING (row)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR n_repeat_words * 100 > n_words * {MOST_REPEATED} AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CASE WHEN base_failed THEN 'base' {_SHARES} END AS failed, failed IS NULL AS kept FROM f
"""
