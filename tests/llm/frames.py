"""Small tables with the cases that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import DataFrame, SparkSession

LONG = " ".join(f"word{k % 997} of{k % 13} line{k}" for k in range(12_000))
EXTRA = "uid long, bucket int, word string, batch long, size int, score double, digest string, place int, n int, part int, rank int"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
ROWS = [
    (None, None, None, None),
    (None, "a null id has this text of eight words", "en", None),
    (1, "", "en", "a"),
    (1, "", "en", "a"),
    (2, " \n\t ", "fr", "a"),
    (3, "one", None, "b"),
    (4, "Éa ñu 日本 \U0001f600 end", "en", "b"),
    (5, LONG, "en", "hot"),
    (6, LONG, "en", "hot"),
    (7, "the same five words here", "de", "hot"),
    (7, "the same five words here", "de", "hot"),
    (8, "12345 67890 !!!", "en", "c"),
]


def documents(spark: SparkSession, rows=ROWS) -> DataFrame:
    tail = (9, 9, "w", 9, 9, 0.5, "d", 9, 9, 9, 9)
    return spark.createDataFrame([(*r, len(r[1] or ""), *tail) for r in rows], DOCS)


def pages(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "page_id long, url string, html string, frame int, digest string, host string")
