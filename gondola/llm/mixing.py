"""Mixing sources to target weights: capped water-filling of word budgets, then seeded whole and fractional repetitions.

DataFrame functions only. Defined results:
- null, empty or all-space text: size 0, nothing is taken; null source: a source of its own, last in order;
- an empty table gives no rows; if no word exists every target is 0;
- repeated rows count each for itself; ties of the seeded order are broken by the size, then by a number of the row, and rows
  equal in id and size are alike; texts of any length are counted whole;
- extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.llm.common import WORD_RE, saved, scratch

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 17
#: Hex digits of the seeded order by which its end is looked for at a time: 4096 buckets of each source.
DIGITS = 3
#: Rows of an ending bucket that are summed one by one.
LAST_ROWS = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds `target` to (source_size, weight, ...) rows.

    Sources that the common level would lift above max_epochs times their size are clamped there and the rest of the
    budget is shared again by weight, until no more are clamped. Each round is one aggregate of one row; the level only
    rises, so the rounds end. Sizes and weights are whole numbers, so their sums do not depend on order.
    """
    cap = F.col("source_size") * max_epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        over = cap <= F.col("weight") * F.lit(level)
        n, capped, open_weight = sources.agg(F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == clamped or not open_weight:
            break
        level, clamped = (share * total - (capped or 0)) / open_weight, n
    reach = F.col("weight") * F.lit(level)
    return sources.withColumn("target", F.when(F.lit(not open_weight), cap.cast("double")).otherwise(F.least(cap.cast("double"), reach)))


def in_order(sources: DataFrame) -> DataFrame:
    """Adds `rank`, counting from 0 by code point, null last: places within ranges of sources, and the sizes of the ranges before."""
    order = F.asc_nulls_last("source")
    ranged = saved(sources.repartitionByRange(order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each range
    return ranged.join(before, "range").withColumn("rank", F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1 + F.col("before")).drop("range", "before")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, digits: int = DIGITS, last_rows: int = LAST_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs (doc_id, text, source).

    A source whose target is r times its size takes all its documents floor(r) times, and in one more pass documents in
    seeded order until the rest of the target is used; the last of them is taken in part. The order is the MD5 of the
    seed and id, then the size, then a number of the row. Where the pass ends is found by sums over buckets of the order's
    next digits, again within the ending bucket until no source's has more than last_rows rows: only those are summed row
    by row. All other rows are before or after it.
    """
    with scratch(docs.sparkSession):
        order = F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
        sized = saved(docs.select("doc_id", docs["source"].cast("string").alias("source"), words(docs["text"]).alias("size"), order.alias("hash"), F.monotonically_increasing_id().alias("row")), "mix-sizes", keep=True)
        sized = sized.withColumn("place", F.concat("hash", F.lpad(F.hex("size"), 16, "0"), F.md5(F.col("row").cast("string").cast("binary"))))
        by_source = in_order(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
        ranked = saved(by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))), "mix-sources")
        level = targets(ranked, share, max_epochs)
        level = level.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        level = level.withColumn("quota", F.floor("target") - F.col("whole") * F.col("source_size"))
        # last: the digits of the ending bucket so far; start: words before it; a source whose quota is 0 ends before its first row.
        plan = saved(level.select("source", "source_size", "target", "whole", "quota", F.lit("").alias("last"), F.lit(0).cast("long").alias("start")), "mix-plan")
        known, rows = 0, None
        same = F.col("d.source").eqNullSafe(F.col("p.source"))
        while (rows is None or rows > last_rows) and known < 80:
            known += digits
            within = sized.alias("d").join(plan.where("quota > 0").alias("p"), same & F.col("d.place").startswith(F.col("p.last")))
            sums = within.groupBy("d.source", F.substring("d.place", 1, known).alias("bucket")).agg(F.sum("d.size").alias("words"), F.count("*").alias("n"), F.first("p.start").alias("from"), F.first("p.quota").alias("quota"))
            before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("from")  # at most 16 ** digits rows of each source
            ends = saved(sums.withColumn("start", before).where("start < quota and quota <= start + words").select("source", F.col("bucket").alias("last"), "start", "n"), "mix-ends")
            rows = ends.agg(F.max("n")).first()[0] or 0
            plan = plan.drop("last", "start").alias("p").join(ends.alias("d"), same, "left").select("p.*", F.coalesce("d.last", F.lit("")).alias("last"), F.coalesce("d.start", F.lit(0)).alias("start"))
            plan = saved(plan, "mix-plan")
        plan = saved(plan, "mix-plan", keep=True)
    every = sized.alias("d").join(plan.alias("p"), same)
    every = every.select("d.*", *(f"p.{c}" for c in ("source_size", "target", "whole", "quota", "last", "start"))).withColumn("bucket", F.substring("place", 1, known))
    out = ["doc_id", "size", "source_size", "target", "taken"]
    settled = every.where("bucket <> last").withColumn("taken", F.col("size") * (F.col("whole") + F.when(F.col("bucket") < F.col("last"), 1).otherwise(0)))
    run = F.sum("size").over(Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    left = F.greatest(F.lit(0), F.least("size", F.col("quota") - F.col("start") - run))
    ending = every.where("bucket = last").withColumn("taken", F.col("size") * F.col("whole") + left)
    return settled.select(out).unionByName(ending.select(out))


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD_RE}')) AS size,
                  md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}') AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
o AS (SELECT *, sum(source_size) OVER () * 1.5 AS budget,
             coalesce(sum(2 * source_size) OVER w, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open_weight
      FROM s WINDOW w AS (ORDER BY 2 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((budget - capped) / open_weight) AS level FROM o),
t AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, weight * level) AS target FROM s, l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT doc_id, size, source_size, target, whole, floor(target)::BIGINT - whole * source_size AS quota,
             sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS run
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * whole + greatest(0, least(size, quota - run)))::BIGINT AS taken FROM r
"""
