"""Keep-the-best operators: duplicates, best of each group, top lists, chunks and pages of rows.

Sorts in Spark are not stable, so every order ends in a sequence column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.functions.text import clean
from gondola.shared import written

# What each field of a product adds to its richness.
RICHNESS = {"image": 3, "link": 3, "originalPrice": 2, "discountPercent": 2, "promotionLabel": 2, "limitText": 2, "unit": 1}
FLAGS = {"isClubOffer": 1, "isSiteExclusive": 1}
#: Rows of a group that one task may number.
HOT_ROWS = 1_000_000


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order; null keys are equal. Spark keeps one row a key in each task before the shuffle."""
    rank = "_rank"
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) == 1).drop(rank)


def top(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def joined_key(*parts: Column) -> Column:
    """The parts that aren't empty, joined by a bar; null if none is left."""
    return F.nullif(F.concat_ws("|", *(F.nullif(p.cast("string"), F.lit("")) for p in parts)), F.lit(""))


def product_key() -> Column:
    return joined_key(F.col("id"), F.col("link"), F.lower("name"), F.col("price"))


def richness(campaign: int) -> Column:
    """The weights of the fields that a product has, and one for each badge."""
    score = F.coalesce(F.size("badges"), F.lit(0))
    for name, weight in {**RICHNESS, "campaignLabel": campaign}.items():
        score = score + F.when(F.coalesce(F.col(name).cast("string"), F.lit("")) != "", weight).otherwise(0)
    for name, weight in FLAGS.items():
        score = score + F.when(F.col(name), weight).otherwise(0)
    return score


def best_state(rows: DataFrame, keys: list[str], order: Column, seq: str = "seq") -> DataFrame:
    """A row for each key: `best` (the row whose order, a struct, is smallest), that `order`, and `first`, the smallest seq. Null keys are equal. One aggregate: each task keeps a row a key before the shuffle, so no task holds a hot key. States of parts of the rows, such as those of each day, are put together by merged_state."""
    ordered = rows.withColumn("__order", order)
    kept = [F.col(c) for c in rows.columns if c not in keys]
    return ordered.groupBy(*keys).agg(F.min_by(F.struct(*kept), "__order").alias("best"), F.min("__order").alias("order"), F.min(seq).alias("first"))


def merged_state(state: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The state of the rows of both."""
    both = state.unionByName(new)
    return both.groupBy(*keys).agg(F.min_by("best", "order").alias("best"), F.min("order").alias("order"), F.min("first").alias("first"))


def of_state(state: DataFrame, columns: list[str]) -> DataFrame:
    """The best rows of a state, with these of their columns."""
    inner = state.schema["best"].dataType.names
    return state.select(*(F.col("best")[c].alias(c) if c in inner else F.col(c) for c in columns))


def extracted_state(items: DataFrame, group: list[str], seq: str = "seq") -> DataFrame:
    """State of the richest item of each key (__key), the first among equals."""
    return best_state(items.withColumn("__key", product_key()), [*group, "__key"], F.struct((-richness(2)).alias("poor"), F.col(seq).alias("seq")), seq)


def distinct_extracted(items: DataFrame, group: list[str], seq: str = "seq") -> DataFrame:
    """Extracted items: the richest of each key, the first among equals; `seq` becomes that of the key's first row."""
    state = extracted_state(items, group, seq)
    return of_state(state.withColumn("best", F.col("best").withField(seq, F.col("first"))), items.columns)


def products_state(products: DataFrame, seq: str = "seq") -> DataFrame:
    """State of the richest catalogue product of each key (__key), then the cheapest, then by link."""
    link = F.collate(F.coalesce("link", F.lit("")), "pt")
    order = F.struct((-richness(3)).alias("poor"), F.col("priceValue").isNull().alias("free"), F.col("priceValue").alias("price"), link.alias("link"), F.col(seq).alias("seq"))
    return best_state(products.withColumn("__key", product_key()), ["__key"], order, seq)


def shown(products: DataFrame, seq: str = "seq") -> DataFrame:
    """By section and name, as Portuguese sorts them."""
    return products.orderBy(F.collate(F.coalesce("sectionLabel", F.lit("")), "pt"), F.collate("name", "pt"), seq)


def distinct_products(products: DataFrame, seq: str = "seq") -> DataFrame:
    """Catalogue products: the richest of each key, then the cheapest, then by link; shown by section and name."""
    return shown(of_state(products_state(products, seq), products.columns), seq)


def distinct_shelf(products: DataFrame, slug: Column, seq: str = "seq") -> DataFrame:
    """Shelf products: by product id, else by department and slug of the name; the lowest page, then the cheapest."""
    key = F.coalesce(clean(F.col("product_id")), F.concat_ws(":", "department_id", slug))
    best = keep_first(products.withColumn("_key", key), ["_key"], [F.col("page").asc_nulls_last(), F.col("price_value").asc_nulls_last(), F.col(seq)])
    return best.drop("_key").orderBy(F.collate(F.coalesce("department_label", F.lit("")), "pt"), F.collate("name", "pt"), seq)


def fingerprints(items: DataFrame, page: list[str], seq: str = "seq", n: int = 20) -> DataFrame:
    """One fingerprint of each page: id, name and price of its first n items."""
    first = top(items, page, [F.col(seq)], n)
    mark = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("id", "name", "price")))
    listed = F.sort_array(F.collect_list(F.struct("rank", mark.alias("mark"))))  # n rows at most
    return first.groupBy(*page).agg(F.array_join(F.transform(listed, lambda x: x["mark"]), "|").alias("fingerprint"))


def first_pages(pages: DataFrame, group: list[str], seq: str = "seq") -> DataFrame:
    """Pages whose fingerprint no earlier page of the group has; pages without items share the empty one."""
    return keep_first(pages.fillna("", ["fingerprint"]), [*group, "fingerprint"], [F.col(seq)])


def chosen_strategy(dom: Column, network: Column) -> Column:
    """network only if it found strictly more, none if neither found anything."""
    return F.when((dom == 0) & (network == 0), "none").when(network > dom, "network").otherwise("dom")


def best_candidate(candidates: DataFrame, group: list[str], seq: str = "seq") -> DataFrame:
    """The candidate with most items, network before others, then the first."""
    return keep_first(candidates, group, [F.col("n_items").desc(), (F.col("strategy") == "network").desc(), F.col(seq)])


def best_city(results: DataFrame, group: list[str], seq: str = "seq") -> DataFrame:
    """An eligible result first, then one with a city, then the earliest."""
    return keep_first(results, group, [F.col("cityEligible").desc(), F.col("effectiveCity").isNotNull().desc(), F.col(seq)])


def _numbered_in_ranges(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """As numbered(), for groups of any size: rows are dealt in sorted ranges, numbered within those, and what the ranges before hold of the group is added."""
    ranged = written(rows.repartitionByRange(*(F.col(g) for g in group), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(*group)
    before = F.sum("_size").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = ranged.groupBy(*group, "_range").agg(F.count("*").alias("_size"))  # hot groups alone: few rows
    sizes = sizes.select(*(F.col(g).alias(f"_group{k}") for k, g in enumerate(group)), F.col("_range").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(own).alias("_n"))
    same = ranged["_range"] == sizes["_of"]
    for k, g in enumerate(group):
        same = same & ranged[g].eqNullSafe(sizes[f"_group{k}"])
    at = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order))
    return ranged.withColumn("_at", at).join(sizes, same).select(*rows.columns, (F.col("_at") + F.col("_before")).alias("_at"), "_n")


def numbered(rows: DataFrame, group: list[str], order: list[Column], hot: int = HOT_ROWS) -> DataFrame:
    """Adds _at, each row's place in its group from 1, and _n, the group's size. Groups of more than `hot` rows are numbered in ranges, so that no task holds one; the numbers are the same."""
    own = Window.partitionBy(*group)
    plain = lambda df: df.withColumn("_at", F.row_number().over(own.orderBy(*order)).cast("long")).withColumn("_n", F.count("*").over(own))
    large = rows.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > hot)
    if large.isEmpty():
        return plain(rows)
    large = written(large.select(*(F.col(g).alias(f"_group{k}") for k, g in enumerate(group))), "hot-groups")
    same = F.lit(True)
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_group{k}"))
    return plain(rows.join(large, same, "left_anti")).unionByName(_numbered_in_ranges(rows.join(large, same, "left_semi"), group, order))


def in_chunks(rows: DataFrame, group: list[str], order: list[Column], size: int) -> DataFrame:
    """Adds itemIndex, batchIndex, totalBatches, batchSize and itemIndexInBatch, all from 1, to the rows of each group."""
    out = numbered(rows, group, order).withColumn("itemIndex", F.col("_at").cast("int")).drop("_at")
    out = out.withColumn("batchIndex", (F.floor((F.col("itemIndex") - 1) / size) + 1).cast("int")).withColumn("totalBatches", F.ceil(F.col("_n") / size).cast("int"))
    left = F.col("_n") - (F.col("batchIndex") - 1) * size
    return out.withColumn("batchSize", F.least(F.lit(size), left).cast("int")).withColumn("itemIndexInBatch", ((F.col("itemIndex") - 1) % size + 1).cast("int")).drop("_n")


def page_of(rows: DataFrame, group: list[str], order: list[Column], after: int, limit: int) -> DataFrame:
    """Lines after+1 to after+limit of each group, with line, total and nextAfter. Each task keeps no more than the first after+limit lines of a group before the shuffle; totals are counted apart."""
    most = after + max(limit, 1)
    totals = rows.groupBy(*group).agg(F.count("*").alias("total"))
    out = top(rows, group, order, most).where(F.col("rank") > after).withColumnRenamed("rank", "line").join(totals, group)
    return out.withColumn("nextAfter", F.least(F.col("total"), F.lit(most)).cast("int"))


def in_priority(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of frames, each key from the first frame that has it; adds `priority`."""
    out = None
    for k, df in enumerate(frames):
        df = df.withColumn("priority", F.lit(k))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return keep_first(out, keys, [F.col("priority")])
