"""Summaries of catalogues and batches, and flat rows for exports and webhooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.operators import cities, ranking


def batch_totals(items: DataFrame) -> DataFrame:
    """(batchId, totalItems, completedItems, failedItems, totalProducts) of items (batchId, status, products)."""
    return items.groupBy("batchId").agg(
        F.count("*").alias("totalItems"), F.count_if(F.col("status") == "completed").alias("completedItems"), F.count_if(F.col("status") == "failed").alias("failedItems"), F.sum(F.coalesce("products", F.lit(0))).alias("totalProducts")
    )


def section_totals(products: DataFrame) -> DataFrame:
    """Pages and products of each section."""
    return products.groupBy("sectionId", "sectionLabel", "sectionUrl").agg(F.count_distinct("pageUrl").alias("totalPages"), F.count("*").alias("totalProducts"))


def catalog_totals(products: DataFrame) -> DataFrame:
    return products.agg(F.count_distinct("sectionId").alias("totalSections"), F.count_distinct("pageUrl").alias("totalPages"), F.count("*").alias("totalProducts"), F.count_if("isPromotion").alias("promotions"))


def shelf_totals(products: DataFrame, departments: DataFrame, stores: DataFrame) -> DataFrame:
    """One row: the store (source, requestedCity, effectiveCity, storeLabel; one row) with its city coverage, and how many products were scraped of each of its departments (place, departmentId, departmentLabel, departmentUrl, totalProducts, totalPages), in order."""
    scraped = products.groupBy(F.col("department_id").alias("departmentId")).agg(F.count("*").alias("scrapedProducts"))
    own = ["departmentId", "departmentLabel", "departmentUrl", "totalProducts", "totalPages", "scrapedProducts"]
    rows = departments.join(scraped, "departmentId", "left").fillna(0, ["scrapedProducts"]).select("place", F.struct(*own).alias("d"))
    listed = rows.agg(F.count("*").alias("totalDepartments"), F.transform(F.sort_array(F.collect_list(F.struct("place", "d"))), lambda x: x["d"]).alias("departments"))  # one store's
    total = products.agg(F.count("*").alias("totalProducts"))
    city = [cities.coverage(F.col("requestedCity"), F.col("effectiveCity")).alias("cityCoverage"), cities.eligible(F.col("requestedCity"), F.col("effectiveCity")).alias("cityEligible")]
    return stores.select("source", "requestedCity", "effectiveCity", "storeLabel", *city).join(total).join(listed).select("source", "requestedCity", "effectiveCity", "storeLabel", "cityCoverage", "cityEligible", "totalDepartments", "totalProducts", "departments")


def flat_catalogs(catalogs: DataFrame) -> DataFrame:
    """A row for each product of each catalogue, numbered from 1; where both name a column the product's value stays."""
    rows = catalogs.select("*", F.posexplode("products").alias("_at", "product")).drop("products")
    product = rows.select("product.*").columns
    own = [c for c in rows.columns if c not in ("_at", "product") and c not in product]
    return rows.select(*own, (F.col("_at") + 1).alias("itemIndex"), "product.*")


def webhook_rows(products: DataFrame, context: DataFrame, group: list[str], order: list[Column], size: int = 10) -> DataFrame:
    """(group, batchIndex, body) of each batch of products: body is a JSON array of flat objects, one for each product in order, each with the envelope's fields, of which the product's own win. context: the envelope, one row for each group."""
    counts = products.groupBy(*group).agg(F.count("*").alias("totalProducts"))
    own = [c for c in products.columns if c not in group]
    places = ["totalProducts", "batchIndex", "totalBatches", "batchSize", "itemIndexInBatch"]
    outer = [*context.columns, *places]
    placed = products.select(*group, F.struct(*own).alias("_product"), *(c.alias(f"_order{k}") for k, c in enumerate(order)))
    rows = ranking.in_chunks(placed, group, [F.col(f"_order{k}") for k in range(len(order))], size).join(context, group).join(counts, group)
    item = F.struct("itemIndexInBatch", F.struct(*[F.col(c) for c in outer if c not in own], *[F.col("_product")[c].alias(c) for c in own]).alias("item"))
    listed = F.transform(F.sort_array(F.collect_list(item)), lambda x: x["item"])
    return rows.groupBy(*group, "batchIndex").agg(F.to_json(listed, {"ignoreNullFields": "false"}).alias("body"))


def log_view(products: DataFrame, badges: int = 6) -> DataFrame:
    """What logs show of products."""
    return products.select("name", "price", "originalPrice", "promotionLabel", "campaignLabel", F.slice("badges", 1, badges).alias("badges"), "limitText", "link")
