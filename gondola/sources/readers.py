"""Readers. Schemas are given, never inferred; all paths are Spark's."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola import schemas
from gondola.functions import text, urls
from gondola.operators import ranking


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Pretty-printed JSON documents, one or an array of them in each file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def documents_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As documents; without such a path an empty table."""
    try:
        return documents(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def logs(spark: SparkSession, path: str) -> DataFrame:
    """Log lines as JSON; a malformed line fails the read."""
    return spark.read.schema(schemas.LOG).option("mode", "FAILFAST").json(path)


def ledger(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """A ledger table, made empty where there is none."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")
    return spark.table(name)


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGE).parquet(path)


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Captured responses, a JSON object a line; malformed lines are dropped."""
    return spark.read.schema(schemas.CAPTURE).option("mode", "DROPMALFORMED").json(path)


def url_list(lines: DataFrame) -> DataFrame:
    """(seq, url) of lines (seq, value): without blank ones and # comments, each URL once, in order."""
    able = lines.withColumn("value", text.squeeze(F.col("value"))).where("value <> '' and not startswith(value, '#')")
    return ranking.keep_first(able.select("seq", urls.ensure_scheme(F.col("value")).alias("url")), ["url"], [F.col("seq")])


def url_file(spark: SparkSession, path: str) -> DataFrame:
    return url_list(spark.read.text(path).withColumn("seq", F.monotonically_increasing_id()))


def until_empty(pages_: DataFrame, department: str = "department_id", number: str = "page", n: str = "n_items") -> DataFrame:
    """Pages of each department before its first page without items."""
    ends = pages_.where(F.col(n) == 0).groupBy(department).agg(F.min(number).alias("_end"))
    return pages_.join(ends, department, "left").where(F.col("_end").isNull() | (F.col(number) < F.col("_end"))).drop("_end")


def with_profiles(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds the cached profile of each row's domain, null where there is none."""
    return rows.join(profiles, "domain", "left")
