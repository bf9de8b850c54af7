"""The ledger of sources, jobs, batches and logs as DataFrames: summaries, lookups, upserts, schedules, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.functions import text, urls
from gondola.operators import ranking

# What a source gets where its input says nothing.
DEFAULTS = {"scheduleMinutes": 360, "maxSections": 20, "maxPagesPerSection": 8, "maxItemsPerPage": 250, "workerCount": 3, "productsWebhookBatchSize": 10}
JOBS_KEPT, BATCHES_KEPT, ID_LENGTH = 500, 50, 60


def job_summary(jobs: DataFrame) -> DataFrame:
    return jobs.select("id", "sourceId", "sourceLabel", "sourceUrl", "status", "reason", "startedAt", "finishedAt", "error", "adapterId", "output", "metrics", "logPath")


def batch_summary(batches: DataFrame) -> DataFrame:
    return batches.select("id", "label", "status", "reason", "startedAt", "finishedAt", "currentItemIndex", "currentJobId", F.size(F.coalesce("items", F.array())).alias("totalItems"), "error")


def by_id(df: DataFrame, wanted: str) -> DataFrame:
    return df.where(F.col("id") == wanted).limit(1)


def listed(df: DataFrame, order: list[Column], limit: int, **equal) -> DataFrame:
    """Rows whose named columns equal the given values (None: any), the first of the order."""
    for name, value in equal.items():
        df = df if value is None else df.where(F.col(name) == value)
    return df.orderBy(*order).limit(max(limit, 1))


def next_run(enabled: Column, minutes: Column, last_run: Column, last_success: Column, now: Column) -> Column:
    """Null if disabled, now if never run, else the last success (or run) and the schedule."""
    base = F.coalesce(last_success, last_run)
    return F.when(~enabled, None).when(last_run.isNull() | base.isNull(), now).otherwise(base + F.make_dt_interval(mins=minutes))


def with_state(sources: DataFrame, running: DataFrame, now: Column) -> DataFrame:
    """Adds running (whether running holds the id) and nextRunAt."""
    own = running.select(F.col("sourceId").alias("id")).distinct().withColumn("running", F.lit(True))
    out = sources.join(own, "id", "left").withColumn("running", F.coalesce("running", F.lit(False)))
    return out.withColumn("nextRunAt", next_run(F.col("enabled"), F.col("scheduleMinutes"), F.col("lastRunAt"), F.col("lastSuccessAt"), now))


def due(sources: DataFrame, running: DataFrame, now: Column) -> DataFrame:
    """Enabled sources that are not running and whose next run has come."""
    idle = sources.where("enabled").join(running.select(F.col("sourceId").alias("id")), "id", "left_anti")
    at = next_run(F.col("enabled"), F.col("scheduleMinutes"), F.col("lastRunAt"), F.col("lastSuccessAt"), now)
    return idle.withColumn("nextRunAt", at).where(F.col("nextRunAt") <= now)


def latest_catalog(sources: DataFrame, jobs: DataFrame, summaries: DataFrame) -> DataFrame:
    """Each source with its latest job and, where it can be read, that job's summary."""
    own = sources.join(jobs.withColumnRenamed("id", "latestJobId"), "latestJobId")
    return own.join(summaries.withColumnRenamed("jobId", "latestJobId"), "latestJobId", "left")


def patched(base: DataFrame, patch: DataFrame, key: str = "id", clearing: tuple[str, ...] = ()) -> DataFrame:
    """Rows of base with the patch's values where it has any; keys that base lacks change nothing. In the columns that are `clearing` an empty text of the patch makes the value null."""
    new = patch.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in patch.columns if c != key))
    out = base.join(new, key, "left")
    value = lambda c: F.when(F.col(f"_{c}") == "", None).otherwise(F.coalesce(F.col(f"_{c}"), F.col(c))) if c in clearing else F.coalesce(F.col(f"_{c}"), F.col(c))
    return out.select(*(value(c).alias(c) if c != key and c in patch.columns else F.col(c) for c in base.columns))


def upserted(base: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows, and those of base whose key no new row has."""
    return base.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def kept_index(base: DataFrame, new: DataFrame, kept: int = JOBS_KEPT, at: str = "startedAt") -> DataFrame:
    """The index after an upsert: the latest rows, at most so many."""
    return upserted(base, new).orderBy(F.col(at).desc(), "id").limit(kept)


def deleted(base: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def unmatched(base: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """The keys that no row of base has."""
    return keys.select(key).join(base.select(key), key, "left_anti")


def sorted_sources(sources: DataFrame) -> DataFrame:
    """By label as Portuguese sorts it."""
    return sources.orderBy(F.collate("label", "pt"), "id")


def unique_ids(rows: DataFrame, wanted: Column, order: list[Column], existing: DataFrame | None = None) -> DataFrame:
    """Adds id: the wanted one for its first row, then -2, -3 and so on, after those that exist already."""
    out = ranking.numbered(rows.withColumn("_wanted", wanted), ["_wanted"], order).drop("_n")
    n = F.col("_at")
    if existing is not None:
        base = F.regexp_extract("id", r"^(.*?)(?:-(\d+))?$", 1)
        taken = existing.select(F.explode(F.array_distinct(F.array("id", base))).alias("_wanted"), F.greatest(F.coalesce(F.regexp_extract("id", r"-(\d+)$", 1).try_cast("int"), F.lit(1)), F.lit(1)).alias("k"))
        out = out.join(taken.groupBy("_wanted").agg(F.max("k").alias("_taken")), "_wanted", "left")
        n = n + F.coalesce("_taken", F.lit(0))
        out = out.withColumn("_n", n).drop("_taken")
    else:
        out = out.withColumn("_n", n)
    return out.withColumn("id", F.when(F.col("_n") == 1, F.col("_wanted")).otherwise(F.concat("_wanted", F.lit("-"), F.col("_n").cast("string")))).drop("_wanted", "_n", "_at")


def _stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH-mm-ss-SSS'Z'")


def job_id(at: Column, source_id: Column) -> Column:
    return F.concat(_stamp(at), F.lit("-"), text.slug(source_id, 48))


def batch_id(at: Column, label: Column) -> Column:
    return F.concat(_stamp(at), F.lit("-batch-"), text.slug(label, 42))


def normalised_sources(inputs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Inputs (schemas.SOURCE_INPUT) as sources: numbers, flags and defaults; what the input lacks is kept from the existing source of the same id, but for the city, which is then null. An empty webhook URL clears it."""
    url = urls.ensure_scheme(F.col("url"))
    label = F.coalesce(text.clean(F.col("label")), urls.host(url))
    rows = inputs.withColumn("url", url).where("url is not null").withColumn("label", label).withColumn("id", text.slug(F.concat_ws("-", "label", urls.host(F.col("url"))), ID_LENGTH))
    if existing is not None:
        old = existing.select("id", *(F.col(c).alias(f"_{c}") for c in (*DEFAULTS, "enabled", "headless", "adapterHint", "productsWebhookUrl")))
        rows = rows.join(old, "id", "left")
    kept = lambda c, other: F.coalesce(F.col(f"_{c}"), other) if existing is not None else other
    numbers = {c: text.whole_number(F.col(c), 1, kept(c, F.lit(n))) for c, n in DEFAULTS.items()}
    flags = {"enabled": text.truth(F.col("enabled"), kept("enabled", F.lit(True))), "headless": text.truth(F.col("headless"), kept("headless", F.lit(True)))}
    hook = text.squeeze(F.col("productsWebhookUrl"))
    words = {"city": text.clean(F.col("city")), "productsWebhookUrl": text.empty_to_null(F.coalesce(hook, kept("productsWebhookUrl", F.lit(None).cast("string"))))}
    hint = {"adapterHint": F.coalesce(text.clean(F.col("adapterHint")), kept("adapterHint", F.lit("auto")))}
    return rows.select("id", "label", "url", *(c.alias(k) for k, c in {**words, **flags, **numbers, **hint}.items()))


def normalised_batches(inputs: DataFrame) -> DataFrame:
    """Batch inputs as one row for each item: items, or urls one a line, or the single url; the batch's city and adapter where the item has none."""
    lines = F.filter(F.transform(F.split("urls", r"\r?\n"), text.squeeze), lambda u: (u != "") & ~u.startswith("#"))
    item = lambda u: F.struct(F.lit(None).cast("string").alias("label"), u.alias("url"), F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("adapterHint"))
    every = F.when(F.size("items") > 0, F.col("items")).when(F.size(lines) > 0, F.transform(lines, item)).when(text.clean(F.col("url")).isNotNull(), F.array(item(F.col("url"))))
    rows = inputs.select("*", F.posexplode(every).alias("_at", "item"))
    return rows.select(
        F.col("label").alias("batchLabel"), (F.col("_at") + 1).alias("index"), text.clean(F.col("item.label")).alias("label"), urls.ensure_scheme(F.col("item.url")).alias("url"),
        F.coalesce(text.clean(F.col("item.city")), text.clean(F.col("city"))).alias("city"), F.coalesce(text.clean(F.col("item.adapterHint")), text.clean(F.col("adapterHint")), F.lit("auto")).alias("adapterHint"),
    )


def log_page(logs: DataFrame, group: list[str], order: list[Column], after: int = 0, limit: int = 200) -> DataFrame:
    return ranking.page_of(logs, group, order, after, limit)


def artifact_url(path: Column, root: str) -> Column:
    return F.when(path.startswith(root), F.concat(F.lit("/artifacts/"), F.regexp_replace(F.substring(path, len(root) + 1, 1 << 20), "^/+", "")))


def replaced(items: Column, index: Column, new: Column) -> Column:
    return F.transform(items, lambda x, i: F.when(i == index, new).otherwise(x))


def health(sources: DataFrame, running: DataFrame, recent: DataFrame) -> DataFrame:
    """sources, enabled, running and recentJobs (10 at most), in one row."""
    counts = sources.agg(F.count("*").alias("sources"), F.count_if("enabled").alias("enabled"))
    active = running.agg(F.count_distinct("sourceId").alias("running"))
    return counts.crossJoin(active).crossJoin(recent.limit(10).agg(F.count("*").alias("recentJobs")))  # one row each
