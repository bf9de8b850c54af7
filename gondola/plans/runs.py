"""Runs of sources as ledger rows: what starting and finishing a job writes, for any number of sources at once."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.operators import ledger
from gondola.sources.stored import Stored

#: The latest claim of each source.
CLAIM = "sourceId string, tick timestamp, claim string, id string, sourceLabel string, sourceUrl string, status string, reason string, startedAt timestamp"


def started(sources: DataFrame, reason: str, at: Column, running: DataFrame | None = None) -> DataFrame:
    """A running job for each source (id, label, url), but for those that have one in running (sourceId) already."""
    idle = sources if running is None else sources.join(running.select(F.col("sourceId").alias("id")), "id", "left_anti")
    return idle.select(
        ledger.job_id(at, F.col("id")).alias("id"), F.col("id").alias("sourceId"), F.col("label").alias("sourceLabel"), F.col("url").alias("sourceUrl"), F.lit("running").alias("status"), F.lit(reason).alias("reason"), at.alias("startedAt")
    )


def finished(jobs: DataFrame, results: DataFrame, at: Column) -> DataFrame:
    """Running jobs with their results (sourceId, adapterId, totalSections, totalProducts, catalogDetected, message): failed where there is a message, else completed. Jobs without a result stay as they are."""
    rows = jobs.join(results.withColumn("_done", F.lit(True)), "sourceId", "left")
    failed, done = F.col("message").isNotNull(), F.col("_done").isNotNull()
    metrics = F.struct(F.coalesce("totalSections", F.lit(0)).alias("totalSections"), F.coalesce("totalProducts", F.lit(0)).alias("totalProducts"), F.coalesce("catalogDetected", F.lit(False)).alias("catalogDetected"))
    status = F.when(done & failed, "failed").when(done, "completed").otherwise(F.col("status"))
    return rows.select(
        "id", "sourceId", "sourceLabel", "sourceUrl", status.alias("status"), "reason", "startedAt", F.when(done, at).alias("finishedAt"),
        F.when(failed, F.struct("message")).alias("error"), "adapterId", F.when(done & ~failed, metrics).alias("metrics"),
    )


def patched_sources(sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """Sources after their latest finished job: times, latest job and the last error, which a success clears."""
    done = jobs.where("finishedAt is not null").groupBy(F.col("sourceId").alias("id")).agg(F.max_by(F.struct("id", "status", "finishedAt", F.col("error.message").alias("message")), F.struct("finishedAt", "id")).alias("job"))
    rows, ok = sources.join(done, "id", "left"), F.col("job.status") == "completed"
    new = {"lastRunAt": F.coalesce("job.finishedAt", "lastRunAt"), "lastSuccessAt": F.when(ok, F.col("job.finishedAt")).otherwise(F.col("lastSuccessAt")), "latestJobId": F.when(ok, F.col("job.id")).otherwise(F.col("latestJobId")), "lastError": F.when(ok, None).otherwise(F.coalesce("job.message", "lastError"))}
    return rows.withColumns(new).drop("job").select(sources.columns)


def batch_status(items: DataFrame) -> DataFrame:
    """(batchId, status, currentItemIndex): running while an item is queued or running; completed even if every item failed."""
    open_ = F.col("status").isin("queued", "running")
    return items.groupBy("batchId").agg(F.when(F.count_if(open_) > 0, "running").otherwise("completed").alias("status"), F.min(F.when(F.col("status") == "running", F.col("index"))).alias("currentItemIndex"))


def claimed(store: Stored, sources: DataFrame, tick: datetime, reason: str = "schedule") -> DataFrame:
    """Running jobs (CLAIM) of the sources (id, label, url) that this call may start: those with no running job and no claim of
    this tick or a later one. The claims are committed before they are returned, so a tick that is repeated after a restart,
    or that overlaps with another, gets none of them again. store holds one row for each source."""
    own, at = uuid.uuid4().hex, F.lit(tick).cast("timestamp")

    def change(base: DataFrame) -> DataFrame:
        taken = base.where((F.col("status") == "running") | (F.col("tick") >= at)).select(F.col("sourceId").alias("id"))
        free = sources.dropDuplicates(["id"]).join(taken, "id", "left_anti")
        jobs = started(free, reason, at).withColumns({"tick": at, "claim": F.lit(own)})
        return ledger.upserted(base, jobs, "sourceId")

    version = store.update(change)
    return store.read(version).where(F.col("claim") == own)


def ended(store: Stored, results: DataFrame) -> int:
    """Commits the status (completed or failed) of jobs (id, status), so that their sources may be claimed by a later tick."""
    return store.update(lambda base: ledger.patched(base, results.select("id", "status")))


def abandoned(store: Stored, before: datetime) -> int:
    """Commits as failed all running jobs that started before a time: their runner was lost."""
    lost = (F.col("status") == "running") & (F.col("startedAt") < F.lit(before).cast("timestamp"))
    return store.update(lambda base: base.withColumn("status", F.when(lost, "failed").otherwise(F.col("status"))))


def advanced(items: DataFrame, results: DataFrame, at: Column) -> DataFrame:
    """One step of sequential batches. items: (batchId, index, status, startedAt, finishedAt, error); results: (batchId, index, error) of running items that have ended. They become completed, or failed where there is an error; then, in each batch without a running item, the first queued one starts."""
    done = results.select("batchId", "index", F.col("error").alias("_error"), F.lit(True).alias("_done"))
    over = (F.col("status") == "running") & F.col("_done").isNotNull()
    rows = items.join(done, ["batchId", "index"], "left").select(
        "batchId", "index", F.when(over, F.when(F.col("_error").isNull(), "completed").otherwise("failed")).otherwise(F.col("status")).alias("status"),
        "startedAt", F.when(over, at).otherwise(F.col("finishedAt")).alias("finishedAt"), F.when(over, F.col("_error")).otherwise(F.col("error")).alias("error"),
    )
    first = F.min(F.when(F.col("status") == "queued", F.col("index"))).alias("_next")
    turn = rows.groupBy("batchId").agg(first, F.count_if(F.col("status") == "running").alias("_running")).where("_running = 0").drop("_running")
    starts = F.coalesce(F.col("index") == F.col("_next"), F.lit(False))
    out = rows.join(turn, "batchId", "left")
    return out.withColumns({"status": F.when(starts, "running").otherwise(F.col("status")), "startedAt": F.when(starts, at).otherwise(F.col("startedAt"))}).select(items.columns)
