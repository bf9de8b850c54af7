"""Streams: a log tail, plain and with line numbers, a schedule, and products out of captured responses."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gondola import schemas
from gondola.functions import payloads
from gondola.operators import ledger, ranking, scoring
from gondola.operators.pages import MATCHES, match_rows
from gondola.plans import runs
from gondola.sources.stored import Stored

#: Every so many batches the totals of all jobs are written, else those of the batch's own.
TOTALS_EVERY = 64
MATCH = "page_url string, seq int, n int, responseUrl string, path string, score int, normalizedCount int, batch int"
MATCH_KEYS = [f.split()[0] for f in MATCH.split(", ")[:-1]]


def log_stream(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """Log lines as they land; the checkpoint of the query that reads them holds the place."""
    reader = spark.readStream.schema(schemas.LOG)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).json(folder)


def tail(stream: DataFrame, checkpoint: str, out: str, once: bool = False) -> StreamingQuery:
    """Writes what is new every 1.5 seconds, or all there is and ends."""
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1500 milliseconds")).start()


def numbered_tail(stream: DataFrame, job: str, order: list[str], checkpoint: str, out: str, once: bool = False) -> StreamingQuery:
    """Numbers the lines of each job as they land: line goes on from what the batches before have written, in the given order
    within a batch. Each batch has folders of its own, which a repeated batch overwrites, so lines are neither lost nor
    numbered twice after a restart. Jobs of any size: ranking.numbered splits hot ones.

    Defined results: lines without a job are one job; equal lines are each numbered; later batches never change numbers given."""

    def number(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        lines = ranking.numbered(batch, [job], [F.col(c) for c in order])
        if k:
            paths = [f"{out}/totals/batch={b}" for b in range((k - 1) // TOTALS_EVERY * TOTALS_EVERY, k)]
            before = spark.read.schema(f"key {batch.schema[job].dataType.simpleString()}, total long").parquet(*paths).groupBy("key").agg(F.max("total").alias("_before"))
            lines = lines.join(before, F.col(job).eqNullSafe(F.col("key")), "left").drop("key")
        else:
            before, lines = None, lines.withColumn("_before", F.lit(0))
        lines = lines.withColumn("line", F.coalesce("_before", F.lit(0)) + F.col("_at"))
        lines.select(*batch.columns, "line").write.mode("overwrite").parquet(f"{out}/lines/batch={k}")
        totals = spark.read.parquet(f"{out}/lines/batch={k}").groupBy(F.col(job).alias("key")).agg(F.max("line").alias("total"))
        if before is not None and k % TOTALS_EVERY == 0:
            totals = totals.unionByName(before.withColumnRenamed("_before", "total")).groupBy("key").agg(F.max("total").alias("total"))
        totals.write.mode("overwrite").parquet(f"{out}/totals/batch={k}")

    writer = stream.writeStream.foreachBatch(number).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1500 milliseconds")).start()


def numbered_lines(spark: SparkSession, out: str) -> DataFrame:
    """The lines that numbered_tail has written, of whole batches only."""
    last = spark.read.parquet(f"{out}/totals").agg(F.max("batch")).first()[0]
    return spark.read.parquet(f"{out}/lines").where(F.col("batch") <= F.lit(last)).drop("batch")


def resumed(lines: DataFrame, job: str, of: str, after: int = 0, limit: int = 200) -> DataFrame:
    """What a client that has seen `after` lines of a job gets next; it goes on from the last line's number."""
    return lines.where((F.col(job) == of) & (F.col("line") > after)).orderBy("line").limit(max(limit, 1))


def until_done(query: StreamingQuery, status: Callable[[], str | None], seconds: float = 1.5) -> str:
    """Lets a job's tail run until the job has completed or failed: writes what is left, stops and gives that status. Without such a job (None) it stops at once: missing."""
    while True:
        now = status()
        if now is None or now in ("completed", "failed"):
            if now:
                query.processAllAvailable()
            query.stop()
            return now or "missing"
        if query.awaitTermination(seconds):
            return now


def counts(stream: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Lines of each level in windows of event time; lines later than the watermark are left out."""
    return stream.withWatermark("at", late).groupBy(F.window("at", window), "level").agg(F.count("*").alias("n"))


def schedule(spark: SparkSession, sources: Callable[[], DataFrame], store: Stored, run: Callable[[DataFrame], None], checkpoint: str, seconds: int = 60) -> StreamingQuery:
    """Claims the sources that are due at each tick and hands their jobs to run, which ends them (runs.ended). A tick is a stretch of
    `seconds` of the stream's own time: one that is repeated after a restart is the same tick, of which nothing is claimed twice."""

    def tick(batch: DataFrame, _: int) -> None:
        at = batch.agg(F.max("timestamp")).first()[0]
        if at is not None:
            tick_at(sources(), store, at - timedelta(seconds=at.timestamp() % seconds), run)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def tick_at(sources: DataFrame, store: Stored, at: datetime, run: Callable[[DataFrame], None]) -> None:
    """One tick: the due sources that nobody has claimed."""
    due = ledger.due(sources, store.read().where("status = 'running'"), F.lit(at).cast("timestamp"))
    jobs = runs.claimed(store, due, at)
    if not jobs.isEmpty():
        run(jobs)


def capture_products(stream: DataFrame) -> DataFrame:
    """The product arrays of captured responses as they land."""
    able = stream.where(scoring.capture_able(F.col("url"), F.col("content_type"), F.col("body")))
    arrays = able.select("url", F.explode(payloads.found_arrays("body", "url")).alias("found"))
    return arrays.select("url", "found.path", "found.score", F.explode("found.items").alias("item")).select("url", "path", "score", "item.*")


def tapped(stream: DataFrame, checkpoint: str, out: str, late: str = "10 minutes", n: int = MATCHES, once: bool = False) -> StreamingQuery:
    """Keeps the best n product arrays of each page while its responses are captured (page_url, seq, url, content_type, body, at).

    A capture (page_url, seq) counts once, and not at all if it lands later than the watermark allows. Each batch writes, to a folder of
    its own, the lists of the pages that it met, put together with what they had; every so many batches the lists of all pages. A
    batch that is repeated after a restart starts from the batches before it and overwrites its folder, so its list is the same.

    Defined results: captures that aren't worth parsing or hold no products change nothing; null bodies likewise; of equal scores the
    smaller seq, then the earlier array counts; captures without a time are late as soon as there is a watermark; captures
    without a page are one page."""
    once_each = stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["page_url", "seq"])

    def merge(batch: DataFrame, k: int) -> None:
        new = match_rows(batch).select(*MATCH_KEYS)
        if k:
            before = _latest(batch.sparkSession, out, (k - 1) // TOTALS_EVERY * TOTALS_EVERY, k)
            if k % TOTALS_EVERY:
                touched = new.select(F.col("page_url").alias("_page")).distinct()
                before = before.join(touched, F.col("page_url").eqNullSafe(F.col("_page")), "left_semi")
            # A capture that comes again after its state has gone must not stand in the list twice.
            new = ranking.keep_first(new.unionByName(before), ["page_url", "seq", "n"], [F.col("score").desc()])
        best = ranking.top(new, ["page_url"], [F.col("score").desc(), F.col("seq"), F.col("n")], n)
        best.select(*MATCH_KEYS).write.mode("overwrite").parquet(f"{out}/batch={k}")

    writer = once_each.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1500 milliseconds")).start()


def _latest(spark: SparkSession, out: str, first: int, end: int) -> DataFrame:
    """Each page's list as the last of the batches from first to end - 1 that met it has written it."""
    rows = spark.read.schema(MATCH).option("basePath", out).parquet(*(f"{out}/batch={b}" for b in range(first, end)))
    last = rows.groupBy(F.col("page_url").alias("_page")).agg(F.max("batch").alias("_last"))
    return rows.join(last, F.col("page_url").eqNullSafe(F.col("_page")) & (F.col("batch") == F.col("_last")), "left_semi").select(*MATCH_KEYS)


def tapped_matches(spark: SparkSession, out: str, n: int = MATCHES) -> DataFrame:
    """The running lists after the last batch that was written, as payload_matches() gives them."""
    last = spark.read.schema(MATCH).parquet(out).agg(F.max("batch")).first()[0]
    rows = _latest(spark, out, (last or 0) // TOTALS_EVERY * TOTALS_EVERY, (last or 0) + 1)
    return ranking.top(rows, ["page_url"], [F.col("score").desc(), F.col("seq"), F.col("n")], n).select("page_url", "rank", "path", "responseUrl", "score", "normalizedCount")
