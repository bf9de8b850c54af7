"""Writers: CSV and JSON exports, run folders, logs, and webhook calls from the executors."""

from __future__ import annotations

import hashlib
import json
import os
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gondola.functions import text
from gondola.operators import summaries
from gondola.shared import written


def csv_value(df: DataFrame, name: str) -> Column:
    """A cell: lists of texts joined by a bar without empty ones, other lists and structs as JSON, null as empty."""
    kind, x = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
        words = F.transform(x, lambda v: F.coalesce(v.cast("string"), F.lit("")))
        x = F.array_join(F.filter(words, lambda v: v != ""), " | ")
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        x = F.to_json(x)
    return F.coalesce(x.cast("string"), F.lit(""))


def csv_rows(df: DataFrame) -> DataFrame:
    return df.select(*(csv_value(df, c).alias(c) for c in df.columns))


def write_csv(df: DataFrame, path: str) -> None:
    """Every cell quoted, quotes doubled, a header in each file."""
    csv_rows(df).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)


def widened(frames: list[DataFrame]) -> DataFrame:
    """Union whose columns are those of all frames, in the order they are first met."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def run_folder(root: str, at: Column, label: Column) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), F.date_format(at, "yyyy-MM-dd'T'HH-mm-ss-SSS'Z'"), F.lit("-"), text.slug(label))


def write_catalog(products: DataFrame, folder: str) -> None:
    """catalog (JSON and CSV) and summary of one run."""
    products.write.mode("overwrite").json(f"{folder}/catalog")
    write_csv(products, f"{folder}/catalog-csv")
    summaries.section_totals(products).write.mode("overwrite").json(f"{folder}/sections")
    summaries.catalog_totals(products).write.mode("overwrite").json(f"{folder}/summary")


def write_shelf_catalog(products: DataFrame, departments: DataFrame, stores: DataFrame, folder: str) -> None:
    """Shelf products (JSON and CSV), departments and summary of one store."""
    products.write.mode("overwrite").json(f"{folder}/catalog")
    write_csv(products, f"{folder}/catalog-csv")
    departments.write.mode("overwrite").json(f"{folder}/departments")
    summaries.shelf_totals(products, departments, stores).write.mode("overwrite").json(f"{folder}/summary")


def write_scrape(results: DataFrame, items: DataFrame, pages: DataFrame, folder: str) -> bool:
    """What a config read from pages (JSON), their HTML, and, only if there are items, a CSV of those; whether it was written."""
    results.write.mode("overwrite").json(f"{folder}/results")
    pages.select("page_id", "url", "html").write.mode("overwrite").json(f"{folder}/rendered")
    if items.isEmpty():
        return False
    write_csv(items, f"{folder}/results-csv")
    return True


def write_batch(catalogs: DataFrame, items: DataFrame, folder: str) -> None:
    """Summary, nested JSON and flat CSV of a batch."""
    summaries.batch_totals(items).write.mode("overwrite").json(f"{folder}/summary")
    catalogs.write.mode("overwrite").json(f"{folder}/catalogs")
    write_csv(summaries.flat_catalogs(catalogs), f"{folder}/catalogs-csv")


def append_logs(rows: DataFrame, folder: str) -> None:
    """Log lines with their own time and the time of writing."""
    rows.withColumn("ingested_at", F.current_timestamp()).write.mode("append").json(folder)


def write_profiles(candidates: DataFrame, path: str) -> None:
    """The best candidate of each domain, and summaries (strategy, n_items, url where there is one) of all its candidates in order; a domain's candidates are those of one visit, a handful."""
    kept = [c for c in candidates.columns if c != "domain"]
    best = F.max_by(F.struct(*kept), F.struct("n_items", F.col("strategy") == "network", -F.col("seq"))).alias("bestCandidate")
    told = F.struct("seq", *(c for c in ("strategy", "n_items", "url") if c in kept))
    every = F.transform(F.sort_array(F.collect_list(told)), lambda x: x.dropFields("seq")).alias("candidates")
    candidates.groupBy("domain").agg(best, every).write.mode("overwrite").parquet(path)


def http_post(url: str, body: str, headers: dict[str, str] | None = None, timeout: float = 20) -> int:
    call = urllib.request.Request(url, data=body.encode(), headers={"Content-Type": "application/json", **(headers or {})}, method="POST")
    with urllib.request.urlopen(call, timeout=timeout) as answer:
        return answer.status


def post_rows(rows: DataFrame, url: str, order: list[str], post: Callable[[str, str], int] = http_post) -> DataFrame:
    """Posts each row's body, those of a task one after the other in order; (body, status, error). A failed call is a row, it is neither raised nor repeated."""
    body = rows.sortWithinPartitions(*order).select("body")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for b in pdf["body"]:
                try:
                    status = post(url, b)
                    out.append((b, status, None if 200 <= status < 300 else f"status {status}"))
                except Exception as e:  # noqa: BLE001 any failure of a call is logged
                    out.append((b, None, str(e)[:200]))
            yield pd.DataFrame(out, columns=["body", "status", "error"])

    return body.mapInPandas(run, "body string, status int, error string")


class Journal:
    """What a job's calls came to, in a file of that job in a folder that all executors share, written before and after each call.

    A call that was begun is never made again: a task that is repeated finds it here."""

    def __init__(self, folder: str):
        self.folder = folder

    def _name(self, job: str) -> str:
        return os.path.join(self.folder, hashlib.sha256(job.encode()).hexdigest())

    def made(self, job: str) -> dict[int, list]:
        """[status, error] of each call begun; [None, None] where no answer is known."""
        if not os.path.exists(self._name(job)):
            return {}
        with open(self._name(job), encoding="utf-8") as file:
            whole = [line for line in file if line.endswith("\n")]
        return {k: answer for k, *answer in map(json.loads, whole)}

    def note(self, job: str, call: int, status: int | None = None, error: str | None = None) -> None:
        with open(self._name(job), "a", encoding="utf-8") as file:
            file.write(json.dumps([call, status, error]) + "\n")
            file.flush()
            os.fsync(file.fileno())


DELIVERY = "job string, batchIndex int, status int, error string"


def delivered(rows: DataFrame, url: str, folder: str, token: str | None = None, post: Callable[[str, str, dict[str, str]], int] = http_post) -> DataFrame:
    """Posts the chunks (job, batchIndex, body) that the delivery log in `folder` lacks, those of a job one after the other in the
    order of batchIndex, and adds what they came to (DELIVERY) to that log; returns the new rows of the log.

    A job's chunks go to one task, sorted there by Spark, which may spill; bodies are sent as they come, never held together.
    A chunk is sent at most once, also when a task or the whole call is repeated (Journal): failed calls are logged and not
    made again. Folder is a path that all executors share, mounted at the same place.

    Defined results: where a call was begun but its task lost, the error is `answer unknown`; a null job is the job with an
    empty name, a null body an empty one; of chunks with equal job and batchIndex the first by body is sent."""
    spark = rows.sparkSession
    os.makedirs(f"{folder}/calls", exist_ok=True)
    log, journal = f"{folder}/log", Journal(f"{folder}/calls")
    named = rows.select(F.coalesce(F.col("job").cast("string"), F.lit("")).alias("job"), F.col("batchIndex").cast("int").alias("batchIndex"), F.coalesce("body", F.lit("")).alias("body"))
    if os.path.exists(log):
        named = named.join(spark.read.schema(DELIVERY).parquet(log).select("job", "batchIndex"), ["job", "batchIndex"], "left_anti")
    headers = {"Authorization": f"Bearer {token}"} if token else {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, made, sent = None, {}, set()
        for pdf in batches:
            out = []
            for j, k, body in zip(pdf["job"], pdf["batchIndex"], pdf["body"]):
                if j != job:
                    job, made, sent = j, journal.made(j), set()
                if k in sent:
                    continue
                sent.add(k)
                if k in made:
                    status, error = made[k] if made[k] != [None, None] else (None, "answer unknown")
                else:
                    journal.note(j, int(k))
                    try:
                        status = post(url, body, headers)
                        error = None if 200 <= status < 300 else f"status {status}"
                    except Exception as e:  # noqa: BLE001 any failure of a call is logged
                        status, error = None, str(e)[:200] or type(e).__name__
                    journal.note(j, int(k), status, error)
                out.append((j, k, status, error))
            yield pd.DataFrame(out, columns=["job", "batchIndex", "status", "error"]).astype({"status": "Int32"})

    done = written(named.repartition("job").sortWithinPartitions("job", "batchIndex", "body").mapInPandas(run, DELIVERY), "delivery")
    done.write.mode("append").parquet(log)
    return done


def job_event(jobs: DataFrame) -> DataFrame:
    """(id, body): the event of each finished job."""
    done = jobs.where(F.col("status").isin("completed", "failed"))
    return done.select("id", F.to_json(F.struct(F.concat(F.lit("catalog."), F.col("status")).alias("event"), F.struct(*jobs.columns).alias("job"))).alias("body"))
