"""Stored ledgers, claims, batches, numbered tails, deliveries and mergeable states."""

from __future__ import annotations

import os
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gondola.operators import ledger, ranking
from gondola.plans import runs
from gondola.sources import sinks
from gondola.sources.stored import Conflict, Stored
from gondola.streaming import tail
from tests.test_plans import PRODUCTS, product

ROWS = "id string, n int"
AT = datetime(2024, 1, 1, 12)


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_of_two_writers_one_wins(spark, tmp_path):
    store = Stored(spark, f"file://{tmp_path}/t", ROWS)
    assert store.version() == 0 and store.read().count() == 0
    one = spark.createDataFrame([("a", 1)], ROWS)
    assert store.commit(one, 0) == 1
    with pytest.raises(Conflict):
        store.commit(spark.createDataFrame([("b", 2)], ROWS), 0)
    assert rows_of(store.read(), "id", "n") == [("a", 1)]
    assert len([f for f in os.listdir(tmp_path / "t") if f.startswith("rows-")]) == 1  # the loser's rows are gone
    seen = store.read()
    store.update(lambda base: ledger.upserted(base, spark.createDataFrame([("a", 5), ("c", 3)], ROWS)))
    assert rows_of(seen, "id", "n") == [("a", 1)] and rows_of(store.read(), "id", "n") == [("a", 5), ("c", 3)]
    with pytest.raises(LookupError):
        store.remove(spark.createDataFrame([("a",), ("x",)], "id string"))
    assert store.version() == 2 and store.remove(spark.createDataFrame([("a",)], "id string")) == 3
    store.cleaned(1)
    assert rows_of(store.read(), "id", "n") == [("c", 3)] and store.versions() == [1, 2, 3]


def test_updates_at_once_lose_nothing(spark, tmp_path):
    folder = f"{tmp_path}/t"
    Stored(spark, folder, ROWS)

    def add(k):
        Stored(spark, folder, ROWS).update(lambda base: ledger.upserted(base, spark.createDataFrame([(str(k), k)], ROWS)), tries=20)

    threads = [threading.Thread(target=add, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    store = Stored(spark, folder, ROWS)
    assert store.version() == 4 and rows_of(store.read(), "n") == [(0,), (1,), (2,), (3,)]


def test_a_tick_starts_no_source_twice(spark, tmp_path):
    store = Stored(spark, f"{tmp_path}/claims", runs.CLAIM)
    sources = spark.createDataFrame([("a", "A", "http://a"), ("b", "B", "http://b"), ("b", "B", "http://b")], "id string, label string, url string")
    got: list = []

    def overlap():
        got.append(rows_of(runs.claimed(Stored(spark, f"{tmp_path}/claims", runs.CLAIM), sources, AT), "sourceId"))

    threads = [threading.Thread(target=overlap) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(sum(got, [])) == [("a",), ("b",)]
    jobs = store.read()
    assert runs.claimed(store, sources, AT + timedelta(minutes=1)).count() == 0  # still running
    runs.ended(store, jobs.where("sourceId = 'a'").select("id", F.lit("completed").alias("status")))
    assert runs.claimed(store, sources, AT).count() == 0  # the tick again, after a restart
    assert rows_of(runs.claimed(store, sources, AT + timedelta(minutes=1)), "sourceId", "status") == [("a", "running")]
    runs.abandoned(store, AT + timedelta(seconds=30))
    assert rows_of(store.read(), "sourceId", "status") == [("a", "running"), ("b", "failed")]


def test_ticks_run_what_is_due(spark, tmp_path):
    store, started = Stored(spark, f"{tmp_path}/claims", runs.CLAIM), []
    sources = spark.createDataFrame([("a", "A", "http://a", True, 60, None, None), ("off", "O", "http://o", False, 60, None, None), ("new", "N", "http://n", True, 60, AT, AT)], "id string, label string, url string, enabled boolean, scheduleMinutes int, lastRunAt timestamp, lastSuccessAt timestamp")
    run = lambda jobs: started.extend(rows_of(jobs, "sourceId"))
    for minutes in (1, 1, 2, 61):
        tail.tick_at(sources, store, AT + timedelta(minutes=minutes), run)
    assert started == [("a",), ("new",)]
    query = tail.schedule(spark, lambda: sources, Stored(spark, f"{tmp_path}/other", runs.CLAIM), run, f"{tmp_path}/cp", seconds=1)
    for _ in range(60):
        if len(started) == 4 or not query.isActive:
            break
        query.awaitTermination(1)
    query.stop()
    assert sorted(started[2:]) == [("a",), ("new",)]


def test_batches_run_one_item_after_another(spark):
    items = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), ("y", 1)], "batchId string, index int").select("*", F.lit("queued").alias("status"), *(F.lit(None).cast(t).alias(c) for c, t in (("startedAt", "timestamp"), ("finishedAt", "timestamp"), ("error", "string"))))
    none = spark.createDataFrame([], "batchId string, index int, error string")
    errors = {("x", 2): "boom"}
    seen = []
    results = none
    for step in range(5):
        items = spark.createDataFrame(runs.advanced(items, results, F.lit(AT + timedelta(minutes=step))).collect(), items.schema)
        running = rows_of(items.where("status = 'running'"), "batchId", "index")
        seen.append(running)
        results = spark.createDataFrame([(*r, errors.get(r)) for r in running], "batchId string, index int, error string")
    assert seen == [[("x", 1), ("y", 1)], [("x", 2)], [("x", 3)], [], []]
    assert rows_of(items, "batchId", "index", "status", "error")[1] == ("x", 2, "failed", "boom")
    assert {r["status"] for r in runs.batch_status(items).collect()} == {"completed"}
    x = {r["index"]: r for r in items.where("batchId = 'x'").collect()}
    assert x[1]["finishedAt"] == x[2]["startedAt"] == AT + timedelta(minutes=1) and x[3]["finishedAt"] == AT + timedelta(minutes=3)


def test_numbered_tail_is_the_page_of_the_batch_read(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "TOTALS_EVERY", 2)
    events = spark.read.parquet(f"{small}/events.parquet").select(F.col("user_id").cast("string").alias("job"), "ts", "event_id")
    rows = events.orderBy("ts", "event_id").collect()
    folder, step = tmp_path / "in", -(-len(rows) // 6)
    for k in range(6):
        spark.createDataFrame(rows[k * step : (k + 1) * step], events.schema).coalesce(1).write.parquet(f"{tmp_path}/part{k}")
    folder.mkdir()

    def land(k):
        name = next(f for f in os.listdir(tmp_path / f"part{k}") if f.endswith(".parquet"))
        os.rename(tmp_path / f"part{k}" / name, folder / f"{k}.parquet")
        os.utime(folder / f"{k}.parquet", (1000 + k, 1000 + k))

    def run():
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        tail.numbered_tail(stream, "job", ["ts", "event_id"], f"{tmp_path}/cp", f"{tmp_path}/out", once=True).awaitTermination()

    for k in range(4):
        land(k)
    run()
    os.remove(tmp_path / "cp" / "commits" / "3")  # stopped after its rows were written, before the commit: the batch comes again
    for crc in (tmp_path / "cp" / "commits").glob(".3.*"):
        crc.unlink()
    land(4)
    land(5)
    run()
    lines = tail.numbered_lines(spark, f"{tmp_path}/out")
    want = ledger.log_page(events, ["job"], [F.col("ts"), F.col("event_id")], 0, len(rows))
    assert rows_of(lines, "job", "line", "event_id") == rows_of(want, "job", "line", "event_id")
    job = events.first()["job"]
    first = tail.resumed(lines, "job", job, 0, 3).collect()
    assert [r["line"] for r in first] == [1, 2, 3] and tail.resumed(lines, "job", job, 3, 1).first()["line"] == 4


def test_chunks_are_sent_once_and_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(j, k, f"{j}{k}") for k in (3, 1, 2) for j in ("a", "b")] + [(None, 1, None), ("a", 1, "a1")], "job string, batchIndex int, body string")
    calls = f"{tmp_path}/calls.txt"

    def post(url, body, headers):
        with open(calls, "a") as file:
            file.write(f"{body} {headers.get('Authorization')}\n")
        if body == "b2":
            raise OSError("down")
        if body == "a3" and not os.path.exists(f"{calls}.lost"):
            open(f"{calls}.lost", "w").close()
            os._exit(1)  # the task is lost in the middle of a call; Spark runs it again
        return 500 if body == "a2" else 200

    def lines():
        with open(calls) as file:
            return file.read().splitlines()

    with pytest.raises(Exception):  # noqa: B017 local mode gives a task one chance: the call itself is repeated
        sinks.delivered(rows, "http://x", f"{tmp_path}/d", "secret", post)
    got = sinks.delivered(rows, "http://x", f"{tmp_path}/d", "secret", post).collect()
    found = {(r["job"], r["batchIndex"]): (r["status"], r["error"]) for r in got}
    assert found == {("a", 1): (200, None), ("a", 2): (500, "status 500"), ("a", 3): (None, "answer unknown"), ("b", 1): (200, None), ("b", 2): (None, "down"), ("b", 3): (200, None), ("", 1): (200, None)}
    sent = lines()
    assert len(sent) == 7 and {x.split(" ", 1)[1] for x in sent if x.strip()} == {"Bearer secret"}
    assert [x.split()[0] for x in sent if x[0] == "a"] == ["a1", "a2", "a3"] and [x.split()[0] for x in sent if x[0] == "b"] == ["b1", "b2", "b3"]
    more = rows.unionByName(spark.createDataFrame([("a", 4, "a4")], rows.schema))
    assert rows_of(sinks.delivered(more, "http://x", f"{tmp_path}/d", None, post), "job", "batchIndex") == [("a", 4)] and lines()[7:] == ["a4 None"]


def test_daily_merge_is_the_whole(spark):
    kinds = dict(x.split(" ") for x in PRODUCTS.split(", "))
    rows = [product(id=str(k % 5) if k % 7 else None, name=f"n{k % 3}", image="i" if k % 4 == 0 else None, link=None if k % 2 else "L", priceValue=None if k % 11 == 0 else float(k % 6), seq=k) for k in range(200)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {kinds[k]}" for k in rows[0]))
    days = [df.where(f"seq % 3 = {d}") for d in range(3)]
    for state, keys, whole in ((ranking.products_state, ["__key"], ranking.distinct_products(df)), (lambda x: ranking.extracted_state(x, ["sectionLabel"]), ["sectionLabel", "__key"], None)):
        merged = state(days[0])
        for day in days[1:]:
            merged = ranking.merged_state(merged, state(day), keys)
        assert sorted(map(str, merged.collect())) == sorted(map(str, state(df).collect()))
        if whole is not None:
            assert list(map(str, ranking.shown(ranking.of_state(merged, df.columns)).collect())) == list(map(str, whole.collect()))
    plan = ranking.distinct_extracted(df, ["sectionLabel"])._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_profiles_tell_all_candidates(spark, tmp_path):
    rows = spark.createDataFrame([("d", "dom", 3, 0, "u"), ("d", "network", 3, 1, "v"), ("d", "dom", 1, 2, "w")], "domain string, strategy string, n_items int, seq int, url string")
    sinks.write_profiles(rows, f"{tmp_path}/p")
    row = spark.read.parquet(f"{tmp_path}/p").first()
    assert row["bestCandidate"]["url"] == "v" and [tuple(c) for c in row["candidates"]] == [("dom", 3, "u"), ("network", 3, "v"), ("dom", 1, "w")]
