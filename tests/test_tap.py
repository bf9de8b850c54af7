"""The running lists of a capture stream against the same captures read at once."""

import json
import os
import shutil
from datetime import datetime, timedelta

import pytest

from gondola.operators.pages import payload_matches
from gondola.streaming import tail

SCHEMA = "page_url string, seq int, url string, content_type string, body string, at timestamp"
START = datetime(2024, 1, 1, 10)


def capture(page, seq, n, minutes, body=None):
    items = [{"id": f"{page}{seq}{k}", "nome": f"Produto {k}", "price": 1.5 + k} for k in range(n)]
    return (page, seq, f"http://a/api/products?{seq}", "application/json", json.dumps({"items": items}) if body is None else body, START + timedelta(minutes=minutes))


def land(spark, folder, k, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/part{k}")
    name = next(f for f in os.listdir(f"{folder}/part{k}") if f.endswith(".parquet"))
    os.makedirs(f"{folder}/in", exist_ok=True)
    os.rename(f"{folder}/part{k}/{name}", f"{folder}/in/{k}.parquet")
    os.utime(f"{folder}/in/{k}.parquet", (1000 + k, 1000 + k))


def run(spark, folder):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    tail.tapped(stream, f"{folder}/cp", f"{folder}/out", once=True).awaitTermination()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stream_is_the_batch_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "TOTALS_EVERY", 3)
    first = [capture("p", k, 3 + k % 4, k) for k in range(6)] + [capture("q", 1, 2, 3), capture(None, 1, 4, 3)]
    second = [capture("p", k, 2 + k % 7, k) for k in range(6, 16)] + [capture("q", 2, 0, 15, "not json"), capture("q", 3, 5, 15, None)]
    third = [capture("q", 4, 6, 40), *first[:3]]  # the old ones come again
    fourth = [capture("p", 90, 50, 0), capture("r", 1, 1, 41), capture("q", 4, 6, 42)]  # p's is late; q's comes again
    for k, rows in enumerate([first, second, third]):
        land(spark, tmp_path, k, rows)
    run(spark, tmp_path)
    land(spark, tmp_path, 3, fourth)
    run(spark, tmp_path)
    want = spark.createDataFrame(first + second + [third[0], fourth[1]], SCHEMA)
    assert rows_of(tail.tapped_matches(spark, f"{tmp_path}/out")) == rows_of(payload_matches(want))


@pytest.mark.parametrize("batch", [1])
def test_repeated_batch_gives_the_same_lists(spark, tmp_path, batch):
    parts = [[capture("p", 10 * b + k, 1 + (3 * k + b) % 5, b) for k in range(6)] for b in range(3)]
    for b in range(batch + 1):
        land(spark, tmp_path, b, parts[b])
    run(spark, tmp_path)
    commits = tmp_path / "cp" / "commits"
    last = max(int(f.name) for f in commits.iterdir() if f.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        (commits / name).unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "out" / f"batch={last}")
    land(spark, tmp_path, 2, parts[2])
    run(spark, tmp_path)
    assert rows_of(tail.tapped_matches(spark, f"{tmp_path}/out")) == rows_of(payload_matches(spark.createDataFrame(sum(parts, []), SCHEMA)))
