import re
from collections import defaultdict

import pytest

from gondola.llm import mixing
from gondola.llm.common import table
from tests.llm.frames import documents


def targets(sizes, weights=(3, 1, 2)):
    """Water-filling one source at a time."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level >= 2 * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check(spark, docs):
    rows = docs.select("doc_id", "text", "source").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want = targets(sizes)
    got = mixing.mix(docs)
    again = sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=str)
    found = got.collect()
    assert sorted(map(tuple, found), key=str) == again and len(found) == len(rows)
    assert sorted((str(r["doc_id"]), r["size"]) for r in found) == sorted((str(i), size(t)) for i, t, _ in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    by_target = defaultdict(int)
    for r in found:
        by_target[r["source_size"], round(r["target"], 6)] += r["taken"]
    for (source_size, target), taken in by_target.items():
        own = [s for s in sizes if sizes[s] == source_size and abs(want[s] - target) < 1e-4]
        assert own and taken == pytest.approx(len(own) * target, abs=len(own))


def test_table(spark, medium):
    check(spark, table(spark, medium, "documents"))


def test_cases(spark):
    docs = documents(spark)
    check(spark, docs)
    check(spark, docs.where("doc_id = 1"))
    assert mixing.mix(docs.where("false")).count() == 0


def test_ends_are_found_digit_by_digit(spark, medium):
    docs = table(spark, medium, "documents")
    want = sorted(map(tuple, mixing.mix(docs).collect()))
    assert sorted(map(tuple, mixing.mix(docs, digits=1, last_rows=2).collect())) == want


def test_a_third_of_all_rows_without_id(spark):
    rows = [(None, "four words without id", "hot")] * 300 + [(k, f"w{k} " * (k % 7), ("hot", "b", None)[k % 3]) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(spark, docs)
    assert sorted(map(str, mixing.mix(docs, digits=1, last_rows=2).collect())) == sorted(map(str, mixing.mix(docs).collect()))


def test_many_sources_keep_their_order(spark):
    rows = [(k, f"s{k * 7919 % 500}") for k in range(500)] + [(500, None)]
    found = mixing.in_order(spark.createDataFrame(rows, "k long, source string")).collect()
    order = sorted((r["source"] for r in found), key=lambda s: (s is None, s))
    assert {r["source"]: r["rank"] for r in found} == {s: k for k, s in enumerate(order)}


def test_main_path_is_native(spark, small):
    plan = mixing.mix(table(spark, small, "documents"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
