import importlib

import pytest

from gondola.llm import queries
from gondola.llm.common import table
from tests.llm.frames import documents
from tests.llm.test_chosenpath import brute as groups
from tests.llm.test_decontaminate import brute as held
from tests.llm.test_mixing import check

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """docs before each stage, and after the last."""
    folder = tmp_path_factory.mktemp("stages")
    out = [table(spark, small, "documents")]
    for name, stage in pipeline.STAGES:
        stage(spark, out[-1], small).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def ids(docs):
    return {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_stages_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language", "quality", "near_duplicates", "decontamination", "mixing"]
    assert all(x.columns == stages[0].columns for x in stages[:-1])
    assert all(b.count() <= a.count() for a, b in zip(stages, stages[1:])) and stages[-1].count() == stages[-2].count()


def test_filters_keep_clean_documents(spark, small, stages):
    good = {r["doc_id"] for r in table(spark, small, "labels").collect() if r["quality"] == 1}
    for before, after in zip(stages[:2], stages[1:3]):
        assert len((ids(before) - ids(after)) & good) <= 0.03 * len(ids(before) & good) + 1


def test_one_document_of_each_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    assert ids(stages[3]) == {class_id for _, class_id, _ in groups(rows)}


def test_contaminated_documents_go(spark, small, stages):
    items = [r["text"] for r in table(spark, small, "benchmark").collect()]
    gone = ids(stages[3]) - ids(stages[4])
    for r in stages[3].collect():
        own = " ".join(r["text"].lower().split())
        exact = any(" ".join(t.lower().split()) in own for t in items)
        assert not exact or r["doc_id"] in gone
    texts = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    assert all(max(held(texts[d], t) for t in items) >= 0.8 for d in gone)


def test_mix_of_what_is_left(spark, stages):
    check(spark, stages[4])


def test_run_is_the_stages_one_after_the_other(spark, small, stages):
    assert sorted(map(tuple, pipeline.run(spark, small).collect())) == sorted(map(tuple, stages[-1].collect()))


def test_odd_and_empty_tables(spark, small):
    docs = documents(spark)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.where("false"), small).count() == 0
        stage(spark, docs, small).collect()


def test_queries_are_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names) and set(queries.ORACLE_SQL) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
