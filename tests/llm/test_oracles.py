import duckdb
import pytest

from gondola.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, medium, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{medium}/{t}.parquet'")
    want = db.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, medium)
    assert sorted(got.columns) == sorted(columns)
    norm = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)
    assert norm(got.select(columns).collect()) == norm(want.fetchall())
