"""Every registered query against its SQL in DuckDB, on the same tables."""

import duckdb
import pytest

from gondola import shop_queries  # noqa: F401 registers its queries
from gondola.queries import ORACLE_SQL, QUERIES
from tests.conftest import DATA
from tests.vectors import CASES

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.01/{t}.parquet'")
    return found


def plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, medium, db, name):
    same(db, ORACLE_SQL[name], QUERIES[name](spark, medium))


@pytest.mark.parametrize("name", sorted(CASES))
def test_cases_worked_out_by_hand(spark, medium, db, name):
    f, sql = CASES[name]
    same(db, sql, f(spark, medium))


def same(db, sql, got):
    want = db.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    a, b = plain(map(tuple, got.select(columns).collect())), plain(want.fetchall())
    assert len(a) == len(b) and a == b and a


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
