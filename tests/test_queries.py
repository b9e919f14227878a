"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import duckdb
import pytest

from kbspark import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame):
    columns = sorted(frame.columns)
    tidy = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return columns, sorted(tuple(tidy(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    assert plain(plans.queries()[name](spark, SF).toPandas()) == plain(duck.execute(plans.oracle_sql()[name]).df())


def test_queries_without_sql_run(spark):
    for name in set(plans.queries()) - set(plans.oracle_sql()):
        assert plans.queries()[name](spark, SF).count() >= 1, name
