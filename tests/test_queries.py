import duckdb
import pytest

from pagewright.plans.oracle import SQL
from pagewright.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(df):
    names = sorted(df.columns)
    return names, sorted(map(tuple, df[names].astype(str).values.tolist()))


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_its_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DIR).toPandas()) == rows(duck.execute(SQL[name]).df())


def test_registry(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
