"""Every query that has SQL gives the rows of that SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from cachelens.plans.catalog import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(ORACLE) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
    assert e.entry(spark).columns == ["cache_id", "hit", "miss", "gets_total", "hit_ratio"]
