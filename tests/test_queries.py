"""Every registered query over alignments against its DuckDB counterpart."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from strandset.plans.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def canonical(df):
    columns = sorted(df.columns)
    plain = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return columns, sorted([tuple(map(plain, row)) for row in df[columns].astype(object).itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    assert canonical(QUERIES[name](spark, DIR).toPandas()) == canonical(duck.sql(ORACLE_SQL[name]).df())


def test_figures(spark):
    assert QUERIES["pair_duplicates"](spark, DIR).count() == 82
    assert QUERIES["stream_closing_pairs"](spark, DIR).where("is_duplicate").count() == 17
    assert QUERIES["fragment_duplicates"](spark, DIR).where("by_marker").count() == 475


def test_entry(spark):
    assert entry.entry(spark).count() == 6000
    assert set(entry.oracle_sql()) <= set(entry.queries())
