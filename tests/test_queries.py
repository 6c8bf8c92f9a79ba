import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{small}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(frame, columns):
    return sorted(str(tuple(None if v is None or v != v else v for v in r)) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(entry.core.queries()))
def test_query_equals_its_oracle(spark, small, duck, name):
    got, want = entry.core.queries()[name](spark, small).toPandas(), duck.execute(entry.core.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got, sorted(got.columns)) == plain(want, sorted(got.columns)) and len(got)


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0
