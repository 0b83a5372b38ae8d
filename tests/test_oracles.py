"""Every media query with an oracle, against DuckDB at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from muxlake import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def rows(df):
    def plain(x):
        if pd.isna(x):
            return None
        return round(float(x), 6) if isinstance(x, (int, float)) or hasattr(x, "dtype") else x

    return sorted(repr(tuple(plain(x) for x in r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    if name in catalog.ORACLES:
        want = con.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_keep_list_reaches_the_whole_stream(spark):
    folder = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = catalog.QUERIES["pid_filter_whole"](spark, folder).toPandas()
    assert got["n"].max() >= 5000
    assert rows(got) == rows(c.sql(catalog.ORACLES["pid_filter_whole"]).df())
