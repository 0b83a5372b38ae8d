"""Queries on tables whose keys go far beyond those of the smallest scale, against DuckDB."""

import duckdb
import pytest

from muxlake import catalog
from tests.test_oracles import rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """A folder of events three times over, whose users reach beyond a stream's PIDs."""
    folder = tmp_path_factory.mktemp("far")
    c = duckdb.connect()
    copies = f"(SELECT * REPLACE (event_id + r * 100000 AS event_id, user_id + r * 7925 AS user_id) FROM '{FOLDER}/events.parquet', (SELECT unnest(range(3)) AS r))"
    c.sql(f"COPY {copies} TO '{folder}/events.parquet'")
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return str(folder), c


def same(spark, far, name):
    folder, c = far
    got, want = catalog.QUERIES[name](spark, folder).toPandas(), c.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_packets_of_more_pids_than_a_stream_has(spark, far):
    same(spark, far, "packet_round_trip")


def test_pes_packets_of_more_pids_than_a_stream_has(spark, far):
    same(spark, far, "pes_timing_round_trip")


def test_stamped_packets_of_more_pids_than_a_stream_has(spark, far):
    same(spark, far, "stamped_bytes")
