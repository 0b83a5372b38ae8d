"""The queries that this package registers."""

from muxlake.llm import queries


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert queries.ORACLES.keys() <= queries.QUERIES.keys()
