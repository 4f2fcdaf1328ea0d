"""Registered queries of this subpackage with SQL against DuckDB."""

import pytest
from oracle import compare

from tidemill.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, QUERIES[name], ORACLES[name]) > 0


def test_ten_operators_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES if q.startswith("op")) == list(range(1, 11))
