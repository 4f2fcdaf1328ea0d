"""Every registered query of the engine against DuckDB."""

import pytest
from oracle import compare

from tidemill.queries import ORACLES, QUERIES


#: Queries whose feature is that nothing is selected.
EMPTY = {"select_no_match", "select_invalid_regex", "select_no_matchers", "select_tree_mode_needs_a_tag"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sf_dir, name):
    n = compare(spark, sf_dir, QUERIES[name], ORACLES[name])
    assert n > 0 or name in EMPTY


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
