"""Each core query against its SQL, on the smallest tables."""

import harness
import pytest

from tessera.plans import catalog

ORACLES = catalog.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    columns, rows = harness.spark_rows(catalog.queries()[name](spark, harness.DATA))
    expected_columns, expected = harness.oracle_rows(ORACLES[name])
    assert columns == expected_columns
    assert len(rows) == len(expected)
    assert rows == expected


def test_all_others_have_twins():
    """A query without SQL is held against a plain version in test_twins."""
    import test_twins

    assert sorted(set(catalog.queries()) - set(ORACLES)) == sorted(test_twins.TWINS)
