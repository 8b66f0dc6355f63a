"""Every query with a SQL twin gives the same rows on DuckDB."""

import __spark_entry__ as entry
import pytest
from oracle_compare import compare

from questloom.plans.catalogue import QUERIES, oracles

SMALL = "/root/testdata/sf0.001"
TWINS = oracles()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, name):
    if name in TWINS:
        ok, note = compare(spark, SMALL, QUERIES[name], TWINS[name])
        assert ok, note
    else:
        assert QUERIES[name](spark, SMALL).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() == 4
