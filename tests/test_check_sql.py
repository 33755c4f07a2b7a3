"""Every registered query against its check SQL."""

import check
import pytest

from shelfscope.oracles import all_oracles
from shelfscope.plans.registry import QUERIES

ORACLES = all_oracles()


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert check.compare(df, duck, ORACLES[name]) is None
        assert check.types_of(df, duck, ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
