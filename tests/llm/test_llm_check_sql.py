"""Every query of the subpackage that has check SQL, against it."""

import check
import pytest

from shelfscope.llm.oracles import oracles
from shelfscope.llm.queries import QUERIES

ORACLES = oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    assert check.compare(df, duck, ORACLES[name]) is None
    assert check.types_of(df, duck, ORACLES[name]) == []


def test_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
