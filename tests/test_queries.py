"""Every query with an oracle gives the oracle's rows."""

import pytest

from tests.oracle import answer, asked
from tidemark.catalog import CATALOG

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(CATALOG.oracle))
def test_query(spark, name):
    assert asked(CATALOG.queries[name](spark, DATA)) == answer(DATA, CATALOG.oracle[name])


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["user_id", "n"]
