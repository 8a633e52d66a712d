"""Every query of the engine against its SQL on the smallest tables."""

import pytest
from oracle import SF, rows_by_sql, rows_of

from calibrant.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, name):
    mine, cols = rows_of(catalog.QUERIES[name](spark, SF))
    theirs, names = rows_by_sql(catalog.ORACLE[name])
    assert cols == names
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert {r["method"] for r in __spark_entry__.entry(spark).collect()} == {"Native", "SplitCP"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
