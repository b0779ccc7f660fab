"""Every query of the library proper gives rows, and those of its SQL where it has one."""

import pytest
from helpers import same_rows

from lacuna.plans import catalog

NAMES = sorted(catalog.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, duck, name):
    df, sql = catalog.queries()[name](spark, data), catalog.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert same_rows(df, duck, sql)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
