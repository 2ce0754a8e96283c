"""Every registered query of the library against its SQL twin; those without one are held against brute force elsewhere."""

import pytest
from differential import differences, duck

from contactmill.plans import catalogue


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, con, name):
    df = catalogue.QUERIES[name](spark, sf)
    if name in catalogue.SQL:
        assert differences(df, con, catalogue.SQL[name]) == []
    else:
        assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_entry_imports_without_session():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
