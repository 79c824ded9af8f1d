import pytest

from spanloom.plans import catalogue
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, name):
    df = catalogue.QUERIES[name](spark, small)
    if name in catalogue.ORACLE:
        same(df, catalogue.ORACLE[name], connect(small))
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES)


def test_entry_without_the_language_package():
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries())
