"""Every timeline query against its SQL in DuckDB; those without SQL give rows of a stable shape."""

import pytest

from tests.compare import connect, rows_of_spark, rows_of_sql
from voxtable.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = rows_of_spark(QUERIES[name](spark, sf_dir))
    assert got[1]
    if name in SQL:
        assert got == rows_of_sql(duck, SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
