import os

import pytest

from nubes.plans.compare import mismatch
from nubes.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert mismatch(spark, QUERIES[name], SQL[name], DATA) == ""


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
