"""Every query of the engine against its SQL, and the driver's entry points."""

import pytest

from starling.plans.oracle import ORACLE
from starling.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, same_as_sql, name):
    same_as_sql(QUERIES[name](spark, SF), ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    rows = e.entry(spark).collect()
    assert len(rows) == 500 and {r.label for r in rows} <= set(range(10))
