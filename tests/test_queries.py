from __future__ import annotations

import pytest

import __spark_entry__ as entry
from contrail import plans
from contrail.plans.compare import differences


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_against_oracle(spark, sf, name):
    said = differences(spark, sf, plans.QUERIES[name], plans.ORACLE_SQL[name])
    if said == "no rows":  # the smallest tables have none; the next ones must
        said = differences(spark, sf.replace("0.001", "0.01"), plans.QUERIES[name], plans.ORACLE_SQL[name])
    assert said == "", said


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
