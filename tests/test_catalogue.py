import pytest
from compare import duck_rows, spark_rows

from roadpulse.plans.catalogue import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, name):
    names, rows = spark_rows(queries()[name](spark, SF))
    assert rows
    if sql := oracle_sql().get(name):
        want_names, want = duck_rows(sql, SF)
        assert names == want_names
        assert rows == want, (list((rows - want).items())[:3], list((want - rows).items())[:3])
