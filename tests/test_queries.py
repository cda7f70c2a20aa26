"""Every query with SQL gives what the SQL gives, columns included."""

import pytest
from conftest import canonical

from grovework.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
