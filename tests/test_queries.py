"""Every query against its SQL on the smallest tables."""

import pytest

from causeway import registry
from compared import agrees


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(name, spark, duck, sf_dir):
    agrees(spark, duck, registry.QUERIES[name], registry.ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() >= 0


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
