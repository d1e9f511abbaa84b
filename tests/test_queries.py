import pytest

import __spark_entry__
from siftlake.plans import diff_queries, export_queries, finding_queries, stored_queries, warehouse_queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"
REGISTRIES = [warehouse_queries, diff_queries, finding_queries, export_queries, stored_queries]
NAMES = [(r, n) for r in REGISTRIES for n in r.QUERIES if n in r.ORACLE_SQL]
#: Where no row is a fine answer on these tables.
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="session")
def con():
    return connect(SF)


@pytest.mark.parametrize("registry, name", NAMES, ids=[n for _, n in NAMES])
def test_same_rows_as_sql(spark, con, registry, name):
    n = compare(registry.QUERIES[name](spark, SF), con, registry.ORACLE_SQL[name])
    assert n or name in MAY_BE_EMPTY


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(n for r in REGISTRIES for n in r.QUERIES if n not in r.ORACLE_SQL))
def test_queries_without_sql_give_rows(spark, name):
    registry = next(r for r in REGISTRIES if name in r.QUERIES)
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
