"""Every registered query against its SQL on the driver's tables."""

import pytest

import __spark_entry__ as contract
from terrastat.plans.catalog import QUERIES
from terrastat.plans.oracle import ORACLE_SQL
from compare import canonical, oracle_connection, oracle_result, spark_result

SF_DIR = "/root/testdata/sf0.01"
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, oracle, name):
    df = contract.queries()[name](spark, SF_DIR)
    expected = oracle_result(oracle, contract.oracle_sql()[name])
    oracle_types = {c[0]: str(c[1]) for c in oracle.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == oracle_types
    assert spark_result(df) == expected
    assert expected[1], "a query without rows proves nothing"


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert df.columns == ["Provincia", "Departamento", "Cantidad_ee", "Cantidad_cc", "Personas"]
    assert df.count() > 0


def test_comparison_tells_differences():
    assert canonical(["a", "b"], [(1, None)]) == canonical(["b", "a"], [(None, 1)])
    assert canonical(["a"], [(1,)]) != canonical(["a"], [(1,), (1,)])
    assert canonical(["a"], [(1.0,)]) != canonical(["a"], [(1,)])
