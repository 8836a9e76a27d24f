"""Every registered query against its DuckDB oracle (the driver's check) at sf0.001."""

import pytest

import __spark_entry__ as E
from tessera.plans import registry
from tessera.plans.compare import compare, duck_connect

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["page_id", "text"] and df.count() > 0


def test_every_query_has_an_oracle():
    assert set(registry.oracle_sql()) == set(NAMES) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, E.queries()[name], E.oracle_sql().get(name), SF, con)
    assert r["status"] == "match", r
