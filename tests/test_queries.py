"""Every registered query against its SQL in DuckDB, on whole tables."""

import pytest

from check import compare, duck
from curascore.catalog import REGISTRY
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    query = REGISTRY[name]
    got = query.run(spark, SF).toArrow()
    if query.sql is None:
        assert got.num_rows > 0
        return
    assert compare(got, con.sql(query.sql).to_arrow_table()) == []


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert {r["view"] for r in entry(spark).collect()} == {"main", "lab", "field"}
    assert set(oracle_sql()) <= set(queries())
