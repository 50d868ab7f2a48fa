"""Every registered ledger query against its DuckDB SQL at the smallest scale."""

import pytest

from tests.oracle import agree, connect
from tidewheel import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.registered()))
def test_query_agrees_with_sql(spark, con, name):
    sql = queries.oracles().get(name)
    if sql is None:
        assert queries.registered()[name](spark, SF).columns
    else:
        agree(spark, con, SF, queries.registered()[name], sql)
