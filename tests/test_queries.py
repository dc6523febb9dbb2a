"""Every core query on the smallest tables, against its SQL."""

from pathlib import Path

import pytest

from palimpsest.plans import queries
from tests.oracle_check import compare

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the test tables")
SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    query = queries.queries()[name]
    if name in SQL:
        assert compare(spark, SMALL, name, query, SQL[name]) == ""
    else:
        assert query(spark, SMALL).count() > 0


def test_every_sql_has_its_query():
    assert set(SQL) <= set(queries.queries())
