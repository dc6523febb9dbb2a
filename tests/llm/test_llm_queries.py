"""Every query of the subpackage on the smallest tables, against its SQL where there is one."""

from pathlib import Path

import pytest

from palimpsest.llm import queries
from tests.oracle_check import compare

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the test tables")
SQL = queries.oracle_sql()
FOUND = {1: ["message_id", "defect"], 2: ["src", "item_key", "kind"], 3: ["src", "item_key", "line_no"], 4: ["seq_a", "seq_b"], 5: ["seq_a", "seq_b"], 6: ["src", "item_key", "cut_kind"], 7: ["file_id"], 8: ["doc_id"], 9: ["doc_id", "item_id"], 10: ["doc_id", "subject"]}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    query = queries.queries()[name]
    if name in SQL:
        assert compare(spark, SMALL, name, query, SQL[name]) == ""
        return
    rows = query(spark, SMALL)
    got = rows.collect()
    if name.endswith("_found"):
        assert rows.columns == FOUND[int(name[1:-6])] and len(set(got)) == len(got)
