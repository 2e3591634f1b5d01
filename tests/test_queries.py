"""Every query of the library against its SQL on the smallest tables."""

import pytest
from comparing import DATA, rows_of, sql_rows

from loomtext.registry import QUERIES, SQL

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    cols, got = rows_of(QUERIES[name](spark, str(DATA)))
    if name in SQL:
        want_cols, want = sql_rows(SQL[name])
        assert cols == want_cols
        assert got == want
    else:
        assert got


def test_entry_module():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(SQL) <= set(s) <= set(q)
