"""Queries against their SQL on tables whose keys have gaps."""

import shutil

import pytest
from comparing import DATA, rows_of, sql_rows

from loomtext.registry import QUERIES, SQL

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def gaps(tmp_path_factory):
    """The smallest tables; of the documents some bases, some forks and the end of the last ten are missing."""
    import duckdb

    folder = tmp_path_factory.mktemp("gaps")
    for f in DATA.glob("*.parquet"):
        shutil.copyfile(f, folder / f.name)
    duckdb.sql(f"COPY (SELECT * FROM '{DATA}/documents.parquet' WHERE doc_id NOT IN (20, 34, 35, 41, 50, 59) AND doc_id < 72) TO '{folder}/documents.parquet'")
    return folder


@pytest.mark.parametrize("name", ["fork_sharing", "fork_chains"])
def test_forks_with_gaps(spark, gaps, name, monkeypatch):
    monkeypatch.setattr("comparing.DATA", gaps)
    assert rows_of(QUERIES[name](spark, str(gaps))) == sql_rows(SQL[name])
