"""Written documents stay small however large the table is, and are read once."""

from pathlib import Path

import pytest
from comparing import DATA, rows_of, sql_rows

from loomtext.plans import sources
from loomtext.registry import QUERIES, SQL

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", ["read_cells", "read_controls"])
def test_documents_are_bounded(spark, name, monkeypatch):
    """A limit of 100 rows makes documents of about that size, one in each file, and the same result."""
    seen, read = [], getattr(sources.readers, name)
    monkeypatch.setattr(sources, "_IN_A_DOCUMENT", 100, raising=False)
    monkeypatch.setattr(sources.readers, name, lambda s, path: seen.append(path) or read(s, path))
    df = QUERIES[name](spark, str(DATA))
    assert rows_of(df) == sql_rows(SQL[name])
    files = list(Path(seen[0].removeprefix("file://")).rglob("part-*"))
    mark = '"cell_id"' if name == "read_cells" else '"dataset"'
    sizes = [f.read_text().count(mark) for f in files]
    assert sum(sizes) == spark.read.parquet(f"{DATA}/lineitem.parquet").count() and max(sizes) < 200
    if name == "read_controls":  # a value read as a string costs a JSON scan a read of the file
        assert "FileScan json" not in df._jdf.queryExecution().toString()
