"""Run a query and its SQL on the same tables and compare the rows."""

import datetime
import decimal
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return [plain(x) for x in v]
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(repr([plain(x) for x in r]) for r in df.select(*[f"`{c}`" for c in cols]).collect())


def sql_rows(sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    cols = sorted(names)
    return cols, sorted(repr([plain(row[names.index(c)]) for c in cols]) for row in r.fetchall())
