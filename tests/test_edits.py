"""Piece tables against plain bytes: inserts, deletes, replacements and moves of any length."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loomtext.functions import fingerprint as fp
from loomtext.operators import edits, versions

EDITS = "doc_id long, step long, pos long, del_len long, ins binary, to long"


def fold(data: bytes):
    return tuple(sum((b + 1) * pow(x, i, fp.MODULUS) for i, b in enumerate(data)) % fp.MODULUS for x in fp.BASES)


def plain(data, pos, n, ins, to):
    cut, data = data[pos : pos + n], data[:pos] + ins + data[pos + n :]
    return data if to is None else data[:to] + cut + data[to:]


def made(r, n, steps):
    """Edits of a document of n bytes."""
    out = []
    for s in range(1, steps + 1):
        pos = r.randint(0, n)
        cut = r.choice([0, 0, 1, 5, 300, 10_000, n])
        cut = min(cut, n - pos)
        ins = r.randbytes(r.choice([0, 0, 1, 3, 40, 700]))
        to = r.randint(0, n - cut + len(ins)) if r.random() < 0.3 else None
        out.append((s, pos, cut, ins, to))
        n += len(ins) - (cut if to is None else 0)
    return out


def test_edits_and_fingerprints(spark):
    r = random.Random(1)
    docs = [(i, r.randbytes(r.choice([0, 1, 255, 256, 257, 1000, 5000]))) for i in range(60)] + [(60, None), (61, b"untouched")]
    steps = {i: made(r, len(d or b""), r.choice([1, 2, 10, 60])) for i, d in docs if i < 61}
    rows = [(i, s, p, n, bytearray(ins) if ins else r.choice([None, bytearray()]), to) for i, es in steps.items() for s, p, n, ins, to in es]
    r.shuffle(rows)
    d = spark.createDataFrame([(i, None if x is None else bytearray(x), "mine") for i, x in docs], "doc_id long, data binary, step string")
    e = spark.createDataFrame(rows, EDITS)
    want, prints, at3 = {}, {}, {}
    for i, x in docs:
        now = x or b""
        for k, (s, *edit) in enumerate(steps.get(i, ()), 1):
            now = plain(now, *edit)
            if k % 2 == 0:
                prints[i, s] = (len(now), *fold(now))
            if s <= 3:
                at3[i] = now
        want[i] = now
    assert {x.doc_id: bytes(x.data) for x in versions.edit_apply(d, e).collect()} == want
    assert {(x.doc_id, x.step): (x.n, x.fp1, x.fp2) for x in versions.edit_identity(d, e, 2).collect()} == prints
    assert {x.doc_id: bytes(x.data) for x in versions.snapshot_at(d, e, 3).collect()} == {61: b"untouched", **at3}
    for x in edits.edit_pieces(d, e).collect():
        assert x.kept_bytes + x.new_bytes == len(want[x.doc_id]) and x.kept_bytes <= x.base_bytes
    assert versions.edit_apply(d.limit(0), e).count() == versions.edit_identity(d, e.limit(0), 1).count() == 0


@pytest.mark.parametrize(("pos", "n", "to"), [(-1, 0, None), (0, 6, None), (6, 0, None), (3, 3, None), (0, 2, 5), (0, 2, -1), (2, -1, None)])
def test_positions_outside(spark, pos, n, to):
    d = spark.createDataFrame([(1, bytearray(b"hello"))], "doc_id long, data binary")
    e = spark.createDataFrame([(1, 1, pos, n, bytearray(b"x") if to is None else None, to)], EDITS)
    for run in (lambda: versions.edit_apply(d, e), lambda: versions.edit_identity(d, e, 1)):
        with pytest.raises(Exception, match="outside of a document"):
            run().collect()


def test_ten_thousand_edits_of_a_long_document():
    """10,000 edits of 10 MB, a fingerprint after each tenth: pieces, not copies, so this ends in seconds."""
    r = random.Random(2)
    data = r.randbytes(10_000_000)
    table, n, began = edits.PieceTable(data), len(data), time.time()
    for k in range(10_000):
        pos, cut, ins = r.randint(0, n - 100), r.randint(0, 32), r.randbytes(r.randint(0, 32))
        table.edit(pos, cut, ins)
        n += len(ins) - cut
        if k % 10 == 9:
            table.fingerprint()
    assert time.time() - began < 60 and len(table) == n
    now = table.content()
    got = fp.hash_blocks(*fp.byte_values(__import__("pyarrow").array([now])))
    assert table.fingerprint() == (n, int(got[0, 0]), int(got[1, 0]))


def test_long_list_in_one_row(spark):
    """A document's edits in many steps, out of order in the table."""
    e = spark.range(1, 3001).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("step"), (F.col("id") * 7919 % (F.col("id"))).alias("pos"), F.lit(0).cast("long").alias("del_len"), F.encode(F.char(97 + F.col("id") % 26), "UTF-8").alias("ins"))
    d = spark.createDataFrame([(1, bytearray(b""))], "doc_id long, data binary")
    now = b""
    for i in range(1, 3001):
        at = i * 7919 % i
        now = now[:at] + bytes([97 + i % 26]) + now[at:]
    assert bytes(versions.edit_apply(d, e.orderBy(F.desc("step"))).first().data) == now


def test_fingerprints_of_sources_by_byte_and_by_leaf():
    """Every prefix of a source, short or long, and shifts by any exponent, as single sums give them."""
    r = random.Random(6)
    for n in (0, 1, 48, 49, 5000, (1 << 16) + 700):
        data = r.randbytes(n)
        source = edits.Source(data)
        for at in {0, n, n // 2, max(0, n - 1), *(r.randint(0, n) for _ in range(5))}:
            assert source.upto(at) == tuple(int(x[0]) for x in fp.hash_blocks(*fp.byte_values(__import__("pyarrow").array([data[:at]]))))
    for by in (0, 1, -1, 1 << 16, -(1 << 16), (1 << 16) + 1, -(1 << 40)):
        assert edits._shifts(by) == tuple(pow(x, by, fp.MODULUS) for x in fp.BASES)


def test_slices_hold_few_documents(spark):
    """A task takes its documents in slices, whatever the size of the batch that Spark hands it."""
    batch = __import__("pyarrow").RecordBatch.from_pydict({"data": [b"x" * (5 << 20), b"", *[b"abc"] * 600, None]})
    parts = list(fp.slices([batch], "data"))
    assert [x for p in parts for x in p.column("data").to_pylist()] == batch.column("data").to_pylist()
    assert max(map(len, parts)) == 256 and len(parts[0]) == 1
