"""Stateful streams over batches out of order, late rows, repeats, and restarts from the checkpoint."""

import datetime
import random
import types
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtext.functions import fingerprint as fp
from loomtext.functions.tables import new_path
from loomtext.operators import versions
from loomtext.streaming import jobs


def fold(data: bytes):
    return tuple(sum((b + 1) * pow(x, i, fp.MODULUS) for i, b in enumerate(data)) % fp.MODULUS for x in fp.BASES)


def arrive(spark, path, batches, schema):
    """Each batch as one file, in order."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return jobs.file_stream(spark, path, spark.createDataFrame([], schema).schema)


def test_turns_out_of_order(spark):
    """Turns come late, twice and in three batches; what each batch gives out is exactly what has become complete."""
    lines = {c: [f"c{c} turn {t} é" for t in range(6)] for c in (1, 2)}
    batches = [[(1, 3, lines[1][3]), (1, 0, lines[1][0]), (2, 5, lines[2][5])], [(1, 1, lines[1][1]), (1, 0, "again"), (2, 0, lines[2][0]), (2, 1, None)], [(1, 2, lines[1][2]), (1, 3, "again"), (2, 2, lines[2][2])]]
    stream = arrive(spark, new_path(spark, "turns"), batches, "conv_id long, turn long, line string")
    got = spark.read.parquet(jobs.drain(jobs.context_fingerprint(stream), "append")).collect()
    lines[2][1] = ""
    want = {(0, 1, 0), (1, 1, 1), (1, 2, 0), (1, 2, 1), (2, 1, 2), (2, 1, 3), (2, 2, 2)}
    assert {(x.batch, x.conv_id, x.turn) for x in got} == want and len(got) == len(want)
    for x in got:
        data = "".join(lines[x.conv_id][: x.turn + 1]).encode()
        assert (x.n_bytes, x.fp1, x.fp2) == (len(data), *fold(data))


EDITS = "doc_id long, step long, pos long, del_len long, ins binary, to long, data binary"


def edits_of(r, n_docs):
    docs, rows = {}, []
    for i in range(n_docs):
        n = r.choice([0, 5, 300, 70_000])
        docs[i] = r.randbytes(n)
        for s in range(1, 13):
            pos = r.randint(0, n)
            cut = min(r.choice([0, 1, 40, 500]), n - pos)
            ins = r.randbytes(r.choice([0, 2, 30, 400]))
            to = r.randint(0, n - cut + len(ins)) if r.random() < 0.3 else None
            n += len(ins) - (cut if to is None else 0)
            rows.append((i, s, pos, cut, bytearray(ins), to, bytearray(docs[i]) if s == 1 else None))
    return docs, rows


def test_edits_that_empty_a_document(spark):
    """A batch ends with an empty document; the next one begins from nothing, not from what was there before."""
    batches = [[(1, 1, 0, 2, b"", None, b"abcdef")], [(1, 2, 0, 4, b"", None, None)], [(1, 3, 0, 0, b"xyz", None, None)], [(1, 4, 3, 0, b"!", None, None)]]
    stream = arrive(spark, new_path(spark, "edits"), batches, EDITS)
    got = sorted((x.step, x.n, x.fp1, x.fp2) for x in spark.read.parquet(jobs.drain(jobs.edit_identity(stream, 1), "append")).collect())
    assert got == [(s, len(data), *fold(data)) for s, data in enumerate((b"cdef", b"", b"xyz", b"xyz!"), 1)]


def test_edits_out_of_order_and_restarted(spark):
    """Inserts, deletes and moves in three batches, shuffled, some twice; the stream stops after each batch and goes on from
    its checkpoint. Results equal those of the batch operator."""
    r = random.Random(3)
    docs, rows = edits_of(r, 12)
    r.shuffle(rows)
    third = len(rows) // 3
    batches = [rows[:third], rows[third : 2 * third] + rows[:9], rows[2 * third :] + rows[:5]]
    path, out, state = (new_path(spark, x) for x in ("edits", "out", "state"))
    for batch in batches:
        jobs.drain(jobs.edit_identity(arrive(spark, path, [batch], EDITS), 3), "append", out=out, state=state)
    got = sorted((x.doc_id, x.step, x.n, x.fp1, x.fp2) for x in spark.read.parquet(out).collect())
    d = spark.createDataFrame([(i, bytearray(x)) for i, x in docs.items()], "doc_id long, data binary")
    e = spark.createDataFrame([x[:6] for x in rows], EDITS.rsplit(",", 1)[0])
    assert got == sorted(tuple(x) for x in versions.edit_identity(d, e, 3).collect()) and len(got) == 48


def test_edit_outside_ends_the_stream(spark):
    stream = arrive(spark, new_path(spark, "edits"), [[(1, 1, 6, 0, bytearray(b"x"), None, bytearray(b"hello"))]], EDITS)
    with pytest.raises(Exception, match="outside of a document|STREAM_FAILED|FOREACH_BATCH"):
        jobs.drain(jobs.edit_identity(stream, 1), "append")


def test_energy_of_unordered_and_late_samples(spark):
    """Within the watermark any order gives the sums of the sorted samples; what comes more than an hour late is dropped."""
    start = datetime.datetime(2026, 1, 1)
    at = lambda minutes: start + datetime.timedelta(minutes=minutes)
    r = random.Random(4)
    samples = [(d, at(m), float(r.randint(1, 50))) for d in (1, 2) for m in (0, 7, 15, 21, 33, 40, 41, 55)]
    first, later = samples[::2], samples[1::2]
    r.shuffle(first)
    batches = [first, [*later, samples[0], (3, at(50), 9.0)], [(1, at(300), 4.0), (2, at(301), None)], [(1, at(100), 99.0), (3, at(310), 11.0), (1, at(290), 6.0)], [(2, at(320), 8.0)]]
    stream = arrive(spark, new_path(spark, "samples"), batches, "device long, ts timestamp, watts double")
    rows = spark.read.parquet(jobs.drain(jobs.energy_parts(stream), "append")).collect()
    got = defaultdict(float)
    for x in rows:
        got[x.device, x.ts] += x.joules
    kept = sorted([*samples, (3, at(50), 9.0), (1, at(300), 4.0), (3, at(310), 11.0), (1, at(290), 6.0), (2, at(320), 8.0)])  # 99 W at minute 100 is late
    want = {(d, t): (w + v) / 2 * (t - s).total_seconds() for (d0, s, v), (d, t, w) in zip(kept, kept[1:], strict=False) if d0 == d}
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}
    assert len(rows) > len(want)  # intervals that were split had been booked before


def test_growing_cache_restarts(spark):
    """Requests see entries of earlier batches only, the smallest id of the longest prefix; state outlives a restart."""
    r = random.Random(5)
    parts = ["".join(r.choice("ab") for _ in range(64)) for _ in range(4)]
    text = lambda: "".join(r.choice(parts) for _ in range(r.randint(0, 4))) + "x" * r.choice([0, 5])
    batches = [[(100 * b + i, text() if i else None, r.random() < 0.5) for i in range(40)] for b in range(4)]
    path, out, state = (new_path(spark, x) for x in ("arrivals", "out", "state"))
    for batch in batches:
        stream = arrive(spark, path, [batch], "doc_id long, text string, asks boolean")
        jobs.drain(jobs.growing_cache(stream, 64), "append", lambda b: jobs.longest(b, 64), out=out, state=state)
    got = {x.doc_id: (x.batch, x.cached_id, x.lcp) for x in spark.read.parquet(out).collect()}
    want, cache = {}, {}
    for b, batch in enumerate(batches):
        for i, t, asks in batch:
            t = t or ""
            known = [64 * k for k in range(len(t) // 64 + 1) if t[: 64 * k] in cache]
            if asks and known:
                want[i] = (b, cache[t[: max(known)]], max(known))
        for i, t, asks in batch:
            for k in range(0 if asks else len(t or "") // 64 + 1):
                cache[(t or "")[: 64 * k]] = min(i, cache.get((t or "")[: 64 * k], i))
    assert got == want and max(x[2] for x in want.values()) >= 128
    assert spark.read.parquet(out).groupBy("doc_id").count().filter(F.col("count") > 1).count() == 0


class Counted:
    """A value or map state in memory that counts how often it is asked."""

    def __init__(self, calls):
        self.calls, self.held = calls, {}

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            return {
                "exists": lambda: bool(self.held), "get": lambda: self.held.get(()), "update": lambda v: self.held.update({(): v}), "iterator": lambda: iter(list(self.held.items())),
                "containsKey": lambda k: k in self.held, "getValue": lambda k: self.held.get(k), "updateValue": lambda k, v: self.held.update({k: v}), "removeKey": lambda k: self.held.pop(k, None),
            }[name](*args)

        return call


def counted(processor):
    """The processor with states in memory, and the list of calls to them."""
    calls = []
    new = lambda *_: Counted(calls)
    processor.init(types.SimpleNamespace(getValueState=new, getMapState=new, getListState=new, registerTimer=lambda at: None))
    return processor, calls


def test_state_is_asked_once_for_a_devices_samples():
    """Calls to the state do not grow with the samples of a batch, and the sums are those of the sorted ones."""
    energy, calls = counted(jobs._EnergyState(3_600_000))
    at = lambda micros: types.SimpleNamespace(getCurrentWatermarkInMs=lambda: micros // 1000)
    stamps, watts = np.arange(4000) * 1_000_000, np.arange(4000) % 7 + 1.0
    order = np.random.default_rng(1).permutation(4000)
    got = 0.0
    for part in (order[:2000], order[2000:]):
        rows = [(1, None, int(stamps[i]), float(watts[i])) for i in part]
        got += sum(x.joules for x in energy.handleInputRows((1,), iter(rows), at(0)))
    assert len(calls) <= 8 and got == pytest.approx(((watts[1:] + watts[:-1]) / 2).sum())
    list(energy.handleExpiredTimer((1,), at(10**12), None))
    assert len(energy._known()) == 1


def test_early_turns_wait_in_one_value():
    """Turns that come in the wrong batch cost no call each; those beyond a block are entries of a map, and none is lost."""
    lines = [f"turn {t} é" * 3 for t in range(400)]
    context, calls = counted(jobs._ContextState())
    got = []
    for part in (range(1, 400, 2), [399, 0], range(2, 400, 2)):
        got += [tuple(x) for x in context.handleInputRows((5,), iter([(5, t, lines[t]) for t in part]), None)]
    data = "".join(lines).encode()
    assert [x[1] for x in got] == list(range(400)) and got[-1] == (5, 399, len(data), *fold(data)) and len(calls) <= 8
    long = ["x" * 9000 + str(t) for t in range(8)]
    context, calls = counted(jobs._ContextState())
    got = []
    for part in ([7, 6, 5], [4, 3, 2, 7], [1], [0]):
        got += [tuple(x) for x in context.handleInputRows((5,), iter([(5, t, long[t]) for t in part]), None)]
    assert [x[1] for x in got] == list(range(8)) and got[-1][2:] == (len("".join(long)), *fold("".join(long).encode())) and "updateValue" in calls


def test_prefixes_of_one_bucket_are_looked_up_once():
    """All prefixes of a bucket are entries of one map: a prefix is read once a batch, however many ask for it."""
    cache, calls = counted(jobs._PrefixState())
    frame = lambda put: pd.DataFrame({"k": [1, 1, 2], "fp1": [10, 11, 12], "fp2": [20, 21, 22], "put": [put, None, put], "asks": [[7, 9], [8], []]})
    assert not list(cache.handleInputRows((0,), iter([frame(4), frame(3)]), None))
    calls.clear()
    (got,) = cache.handleInputRows((0,), iter([frame(2)]), None)
    assert [tuple(x) for x in got.itertuples(index=False)] == [(7, 1, 3), (9, 1, 3)] and calls.count("getValue") == 2
    (got,) = cache.handleInputRows((0,), iter([frame(None)]), None)
    assert [tuple(x) for x in got.itertuples(index=False)] == [(7, 1, 2), (9, 1, 2)]


def test_neighbours_under_edit_share_one_value():
    """State calls do not grow with the documents of a key; what does not fit its block is an entry of a map and comes back."""
    r = random.Random(6)
    edit, calls = counted(jobs._EditState(1))
    docs, want, got = {i: r.randbytes(40) for i in range(16)}, [], []
    batches = [[], [], []]
    for i, data in docs.items():
        for s in range(1, 7):
            at = 0 if s % 2 else len(data)
            cut = 0 if s < 6 or i > 2 else len(data)
            ins = b"x" * (9000 if i % 3 == 0 and s == 2 else s)
            batches[r.randrange(3)].append((i, s, at - cut, cut, ins, None, docs[i] if s == 1 else None, i // 16))
            data = data[: at - cut] + ins + data[at:]
            want.append((i, s, len(data), *fold(data)))
    for k, batch in enumerate(batches):
        r.shuffle(batch)
        calls.clear()
        got += [tuple(x) for x in edit.handleInputRows((0,), iter(batch), None)]
        assert calls.count("get") == calls.count("update") == 1 and len(calls) < 16
    assert sorted(got) == want
    small, calls = counted(jobs._EditState(1))
    assert len(list(small.handleInputRows((0,), iter([(i, 1, 0, 0, b"a", None, b"text", 0) for i in range(16)]), None))) == 16 and calls == ["get", "update"]
