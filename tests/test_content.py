"""Closed forms, edge cases and invariances of leaves, fingerprints and prefixes."""

import random

import pytest
from pyspark.sql import functions as F

from loomtext.functions import fingerprint as fp
from loomtext.operators import identity, leaves, stats, text, timeseries, versions

TEXTS = ["", "a", "é", "日本語 テキスト 日本", "x" * 700, "   spaces   and  more ", "one two three four five six seven " * 40, "one two three four five six seven " * 40 + "eight", "tab\tand\nline ends\r\n" * 30]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)) + [(99, None)], "doc_id long, text string").cache()


def fold(data: bytes):
    return tuple(sum((b + 1) * pow(x, i, fp.MODULUS) for i, b in enumerate(data)) % fp.MODULUS for x in fp.BASES)


def test_fixed_leaves(docs):
    rows = leaves.leaves_fixed(docs, 64).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.ord)):
        assert r.byte_start == r.ord * 64 and r.n == len(r.leaf)
        by[r.doc_id] = by.get(r.doc_id, b"") + bytes(r.leaf)
    assert by == {i: (t or "").encode() for i, t in [*enumerate(TEXTS), (99, "")]}
    assert leaves.leaves_fixed(docs, 64, empty_leaf=False).filter("doc_id in (0, 99)").count() == 0


@pytest.mark.parametrize("target", [8, 96, 192])
def test_aligned_leaves_keep_tokens(docs, target):
    rows = leaves.leaves_aligned(docs, target)
    report = {r.doc_id: r for r in leaves.identity_report(docs, leaves.aligned(F.col("text"), target)).collect()}
    assert len(report) == len(TEXTS) + 1 and all(r.exact_match and r.invalid_leaves == 0 for r in report.values())
    sizes = rows.groupBy("doc_id").agg(F.collect_list("n").alias("n")).collect()
    assert all(min(r.n[:-1], default=target) >= target for r in sizes)
    assert report[4].n_leaves == 1  # no lone space: one leaf


@pytest.mark.parametrize("size", [16, 64, 256])
def test_fingerprints_do_not_depend_on_cuts(docs, size):
    hashed = identity.fingerprint_leaves(leaves.leaves_fixed(docs, size))
    got = {r.doc_id: (r.n, (r.fp1, r.fp2)) for r in identity.doc_fingerprint(hashed).collect()}
    assert got == {i: (len((t or "").encode()), fold((t or "").encode())) for i, t in [*enumerate(TEXTS), (99, "")]}


def test_lcp_bytes_at_every_place(spark):
    """Lengths and places around steps of 16 and of a block."""
    r, rows = random.Random(5), []
    for n in (0, 1, 15, 16, 17, 31, 32, 33, 47, 48, 49, 64, 70, 100):
        for at in {0, n // 2, n - 1, n, *(r.randrange(n + 1) for _ in range(4))} - {-1}:
            a = bytes(r.choices(b"ab", k=n))
            other = a[:at] + b"c" * r.choice([0, 1, 40])
            rows.append((a, other, next((i for i, (x, y) in enumerate(zip(a, other, strict=False)) if x != y), min(n, len(other)))))
    df = spark.createDataFrame([(bytearray(a), bytearray(b), k) for a, b, k in rows], "a binary, b binary, k long")
    for size in (16, 24, 32, 256):
        assert df.select(identity.lcp_bytes(F.col("a"), F.col("b"), size).alias("x"), identity.lcp_bytes(F.col("b"), F.col("a"), size).alias("y"), "k").filter("x is distinct from k or y is distinct from k").count() == 0


def test_tokens_beyond_four_bytes_keep_the_low_ones(spark):
    """As the SQL takes them: x & 255, (x >> 8) & 255 and so on."""
    values = [0, 255, 256, 2**31, 2**32 - 1, 2**32 + 7, -2]
    got = spark.createDataFrame([(values,)], "t array<long>").select(text.encode_tokens(F.col("t"))).first()[0]
    assert bytes(got) == b"".join((v % 2**32).to_bytes(4, "little") for v in values)


def test_neighbours_read_the_table_once(spark):
    """Both sides of the join come from the staged sequences, so lineitem is grouped once."""
    from loomtext.plans import content

    plan = content.neighbours(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "sequences" in plan


@pytest.mark.parametrize(("a", "b", "lcp"), [([], [], 0), ([1], [], 0), ([1, 2, 3], [1, 2, 3], 3), ([1, 2], [1, 2, 3], 2), ([9, 2], [1, 2], 0), ([1, 2, 9], [1, 2, 3], 2)])
def test_lcp_tokens(spark, a, b, lcp):
    df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    assert df.select(identity.lcp_array(F.col("a"), F.col("b"))).first()[0] == lcp
    assert df.select(text.token_offset(identity.lcp_bytes(text.encode_tokens(F.col("a")), text.encode_tokens(F.col("b"))))).first()[0] == lcp


@pytest.mark.parametrize("f", [0.0, 0.5, 0.99, 1.0])
def test_lcp_of_flipped_byte(spark, f):
    a = random.Random(3).randbytes(5000)
    at = int(f * len(a))
    b = a if f == 1.0 else a[:at] + bytes([a[at] ^ 255]) + a[at + 1 :]
    got = identity.lcp_pairs(spark.createDataFrame([(bytearray(a), bytearray(b))], "a binary, b binary")).first().lcp
    assert got == at


@pytest.mark.parametrize("pos", [0, 3, 5])
def test_negative_control(spark, pos):
    df = spark.createDataFrame([([5, 6, 7, 8, 9, 10], 6)], "t array<long>, lcp long")
    row = identity.negative_control(df, "t", "t", "lcp", F.lit(pos)).first()
    assert row.found == pos and row.detected
    with pytest.raises(Exception, match="outside the common prefix"):
        identity.negative_control(df, "t", "t", "lcp", F.lit(6)).collect()


def test_collisions_do_not_change_prefixes(spark, monkeypatch):
    """With a modulus of 7 nearly everything collides; verified bytes keep the answers exact."""
    rows = [(i, random.Random(i % 3).choice("ab") * 40 + str(i % 5) * 30) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(r.a_id, r.b_id, r.lcp) for r in identity.lcp_all_pairs(docs, 8).collect()}
    for module in (fp, identity, versions):
        monkeypatch.setattr(module, "MODULUS", 7)
    got = {(r.a_id, r.b_id, r.lcp) for r in identity.lcp_all_pairs(docs, 8).collect()}
    assert want <= got

    def lcp(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    assert all(k == lcp(dict(rows)[a], dict(rows)[b]) for a, b, k in got)


def test_tokens_round_trip(spark):
    df = spark.createDataFrame([([],), ([0, 1, 50256, 2**32 - 1],)], "t array<long>").select("t", text.encode_tokens(F.col("t")).alias("b"))
    assert [r.t for r in df.collect()] == [r.d for r in df.select(text.decode_tokens(F.col("b")).alias("d")).collect()]
    assert bytes(df.collect()[1].b)[8:12] == (50256).to_bytes(4, "little")
    with pytest.raises(Exception, match="multiple of 4"):
        spark.createDataFrame([(bytearray(b"abc"),)], "b binary").select(text.decode_tokens(F.col("b"))).collect()


@pytest.mark.parametrize("q", [0, 1, 2, 10, 1000])
def test_repeat_fingerprint(spark, q):
    unit = b"unit \xc3\xa9"
    h = fold(unit)
    row = versions.run_fingerprint(spark.createDataFrame([(len(unit), *h, q)], "n long, fp1 long, fp2 long, q long")).first()
    assert (row.n, row.fp1, row.fp2) == (len(unit) * q, *fold(unit * q))


def test_edits_delete_insert_replace(spark):
    docs = spark.createDataFrame([(1, bytearray(b"hello world")), (2, bytearray(b"same"))], "doc_id long, data binary")
    edits = spark.createDataFrame([(1, 2, 0, 0, bytearray(b"> ")), (1, 1, 5, 6, bytearray(b"")), (1, 3, 2, 1, bytearray(b"J"))], "doc_id long, step long, pos long, del_len int, ins binary")
    assert {r.doc_id: bytes(r.data) for r in versions.edit_apply(docs, edits).collect()} == {1: b"> Jello", 2: b"same"}
    assert bytes(versions.snapshot_at(docs, edits, 1).filter("doc_id = 1").first().data) == b"hello"


def test_energy_rules(spark):
    df = spark.sql("select * from values (1L, 1, timestamp'2026-01-01 00:00:00', 10d), (1L, 2, timestamp'2026-01-01 00:00:10', 20d), (2L, 1, timestamp'2026-01-01 00:00:00', 5d), (3L, 1, timestamp'2026-01-01 00:00:10', 5d), (3L, 2, timestamp'2026-01-01 00:00:00', 5d) as t(device, i, ts, watts)")
    assert {r.device: r.joules for r in timeseries.energy_trapezoid(df.filter("device < 3"), order="i").collect()} == {1: 150.0, 2: 0.0}
    with pytest.raises(Exception, match="time runs backwards"):
        timeseries.energy_trapezoid(df, order="i").collect()
    c = spark.createDataFrame([(1, 1, 500), (1, 2, 400)], "device long, at long, millijoules long")
    with pytest.raises(Exception, match="ran backwards"):
        timeseries.energy_counter(c, "at").collect()


def test_statistics_edges(spark):
    one = spark.createDataFrame([("a", 2.0), ("b", None)], "k string, value double")
    got = {r.k: r for r in stats.group_stats(one, ["k"]).collect()}
    assert got["a"].std_samp == 0 and got["b"].n_values == 0 and got["b"].mean is None
    ties = spark.createDataFrame([("t", 1.0, 1.0), ("w", 1.0, 2.0)], "k string, a double, b double")
    assert {r.k: r.p_value for r in stats.sign_test_one(ties, ["k"]).collect()} == {"t": None, "w": 0.5}
    assert {r.k: r.p_max for r in stats.sign_test_two(ties, ["k"]).collect()} == {"t": 1.0, "w": 1.0}
    flat = spark.createDataFrame([("f", 1000, 5.0), ("f", 10000, 5.0)], "arm string, n long, mean double")
    row = stats.loglog_slope(flat, ["arm"]).first()
    assert row.slope == 0 and row.r2 == 1
    clauses = spark.createDataFrame([("x", True, False), ("x", False, True), ("y", True, True), ("y", False, False), ("z", True, True)], "k string, hard boolean, ok boolean").withColumn("clause", F.lit("c"))
    assert {r.k: r.verdict for r in stats.criterion(clauses, ["k"]).collect()} == {"x": "FAILED", "y": "NOT SUPPORTED", "z": "SUPPORTED"}


def test_parsing(spark):
    df = spark.createDataFrame([(1, "1 + 2 = 3 (remaining: 3, 4)\nprose\n 1 + 2 = 3 ( remaining : 3  4 )\n\n-1.5 * 2 = -3 (remaining: -3)")], "response_id long, text string")
    got = [(r.pos, r.thought) for r in text.parse_moves(df).orderBy("pos").collect()]
    assert got == [(0, "1 + 2 = 3 (remaining: 3 4)"), (4, "-1.5 * 2 = -3 (remaining: -3)")]
    v = spark.createDataFrame([("Impossible",), ("surely",), (None,)], "t string").select(text.parse_value(F.col("t")).alias("v")).collect()
    assert [(r.v.label, r.v.score) for r in v] == [("impossible", 0), ("unparsed", 0), ("unparsed", 0)]
    g = spark.createDataFrame([(["24"],), (["48/2"],), (["24.00001"],), (["24", "1"],), ([],), (["x"],), (["1/0"],)], "n array<string>").select(text.is_goal(F.col("n")).alias("g")).collect()
    assert [r.g for r in g] == [True, True, True, False, False, False, False]


def test_match_prefix_inside_the_first_leaf(spark):
    """Every request has its longest prefix, against brute force: shared bytes below a leaf, short and empty texts too."""
    r = random.Random(4)
    stem = "".join(r.choice("abc") for _ in range(700))
    made = [stem[: r.choice([0, 1, 5, 15, 16, 17, 31, 32, 100, 255, 256, 257, 300, 600])] + "".join(r.choice("abcé") for _ in range(r.choice([0, 1, 3, 20, 300]))) for _ in range(120)]
    rows = [*enumerate(made), (120, stem[:40]), (121, stem[:40]), (122, None), (123, "zzz"), (125, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    data = {i: (t or "").encode() for i, t in rows}
    lcp = lambda x, y: next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
    want = {q: max((lcp(data[q], data[c]), -c) for c in data if c % 2 == 0) for q in data if q % 2}
    got = identity.match_prefix(d.filter("doc_id % 2 = 1"), d.filter("doc_id % 2 = 0")).collect()
    assert len(got) == len(want) and {x.doc_id: (x.lcp, -x.cached_id) for x in got} == want
    none = identity.match_prefix(d.filter("doc_id % 2 = 1"), d.limit(0)).collect()
    assert len(none) == len(want) and all(x.lcp == 0 and x.cached_id is None for x in none)


def test_many_documents_behind_one_header(spark):
    """Requests and entries that share a header of many leaves: rows of the joins are linear, so this ends soon."""
    header, r = "h" * 2560, random.Random(5)
    rows = [(i, header + "".join(r.choice("abcdef") for _ in range(360))) for i in range(2000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.cached_id, x.lcp) for x in identity.match_prefix(d.filter("doc_id % 2 = 1"), d.filter("doc_id % 2 = 0")).collect()}
    tails = sorted((t[2560:], i) for i, t in rows)
    lcp = lambda x, y: next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
    for i, t in rows[1::2][:60]:
        best = max(lcp(t[2560:], x) for x, k in tails if k % 2 == 0)
        assert got[i][1] == 2560 + best and got[i][0] == min(k for x, k in tails if k % 2 == 0 and lcp(t[2560:], x) == best)


def test_bootstrap(spark):
    """Against the same picks by hand; a constant group and a single value have no width, an empty one no row."""
    values = {"a": [3.0, 1.0, 2.0, 9.0, 4.0], "b": [5.0] * 4, "c": [7.0], "d": [None]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, value double")
    got = {x.k: x for x in stats.bootstrap_ci(df, ["k"], draws=200).collect()}
    assert set(got) == {"a", "b", "c"} and all(x.draws == 200 for x in got.values())
    assert (got["b"].lo, got["b"].hi, got["c"].lo, got["c"].hi) == (5.0, 5.0, 7.0, 7.0)
    picks = spark.range(1, 201).select(*[F.pmod(F.xxhash64(F.col("id").cast("int"), F.lit(i), F.lit(7)), F.lit(5)).alias(f"p{i}") for i in range(1, 6)]).collect()
    a = sorted(values["a"])
    medians = sorted(sorted(a[p] for p in row)[2] for row in picks)
    at = lambda q: medians[int(q * 199)] + (q * 199 % 1) * (medians[min(199, int(q * 199) + 1)] - medians[int(q * 199)])
    assert abs(got["a"].lo - at(0.025)) < 1e-9 and abs(got["a"].hi - at(0.975)) < 1e-9


def test_grid(spark):
    have = [(a, n) for a in "xy" for n in (1, 10, 100) if (a, n) != ("y", 10)]
    missing = stats.grid_coverage(spark.createDataFrame(have, "arm string, n long"), ["arm", "n"]).collect()
    assert [(r.arm, r.n) for r in missing] == [("y", 10)]
    both = spark.createDataFrame([("g", 1, 5.0, 0.0, 1.0, 0.0), ("g", 10, 5.0, 0.0, 4.0, 0.0), ("g", 100, 5.0, 0.0, 6.0, 0.0)], "k string, n long, mean_a double, std_a double, mean_b double, std_b double")
    assert [stats.grid_neighbour(both, ["k"], t).first().near for t in (1, 10, 100, 5)] == [False, True, True, None]


@pytest.mark.parametrize("text_", ["", "é", "a b", "日本 語", "x" * 3000])
def test_offsets_of_characters(spark, text_):
    rows = text.utf8_offsets(spark.createDataFrame([(1, "ä"), (2, text_), (3, None)], "doc_id long, text string")).filter("doc_id = 2").collect()
    assert [(r.i, r.byte) for r in sorted(rows, key=lambda r: r.i)] == [(i, len(text_[:i].encode())) for i in range(len(text_) + 1)]


def test_shuffle_is_a_permutation(spark):
    rows = text.seeded_shuffle(spark.range(500), "id", 42).collect()
    assert sorted(r.place for r in rows) == list(range(500)) and [r.id for r in sorted(rows, key=lambda r: r.place)] != list(range(500))


def test_size_sweep(spark):
    """One pass gives what a report for each size gives; nulls, empty texts and texts without a lone space among the rows."""
    texts = ["a few words here " * 50, "x" * 700, "é ü " * 200, "", None, " \n a  b " * 60]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.target: tuple(r)[1:] for r in leaves.size_sweep(d, [16, 128]).collect()}
    for size in (16, 128):
        rows = leaves.identity_report(d, leaves.aligned(F.col("text"), size)).collect()
        assert got[size] == (len(texts), sum(r.n_leaves for r in rows), sum(r.exact_match for r in rows))
    assert leaves.size_sweep(d.limit(0), [16]).count() == 0


def test_popular_keys_are_dealt(spark):
    """Rows that share one key are met in many tasks, each once, and rows of other keys go."""
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("k"))
    met = identity._met(rows, spark.createDataFrame([(0,), (7,)], "k int"), ["k"]).hint("merge")
    assert sorted(x.doc_id for x in met.collect()) == [i for i in range(2000) if i % 10]
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        met = identity._met(rows, spark.createDataFrame([(0,)], "k int"), ["k"])
        sizes = [x["count"] for x in met.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(sizes) == 1800 and max(sizes) < 1000


def _broadcast_rows(spark, run):
    """What run gives, and the rows of each broadcast meanwhile."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    each = lambda x: [x.apply(i) for i in range(x.size())]
    bus.waitUntilEmpty(30_000)
    old, out = {x.executionId() for x in each(store.executionsList())}, run()
    bus.waitUntilEmpty(30_000)
    rows = []
    for i in {x.executionId() for x in each(store.executionsList())} - old:
        values = store.executionMetrics(i)
        for node in each(store.planGraph(i).allNodes()):
            told = [m.accumulatorId() for m in each(node.metrics()) if m.name() == "number of output rows"] if node.name() == "BroadcastExchange" else []
            rows += [int(values.apply(m).replace(",", "")) for m in told if values.contains(m)]
    return out, rows


def test_matching_broadcasts_no_multiplied_keys(spark, monkeypatch):
    """A broadcast holds each class of requests once, whatever the places in which popular ones are met, and with more classes
    than may be broadcast the results are the same without any."""
    r = random.Random(6)
    rows = [(2 * i + k, text + tail) for i in range(150) for text in ["".join(r.choice("abcdef") for _ in range(300))] for k, tail in enumerate(("x", "yz"))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    match = lambda: {(x.doc_id, x.cached_id, x.lcp) for x in identity.match_prefix(d.filter("doc_id % 2 = 1"), d.filter("doc_id % 2 = 0")).collect()}
    got, sent = _broadcast_rows(spark, match)
    assert got == {(2 * i + 1, 2 * i, 300) for i in range(150)} and max(sent) == 150
    met = identity._met
    monkeypatch.setattr(identity, "_met", lambda *x: met(*x, most=0))
    shuffled, sent = _broadcast_rows(spark, match)
    assert shuffled == got and not any(sent)


def test_offsets_of_many_texts(spark):
    """Texts come in slices: offsets of each are its own, also behind long and empty ones."""
    texts = ["é" * 3_000_000, "", None, *["aé😀"] * 300]
    rows = text.utf8_offsets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))
    got = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("byte").alias("end"), F.sum("byte").alias("s")).collect()
    want = {i: (len(t or "") + 1, len((t or "").encode())) for i, t in enumerate(texts)}
    assert {x.doc_id: (x.n, x.end) for x in got} == want and {x.s for x in got if x.doc_id > 2} == {0 + 1 + 3 + 7}


def test_materialize_moves_bytes_as_they_are(spark):
    """Each byte of a leaf is one character on the way, not two hexadecimal digits, and every byte comes back."""
    every = bytes(range(256))
    rows = [(1, k, bytearray(every[k * 64 : k * 64 + 64])) for k in (2, 0, 3, 1)] + [(2, 0, bytearray(b""))]
    got = versions.materialize(spark.createDataFrame(rows, "doc_id long, ord int, leaf binary"))
    assert {x.doc_id: bytes(x.data) for x in got.collect()} == {1: every, 2: b""}
    assert "hex(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_block_table_is_dealt_finely(spark, monkeypatch):
    """All steps of a block table run on many small partitions, whose number adaptive execution cuts, and the setting goes back."""
    key, seen, plain = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", [], versions.stage

    def told(df, name):
        seen.append((name, spark.conf.get(key, None)))
        return plain(df, name)

    monkeypatch.setattr(versions, "stage", told)
    rows = [("s", d, p, f"t{p % 3}") for d in (1, 2) for p in range(20)]
    got = versions.block_table(spark.createDataFrame(rows, "source string, doc_id long, pos int, token string"), [8, 16], "source")
    assert seen == [("block-table", str(16 * int(spark.conf.get("spark.sql.shuffle.partitions"))))] and spark.conf.get(key, None) is None
    assert sorted(map(tuple, got.collect())) == [("s", 8, 6, 3), ("s", 16, 4, 2)]


def test_runs_of_arrays_stay_in_the_row(spark):
    """Runs of arrays are those of the same units as rows; those of lines are not shuffled."""
    from loomtext.plans import versions as plans

    r = random.Random(7)
    lists = [[r.choice(["", "a", "b", None, "long " * 50]) for _ in range(n)] for n in (1, 2, 3, 10, 200)] + [["x"] * 5000, [None] * 3, []]
    want = []
    for d, u in enumerate(lists):
        starts = [i for i in range(len(u)) if i == 0 or u[i] != u[i - 1]]
        want += [(d, i, u[i], j - i) for i, j in zip(starts, [*starts[1:], len(u)], strict=False)]
    rows = spark.createDataFrame(list(enumerate(lists)), "doc_id long, u array<string>")
    order = lambda got: sorted((tuple(x) for x in got.collect()), key=repr)
    assert order(rows.select("doc_id", F.inline(versions.array_runs(F.col("u"))))) == sorted(want, key=repr)
    assert order(versions.run_encode(rows.select("doc_id", F.posexplode("u").alias("i", "unit")), ("doc_id",), "i", "unit")) == sorted(want, key=repr)
    assert "Exchange" not in plans.line_runs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
