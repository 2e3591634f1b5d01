"""Rules, exact deduplication, mixing and packing: edge cases and brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from itertools import combinations, combinations_with_replacement

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import exact_dedup, mixing, packing, quality_rules
from loomtext.llm.common import picked, rows_of, stage_at

SCHEMA = "doc_id long, text string, source string, n_tokens string, size string, kept string"
ROWS = [
    (1, "a b c", "x", "e", "e", "e"), (2, None, None, None, None, None), (3, "", "x", "e", "e", "e"), (4, " a\tb\x0bc \n", "y", "e", "e", "e"), (5, "abc", "y", "e", "e", "e"),
    (5, "abc", "y", "e", "e", "e"), (6, "word " * 5000, "z", "e", "e", "e"), (None, "abc", "z", "e", "e", "e"), (7, "ABC", "", "e", "e", "e"), (8, "é è", "y", "e", "e", "e"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def squeeze(t):
    return "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")


def test_exact_groups(docs):
    rows = exact_dedup.exact_groups(docs).collect()
    assert len(rows) == len(ROWS)
    groups = defaultdict(list)
    for r in ROWS:
        groups[hashlib.sha256(squeeze(r[1]).encode()).hexdigest()].append(r)
    for sha, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        mine = [r for r in rows if r.text_sha256 == sha]
        assert {r.keep_id for r in mine} == {best[0]} and {r.group_size for r in mine} == {len(members)}
        assert sum(r.kept for r in mine) == 1 and [r.doc_id for r in mine if r.kept] == [best[0]]


def test_exact_keeps_one_row_each(docs, none):
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter(squeeze(r.text) for r in kept.collect()) == Counter({squeeze(r[1]) for r in ROWS})
    assert exact_dedup.keep_first(none).count() == 0 and exact_dedup.exact_groups(none).count() == 0


def test_state_spans_batches(spark, docs):
    """Copies that arrive in different micro-batches meet in the state."""
    from loomtext.llm.common import rows_of, stage_at

    rows = rows_of(docs)
    keys = rows.select("row.doc_id", exact_dedup._digest(F.col("row.text")).alias("digest"), F.length(F.coalesce("row.text", F.lit(""))).alias("n_points"), "at")
    staged, path = stage_at(keys.repartition(4), "keys")
    one = exact_dedup.keyed_state(staged, path, files_per_batch=1)
    assert one.agg(F.sum("group_size")).first()[0] == len(ROWS) and one.count() == 5


def test_digest_clash_splits_the_group(spark):
    """With the parity of the length as digest nearly all texts clash; full bytes keep the groups right."""
    r = random.Random(8)
    rows = [(i, r.choice(["a", "b", "c d", "cd", "e" * 40, None, ""])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bit = lambda text: F.encode((F.length(exact_dedup.normalised(text)) % 2).cast("string"), "UTF-8")
    got = {x.doc_id: (x.keep_id, x.group_size, x.kept) for x in exact_dedup.exact_groups(docs, digest=bit).collect()}
    want = {x.doc_id: (x.keep_id, x.group_size, x.kept) for x in exact_dedup.exact_groups(docs).collect()}
    assert got == want and len({k for k, _, _ in want.values()}) == 5
    assert {x.doc_id for x in exact_dedup.keep_first(docs, digest=bit).collect()} == {k for k, _, _ in want.values()}


@pytest.mark.parametrize("hot", [3, 1000])
def test_bytes_are_checked_against_the_keeper(spark, hot):
    """Only digests with differing texts are told, in groups dealt over copies of the keeper's text as in others; no text
    is an aggregate's value, which would be sorted."""
    rows = [(i, f"{i % 7} text") for i in range(70)] + [(100 + i, "odd" if i == 17 else "even") for i in range(40)] + [(200, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same = lambda text: F.encode(F.when(text.isin("odd", "even"), F.lit("x")).otherwise(exact_dedup.normalised(text)), "UTF-8")
    held = rows_of(docs)
    keys = held.select("row.doc_id", same(F.col("row.text")).alias("digest"), F.length("row.text").alias("n_points"), "at")
    groups = stage_at(keys.groupBy("digest").agg(*exact_dedup._group()), "groups")[0]
    bad = exact_dedup.clashes(held, keys, groups, digest=same, hot=hot)
    assert [bytes(r.digest) for r in bad.collect()] == [b"x"]
    assert "SortAggregate" not in bad._jdf.queryExecution().executedPlan().toString()


def test_places_are_picked_in_blocks(spark):
    """A list of ten times what a filter holds: nothing is missed and hardly anything else passes."""
    rows = rows_of(spark.range(0, 40_000, 1, 40).withColumnRenamed("id", "doc_id"))
    listed = stage_at(rows.filter("row.doc_id % 2 = 0").select("at"), "listed")[0]
    got = [r.doc_id for r in picked(rows, listed, most=2000).select("row.doc_id").collect()]
    assert len(got) == len(set(got)) and set(range(0, 40_000, 2)) <= set(got)
    assert len(got) < 21_000


def test_ids_of_any_kind(spark):
    """Strings, the least long and repeated ids whose texts differ in white space only."""
    named = spark.createDataFrame([("b", "x y"), ("a", "xy"), ("c", "z"), (None, "z")], "doc_id string, text string")
    assert {(x.doc_id, x.keep_id) for x in exact_dedup.exact_groups(named).collect()} == {("b", "b"), ("a", "b"), ("c", "c"), (None, "c")}
    low = spark.createDataFrame([(-(2**63), "q"), (5, "q")], "doc_id long, text string")
    assert {x.keep_id for x in exact_dedup.exact_groups(low).collect()} == {-(2**63)}
    same = spark.createDataFrame([(1, "ab"), (1, "a b")], "doc_id long, text string")
    assert [x.text for x in exact_dedup.keep_first(same).collect()] == ["a b"]


CLASHES = "row string, at long, _k string, _kn string, _sha string, _gid string, _id string, digest string, node long, root string, shard string, seed string, local string, d string, gone string, n_given string"


def test_columns_of_any_name(spark):
    """Working columns meet no column of the user's; all come back as they were."""
    names = [c.split()[0] for c in CLASHES.split(", ")]
    values = [7 if c.endswith("long") else "mine" for c in CLASHES.split(", ")]
    good = " ".join(f"w{i} v{i % 17}" for i in range(60))
    df = spark.createDataFrame([(i, f"{good} {i % 2}", "s", *values) for i in range(4)], f"doc_id long, text string, source string, {CLASHES}")
    from loomtext.llm import line_dedup, ngram_join

    for f in (quality_rules.keep_good, exact_dedup.keep_first, ngram_join.keep_one, line_dedup.clean, mixing.mixed, packing.pack):
        out = f(df)
        assert out.columns[: len(df.columns)] == df.columns
        rows = out.collect()
        assert rows and all([x[c] for c in names] == values for x in rows), f


def test_long_lists_of_rows(spark, monkeypatch):
    """Lists too long for a broadcast: the same rows by Bloom filters and shuffled joins."""
    from loomtext.functions import tables
    from loomtext.llm import common, line_dedup, ngram_join

    r = random.Random(6)
    base = [" ".join(r.choice("abcdefgh") * 3 + str(r.randrange(50)) for _ in range(90)) for _ in range(8)]
    rows = [(i, r.choice(base) + r.choice(["", " tail", "\n" + base[0]]), f"s{i % 3}") for i in range(80)] + [(None, "junk", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    make = lambda: [sorted(map(repr, f(df).collect())) for f in (quality_rules.keep_good, exact_dedup.keep_first, ngram_join.keep_one, line_dedup.clean, mixing.report)]
    want = make()
    for module in (tables, common, ngram_join):
        monkeypatch.setattr(module, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(tables.join_checked, "__defaults__", ("inner", -1))
    assert make() == want


def measures(t):
    t = t or ""
    w = t.encode().split()
    w = [x.decode() for x in w]
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(w), len(squeeze(t)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(marked)


def test_rule_measures(spark, docs, none):
    r = random.Random(5)
    extra = [(100 + i, r.choice([" ", "\n"]).join(r.choice(["a", "b", "c#", "d|", "\n", "ee"]) for _ in range(r.randint(0, 60))), "h", None, None, None) for i in range(60)]
    both = docs.union(spark.createDataFrame(extra, SCHEMA))
    rows = quality_rules.report(both).collect()
    assert Counter((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in rows) == Counter((x[0], *measures(x[1])) for x in [*ROWS, *extra])
    assert all(x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words) and not (x.base_failed and x.kept) for x in rows)
    assert quality_rules.report(none).count() == 0 and quality_rules.keep_good(none).count() == 0


def test_host_verdicts(spark):
    """A host of junk takes a fair document with it; a small host is not judged by one failure."""
    r = random.Random(1)
    good = lambda: " ".join(r.choice("abcdefghij") + str(r.randint(0, 9999)) for _ in range(80))
    rows = [(i, good(), f"good{i % 5}") for i in range(300)] + [(1000 + i, "junk", "bad") for i in range(95)] + [(2000 + i, good(), "bad") for i in range(5)] + [(3000, "junk", "small"), (3001, good(), "small")]
    got = {x.doc_id: x.kept for x in quality_rules.report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] for i in range(300)) and not any(got[2000 + i] for i in range(5)) and not got[3000]


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        level = rest / max(1e-12, sum(w[s] for s in order if s not in capped)) if len(capped) < len(order) else 0
        more = {s for s in order if s not in capped and w[s] * level >= most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in capped else w[s] * level for s in order}
        capped |= more


def test_mix(spark, docs, none):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randint(0, 40)), r.choice(["a", "b", "c", "", None] + ["hot"] * 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: x for x in mixing.report(df).collect()}
    assert len(got) == 3000
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len(t.split())
        taken[s] += got[i].taken
        assert got[i].size == len(t.split()) and 0 <= got[i].taken <= 2 * got[i].size and got[i].taken % max(1, got[i].size) == 0
    want = targets(sizes)
    for i, _, s in rows:
        assert math.isclose(got[i].target, want[s], rel_tol=1e-9) and got[i].source_size == sizes[s]
    assert all(abs(taken[s] - want[s]) <= 40 for s in sizes)
    again = {x.doc_id: x.taken for x in mixing.report(df.repartition(7)).collect()}
    assert again == {i: x.taken for i, x in got.items()}
    assert mixing.report(none).count() == 0 and mixing.mixed(none).count() == 0
    assert mixing.report(docs).count() == len(ROWS)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    taken = Counter()
    for x in mixing.mixed(df).collect():
        taken[x.source] += len(x.text.split())
    assert all(abs(taken[s] - want[s]) <= 40 for s in sizes)
    one = spark.createDataFrame([(1, " ".join(["w"] * r.randint(1, 30)), "s") for _ in range(200)], "doc_id long, text string, source string")  # one id for all
    words = [sorted(x.text for x in mixing.mixed(one.repartition(k)).collect()) for k in (2, 3)]
    assert words[0] == words[1] and abs(sum(len(t.split()) for t in words[0]) - 1.5 * one.agg(F.sum(mixing.n_words(F.col("text")))).first()[0]) <= 30


def test_mix_is_fair(spark):
    """Over many seeds each document is taken as often as its probability says."""
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    total = Counter()
    rows = df.select(F.col("doc_id").alias("key"), F.col("doc_id").alias("name"), "source", mixing.n_words(F.col("text")).alias("size"))
    for seed in range(6):
        for x in mixing.mix(rows, seed=seed, block=4).collect():
            total[x.key] += x.copies - x.target / x.source_size
    assert abs(sum(total.values())) < 25 and max(map(abs, total.values())) < 6


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= x) - x for x in lengths)


@pytest.mark.parametrize("seed", range(6))
def test_best_boundaries(seed):
    r = random.Random(seed)
    lengths = [r.choice([1, 2, 3, 5, 8, 13, 40, 41, 90]) for _ in range(30)]
    tops = sorted(set(lengths))
    c = Counter(lengths)
    for k in range(1, 5):
        bounds, pad = packing.best_boundaries(np.array(tops), np.array([c[t] for t in tops]), np.array([c[t] * t for t in tops]), k)
        best = min(padding(lengths, [*b, tops[-1]]) for b in combinations_with_replacement(tops, k - 1))
        assert pad == best == padding(lengths, bounds) and len(bounds) <= k


def test_pack(spark, docs, none):
    r = random.Random(4)
    df = spark.createDataFrame([(i, " ".join(["w"] * r.choice([0, 3, 5, 30, 200, 3000]))) for i in range(500)], "doc_id long, text string")
    rows = packing.pack(df, n_buckets=3, token_budget=400, rows_per_shard=50).collect()
    assert Counter(x.doc_id for x in rows) == Counter(range(500))
    batches = defaultdict(list)
    for x in rows:
        assert x.n_tokens == len(x.text.split()) <= x.bucket_length and x.padding == x.bucket_length - x.n_tokens
        batches[x.batch].append(x)
    part = Counter()
    for members in batches.values():
        room = max(1, 400 // max(1, members[0].bucket_length))
        assert len(members) <= room and sorted(m.slot for m in members) == list(range(len(members)))
        part[members[0].bucket] += len(members) < room
    assert max(part.values()) <= 1
    assert packing.pack(docs).count() == len(ROWS) and packing.pack(none).count() == 0 and packing.report(none).count() == 0


def test_boundaries_among_long_lengths(spark):
    """Lengths beyond 1,024 are boundaries each: as many buckets as lengths leave no padding, fewer the least there is."""
    lengths = [1024] * 9 + [1025] * 9 + [20000] * 5 + [20001] * 4 + [20019] * 3
    df = spark.createDataFrame([(i, "x", n) for i, n in enumerate(lengths)], "doc_id long, text string, n long")
    assert packing.pack(df, n_buckets=5, length=F.col("n")).agg(F.sum("padding")).first()[0] == 0
    for k in (2, 3, 4):
        tops = sorted(set(lengths))
        want = min(sum(min(b for b in (*c, tops[-1]) if b >= n) - n for n in lengths) for c in combinations(tops[:-1], k - 1))
        assert packing.pack(df, n_buckets=k, length=F.col("n")).agg(F.sum("padding")).first()[0] == want
