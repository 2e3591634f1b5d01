"""The shingle join and line deduplication against brute force."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtext.llm import line_dedup, ngram_join
from loomtext.llm.components import components


def shingles(t, k=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def family(r, base, n, rate):
    return [" ".join(w if r.random() > rate * r.random() else f"x{r.randrange(10**6)}" for w in base) for _ in range(n)]


@pytest.mark.parametrize("heavy", [64, 3, 0])
def test_components_of_texts(spark, heavy):
    """heavy = 0 and 3 send families and shared passages down the paths for heavy tokens."""
    r = random.Random(heavy)
    word = lambda: f"w{r.randrange(3000)}"
    passage = [word() for _ in range(40)]
    texts = [" ".join(word() for _ in range(r.randint(1, 120))) for _ in range(40)]
    for _ in range(4):
        base = [word() for _ in range(r.randint(20, 150))]
        texts += family(r, base, 12, 0.06) + [" ".join(base)] * 3
    texts += [" ".join([word() for _ in range(r.randint(5, 200))] + passage + [word() for _ in range(r.randint(5, 200))]) for _ in range(15)]
    texts += [None, "", " \n", "one", "ONE", "one two three", "the same " * 5000, "The Same " * 5000]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    got = sorted(tuple(x)[:3] for x in ngram_join.link_components(df, heavy=heavy).collect())
    assert got == brute(rows)


def popular(n, r, per=4, of=40):
    """Texts that each join `per` of `of` passages of 60 words, and a near copy of each 100th."""
    passages = [[f"p{i}w{j}" for j in range(60)] for i in range(of)]
    texts = [[w for p in r.sample(passages, per) for w in p] for _ in range(n)]
    texts += [t[:-2] + ["end"] for t in texts[::100]]
    return list(enumerate(map(" ".join, texts)))


def test_popular_passages(spark, monkeypatch):
    """Sets of popular passages alone: candidates follow the links, not the square of the lists, and no link is lost."""
    seen = []
    plain = ngram_join.verified

    def counted(rows, pairs, *rest):
        seen[-1] += pairs.count()
        return plain(rows, pairs, *rest)

    monkeypatch.setattr(ngram_join, "verified", counted)
    for n in (400, 1600):
        rows = popular(n, random.Random(n))
        seen.append(0)
        got = sorted(tuple(x)[:3] for x in ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"), heavy=16).collect())
        if n == 400:
            assert got == brute(rows)
        else:
            assert sum(a != c for a, _, c in got) >= 16
    print("candidates", seen)
    assert seen[1] < 8 * seen[0]


def test_long_lists_in_part(spark):
    """Where the heads of long lists exceed a broadcast, the longest are sent and the others shuffled."""
    e = spark.range(5000).selectExpr("case when id < 3000 then 0 when id < 4500 then 1 + id % 2 else id end as tok", "id as node")
    heads = e.groupBy("tok").agg(F.count(F.lit(1)).alias("c"))
    want = sorted(map(tuple, e.join(heads, "tok").collect()))
    for most in (1 << 20, 100, 0):
        assert sorted(map(tuple, ngram_join._lists_met(e, heads, hot=100, most=most).collect())) == want


def test_join_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A B C D E F G"), (3, None)], "doc_id long, text string")
    assert sorted(tuple(x)[:3] for x in ngram_join.link_components(df).collect()) == [(1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 0, 3)]
    assert sorted(x.doc_id for x in ngram_join.keep_one(df).collect()) == [1, 3]
    assert ngram_join.link_components(df.limit(0)).count() == 0


def test_near_copies_with_malformed_ids(spark):
    """Rows of one id with different texts stay, near copies go whatever their ids, null ids too."""
    r = random.Random(3)
    text = lambda: " ".join(r.choice("abcdefghijklmnop") * r.randint(1, 4) for _ in range(120))
    a, b, c, d = (text() for _ in range(4))
    rows = [(1, a), (1, b), (1, a), (2, a + " more"), (None, c), (None, c + " more"), (None, d), (None, b + " end"), (4, None), (4, None), (5, "x"), (5, "y"), (None, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((x.doc_id, x.text) for x in ngram_join.keep_one(df).collect())
    late = {k: n for k, n in got.items() if k in ((None, c), (None, c + " more"))}
    assert sum(late.values()) == 1
    assert got - Counter(late) == Counter([(1, a), (1, b), (None, d), (4, None), (5, "x"), (5, "y"), (None, ""), (None, None)])
    assert ngram_join.keep_one(df.filter("doc_id is null and text is null")).count() == 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (7, 7), (100, 102)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(rows, least):
    """Every run of lines with enough words that began earlier, by comparing all pairs of places."""
    order = [(d, i, line) for d, t in rows for i, line in enumerate((t or "").split("\n"))]
    ends = {}
    for d, t in rows:
        ends[d] = len((t or "").split("\n"))
    at = {(d, i): k for k, (d, i, _) in enumerate(order)}
    gone = set()
    for b, (d, i, _) in enumerate(order):
        for a in range(b):
            da, ia, _ = order[a]
            n = words = 0
            while i + n < ends[d] and ia + n < ends[da] and order[at[d, i + n]][2] == order[at[da, ia + n]][2]:
                words += len(order[at[d, i + n]][2].split())
                n += 1
            if words >= least:
                gone |= {(d, i + k) for k in range(n)}
    return gone


@pytest.mark.parametrize("seed", range(3))
def test_repeated_runs(spark, seed):
    r = random.Random(seed)
    line = lambda: " ".join(r.choice("abc") for _ in range(r.randint(0, 4)))
    shared = [line() for _ in range(8)]
    rows = []
    for d in range(14):
        ls = [line() for _ in range(r.randint(0, 6))]
        if r.random() < 0.7:
            k = r.randrange(5)
            ls[len(ls) // 2 : len(ls) // 2] = shared[k : k + r.randint(1, 8)]
        rows.append((d, "\n".join(ls) if r.random() < 0.95 else None))
    rows.append((14, rows[3][1]))
    rows.append((15, "x y\n" * 40))
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, line string")
    want = brute_lines(rows, 6)
    got = {(x.doc_id, i) for x in line_dedup.report(df, min_words=6).collect() for i in x.deleted}
    assert got == want
    cleaned = {x.doc_id: x.text for x in line_dedup.clean(df, min_words=6).collect()}
    for d, t in rows:
        left = [x for i, x in enumerate((t or "").split("\n")) if (d, i) not in want]
        assert cleaned[d] == (t if len(left) == len((t or "").split("\n")) else "\n".join(left))


def test_line_edges(spark):
    df = spark.createDataFrame([(1, "a b c\nd"), (1, "a b c\nd"), (None, "a b c"), (2, None), (3, "")], "doc_id long, text string")
    rows = line_dedup.report(df, min_words=3).collect()
    assert sorted((x.n_lines, x.n_deleted, x.n_chars) for x in rows) == [(1, 0, 0), (1, 0, 0), (1, 1, 0), (2, 0, 7), (2, 2, 0)]
    assert line_dedup.report(df.limit(0)).count() == 0
    assert line_dedup.clean(df, min_words=3).filter(F.col("text") == "a b c\nd").count() == 1


def test_dense_tokens_count_the_asked_sets_alone(spark, monkeypatch):
    """Texts that only the filter of places lets pass are not cut, and a task tells a token once, whatever its batches."""
    words = lambda x, n: [" ".join(f"{x}{j}" for j in range(8)) + f" end{x}{i}" for i in range(n)]
    df = spark.createDataFrame(list(enumerate([*words("a", 3), *words("b", 9)])), "doc_id long, text string").coalesce(1)
    rows = ngram_join.rows_of(df)
    asked = ngram_join.stage(rows.filter("row.doc_id < 3").select(F.col("row.doc_id").alias("node"), "at"), "nodes")
    cut = lambda t: {int(x) for x in next(iter(ngram_join.shingles.sets_of(pa.array([t]), 5))).view("int64")}
    shared = set.intersection(*map(cut, words("a", 3)))
    made = []
    plain = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **how: made.append(plain(self, *a, **how)) or made[-1])
    monkeypatch.setattr(ngram_join, "picked", lambda rows, listed: rows)  # all others pass
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = ngram_join._dense_tokens(rows, asked, "text", 5, 2)
        assert {x.tok for x in got.collect()} == shared
        assert made[-1].count() == made[-1].select("tok").distinct().count() == len(shared) + 3
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
