"""The queries of the subpackage and the pipeline on the smallest tables."""

import random
from collections import Counter

import pytest
from comparing import DATA, rows_of, sql_rows

import corpus_pipeline
from loomtext.llm.queries import QUERIES
from loomtext.llm.sql import SQL

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    cols, got = rows_of(QUERIES[name](spark, str(DATA)))
    assert got
    if name in SQL:
        want_cols, want = sql_rows(SQL[name])
        assert cols == want_cols and got == want


def test_pipeline(spark):
    """Each stage against what it must do on its own input."""
    from pyspark.sql import functions as F

    from loomtext.llm import exact_dedup, ngram_join, packing, quality_rules

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "exact dedup", "n-gram Jaccard join", "mixing", "packing"]
    good = stages["quality rules"](spark, docs, str(DATA)).cache()
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality_rules.report(docs).filter("kept").collect()}
    one = stages["exact dedup"](spark, good, str(DATA)).cache()
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in exact_dedup.exact_groups(good).filter("kept").collect()}
    near = stages["n-gram Jaccard join"](spark, one, str(DATA)).cache()
    assert {r.doc_id for r in near.collect()} == {r.component_id for r in ngram_join.link_components(one).collect()}
    mixed = stages["mixing"](spark, near, str(DATA)).cache()
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in near.collect()} and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    packed = stages["packing"](spark, mixed, str(DATA))
    assert packed.count() == mixed.count() and set(packing._OWN) <= set(packed.columns)
    assert all(x.columns == docs.columns for x in (good, one, near, mixed))
    assert corpus_pipeline.run(spark, str(DATA)).count() == mixed.count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, at string, root string"


def odd_documents(r):
    """Good texts, exact and near copies, junk, nulls, repeated ids and rows."""
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7)))
    texts = [" ".join(word() for _ in range(r.randint(60, 140))) for _ in range(40)]
    near = [t.rsplit(" ", 2)[0] + " changed" for t in texts[:10]]
    exact = [t.replace(" ", "  ") for t in texts[5:15]]
    junk = [None, "", "  ", "too short", "the same again " * 60]
    rows = [(i, t) for i, t in enumerate([*texts, *near, *exact, *junk])] + [(None, texts[20]), (None, None), (3, texts[30] + " x"), (3, texts[3]), (3, texts[3])]
    return [(i, t, "en", None if k % 9 == 0 else f"s{k % 3}", len(t or ""), "mine", "mine", "mine") for k, (i, t) in enumerate(rows)]


def test_stages_by_brute_force(spark, tmp_path):
    """run() on a small folder against each stage done by hand."""
    from test_duplicates import shingles
    from test_native import measures, squeeze, targets

    rows = odd_documents(random.Random(4))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")  # one file: of rows equal in id and text the first in it stays
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    good = [x for x in rows if (m := measures(x[1]))[0] >= 50 and 100 * m[4] <= 50 * m[0]]
    best = {}
    for x in sorted(good, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0)):
        best.setdefault(squeeze(x[1]), x)
    left = list(best.values())
    sets, root = [shingles(x[1]) for x in left], list(range(len(left)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(left)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    one = {}
    for i in sorted(range(len(left)), key=lambda i: (left[i][0] is None, left[i][0] or 0)):
        one.setdefault(find(i), left[i])
    sizes, taken = Counter(), Counter()
    for x in one.values():
        sizes[x[3]] += len(x[1].split())
    for x in got:
        taken[x.source] += x.n_tokens
        assert x.n_tokens == len(x.text.split()) <= x.bucket_length and (x.row, x["at"], x.root) == ("mine", "mine", "mine")
    assert {(x.doc_id, x.text) for x in got} <= {(x[0], x[1]) for x in one.values()}
    assert max(Counter((x.doc_id, x.text) for x in got).values()) <= 2
    want = targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 150 for s in sizes)


def test_stages_on_odd_tables(spark):
    """An empty table passes all stages; rows without words fall at the first; each stage takes them all the same."""
    empty = spark.createDataFrame([], SCHEMA)
    bare = spark.createDataFrame([(1, None, None, None, None, "r", "a", "o"), (None, "", "en", "s", 0, "r", "a", "o"), (1, None, None, None, None, "r", "a", "o")], SCHEMA)
    kept = {"quality rules": 0, "exact dedup": 1, "n-gram Jaccard join": 2, "mixing": None, "packing": 3}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
        n = stage(spark, bare, "").count()
        assert kept[name] is None or n == kept[name], name
