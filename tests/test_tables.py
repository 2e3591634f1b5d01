"""Leaf tables whose joins move nothing, and sketches against exact figures."""

from pyspark.sql import functions as F

from loomtext.operators import leaftable, stats, versions


def test_leaf_table_joins_without_exchange(spark):
    texts = [(i, "word %d " % i * (i % 40)) for i in range(60)] + [(100, None), (101, "")]
    before = spark.createDataFrame(texts, "doc_id long, text string")
    after = before.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("new "), "text")).otherwise(F.col("text"))).filter("doc_id <> 5")
    a, b = leaftable.leaf_table(before, 16, buckets=4), leaftable.leaf_table(after, 16, buckets=4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = leaftable.changed_leaves(a, b)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        got = {r.doc_id: r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    later = dict(after.collect())
    cut = lambda t: [(t or "").encode()[i : i + 16] for i in range(0, len((t or "").encode()), 16)]
    for i, t in texts:
        x, y = cut(t), cut(later.get(i))
        if x or y:
            assert (got[i].n_before, got[i].n_after, got[i].n_same, got[i].n_new) == (len(x), len(y), sum(p == q for p, q in zip(x, y, strict=False)), len(set(y) - set(x)))
    prefix = {(r.doc_id, r.ord): (r.p1, r.p2) for r in a.collect()}
    from loomtext.operators import identity, leaves

    want = identity.prefix_fingerprint(identity.fingerprint_leaves(leaves.leaves_fixed(before, 16, empty_leaf=False))).collect()
    assert prefix == {(r.doc_id, r.ord): (r.fp1, r.fp2) for r in want}


def test_sketches_merge(spark):
    """Two increments merged give what the whole gives, near the exact figures."""
    refs = spark.range(300_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 50_021).alias("fp1"), F.lit(1).cast("long").alias("fp2"), F.lit(256).cast("long").alias("n"), F.lit("base").alias("kind"))
    parts = versions.sharing_sketch(refs.filter("fp1 < 30000"), ["k"]).unionByName(versions.sharing_sketch(refs.filter("fp1 >= 20000"), ["k"]))
    merged = {r.k: r for r in versions.sharing_estimate(versions.merge_sharing(parts, ["k"]), ["k"]).collect()}
    exact = {r.k: r for r in versions.sharing_stats(refs, ["k"]).collect()}
    assert all(abs(merged[k].n_blocks - exact[k].n_blocks) <= 0.03 * exact[k].n_blocks for k in exact) and merged[0].n_refs > exact[0].n_refs
    runs = spark.range(200_000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 11 > 0, F.pow(F.col("id").cast("double"), 2)).alias("value"))
    halves = stats.latency_sketch(runs.filter("value % 3 = 0 or value is null"), ["k"]).unionByName(stats.latency_sketch(runs.filter("value % 3 <> 0"), ["k"]))
    got = {r.k: r for r in stats.latency_estimates(stats.merge_latency(halves, ["k"]), ["k"]).collect()}
    for k, r in got.items():
        mine = runs.filter((F.col("k") == k) & F.col("value").isNotNull())
        assert r.n_values == mine.count()
        shares = mine.agg(*[F.avg((F.col("value") <= x).cast("double")) for x in (r.p50, r.p90, r.p99)]).first()
        assert all(abs(s - q) <= 0.02 for s, q in zip(shares, (0.5, 0.9, 0.99), strict=True))
