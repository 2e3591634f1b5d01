"""Deep trees by pointer doubling, forks of forks by reference."""

import pytest
from pyspark.sql import functions as F

from loomtext.functions import fingerprint as fp
from loomtext.operators import leaves, trees, versions


def test_chain_of_five_thousand(spark):
    """13 rounds for a chain; every node has the ids of all before it."""
    n = 5000
    nodes = spark.range(n).select(F.lit("t").alias("tree"), (F.col("id") * 7 % n).alias("i")).select("tree", F.col("i").alias("id"), F.when(F.col("i") > 0, F.col("i") - 1).alias("parent"))
    got = trees.tree_ids(nodes).select("id", F.size("ids").alias("n"), F.get("ids", F.lit(0)).alias("first"), F.get("ids", F.size("ids") - 1).alias("last")).collect()
    assert len(got) == n and all(r.n == r.id + 1 and r.first == 0 and r["last"] == r.id for r in got)
    ids = {r.id: r.ids for r in trees.tree_ids(nodes.filter("id < 40")).collect()}
    assert all(ids[i] == list(range(i + 1)) for i in range(40))


def test_paths_orphans_and_nulls(spark):
    rows = [("a", 1, None, "r"), ("a", 2, 1, "x"), ("a", 3, 2, "y"), ("a", 9, 8, "lost"), ("a", 10, 9, "lost too"), ("b", 1, None, None), ("b", 2, 1, "z"), ("c", 5, None, "")]
    got = {(r.tree, r.id): (r.depth, r.path, r.ids) for r in trees.tree_path(spark.createDataFrame(rows, "tree string, id long, parent long, step string")).collect()}
    assert got == {("a", 1): (0, "r", [1]), ("a", 2): (1, "rx", [1, 2]), ("a", 3): (2, "rxy", [1, 2, 3]), ("b", 1): (0, None, [1]), ("b", 2): (1, None, [1, 2]), ("c", 5): (0, "", [5])}
    with pytest.raises(ValueError, match="cycle"):
        trees.tree_ids(spark.createDataFrame([("a", 1, 2), ("a", 2, 1)], "tree string, id long, parent long"))
    assert trees.tree_ids(spark.createDataFrame([], "tree string, id long, parent long")).count() == 0


def test_forks_of_forks(spark):
    """Content, order and sharing of forks several deep; a base without leaves; refs hold no bytes."""
    docs = spark.createDataFrame([(0, "base text " * 60), (1, None)], "doc_id long, text string")
    base = leaves.leaves_fixed(docs, 64, empty_leaf=False)
    rows = [(10, 0, None, b"one "), (11, 0, 10, b"two "), (12, 0, 11, b"three "), (13, 0, 10, b"two "), (14, 1, None, b"alone"), (15, 1, 14, b"")]
    br = spark.createDataFrame([(a, b, c, bytearray(d)) for a, b, c, d in rows], "branch_id long, base_id long, parent_branch long, step binary")
    refs = versions.branch_refs(br, base)
    assert not {"leaf", "step", "data"} & set(refs.columns)
    text = b"base text " * 60
    want = {10: text + b"one ", 11: text + b"one two ", 12: text + b"one two three ", 13: text + b"one two ", 14: b"alone", 15: b"alone"}
    assert {r.branch_id: bytes(r.data) for r in versions.branch_content(refs, br, base).collect()} == want
    stats = {r.base_id: r for r in versions.sharing_stats(refs, ["base_id"]).collect()}
    blocks = {text[i : i + 64] for i in range(0, 600, 64)}
    assert stats[0].n_refs == 4 * 10 + 1 + 2 + 3 + 2 and stats[0].n_blocks == len(blocks) + 3
    assert {r.base_id: r.shared_bytes for r in versions.copy_vs_share(refs, ["base_id"]).collect()}[0] == sum(map(len, blocks)) + 4 + 4 + 6


def test_clashing_blocks_are_an_error(spark, monkeypatch):
    for module in (fp, versions):
        monkeypatch.setattr(module, "MODULUS", 7)
    d = leaves.leaves_fixed(spark.range(300).select(F.col("id").alias("doc_id"), F.format_string("%08d", F.col("id")).alias("text")), 64)
    with pytest.raises(ValueError, match="one fingerprint"):
        versions.named_blocks(d, "doc_id")
