"""Versions of content: branches, block accounting, repeats and edits. Branches refer to leaves, they never copy them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fingerprint import BASES, LANES, MODULUS, geometric, leaf_hash, power
from ..functions.tables import dealt_finely, let, scan, stage
from .edits import edit_apply, edit_identity, edit_pieces, snapshot_at
from .trees import tree_ids

__all__ = [
    "BLOCK", "append_delta", "array_runs", "block_table", "branch_content", "branch_fingerprint", "branch_refs", "compression_ratio", "copy_vs_share", "edit_apply", "edit_identity", "edit_pieces", "first_leaf_change",
    "materialize", "merge_sharing", "named_blocks", "new_blocks", "run_encode", "run_expand", "run_fingerprint", "sharing_estimate", "sharing_sketch", "sharing_stats", "snapshot_at", "tail_block", "token_blocks",
]


def materialize(leaves: DataFrame, keys: tuple[str, ...] = ("doc_id",), leaf: str = "leaf") -> DataFrame:
    """(keys, data): leaves joined in order. Arrays join as strings only, so each byte travels as one Latin-1 character."""
    parts = F.sort_array(F.collect_list(F.struct("ord", F.decode(leaf, "ISO-8859-1").alias("h"))))
    return leaves.groupBy(*keys).agg(parts.alias("p")).select(*keys, F.encode(F.array_join(F.transform("p", lambda x: x["h"]), ""), "ISO-8859-1").alias("data"))


#: What names a block: its fingerprint and length. Two blocks of one name with different bytes are an error (see named_blocks).
BLOCK = ["fp1", "fp2", "n"]


def named_blocks(leaves: DataFrame, owner: str) -> DataFrame:
    """leaves(owner, ord, leaf, n) -> (owner, at, fp1, fp2, n): blocks by content id, without their bytes; staged. Bytes are
    checked here, once for each name: all blocks that share it must agree in two other hashes of their bytes."""
    hashed = leaves.withColumn("_h", leaf_hash(F.col("leaf"))).select(owner, F.col("ord").alias("at"), *[F.col(f"_h.{x}").alias(x) for x in LANES], F.col("n").cast("long").alias("n"), F.xxhash64("leaf").alias("g1"), F.hash("leaf").alias("g2"))
    hashed = stage(hashed, "blocks")
    clash = hashed.groupBy(*BLOCK).agg((F.min("g1") != F.max("g1")).alias("c1"), (F.min("g2") != F.max("g2")).alias("c2")).filter("c1 or c2")
    if clash.limit(1).count():
        raise ValueError("two different blocks have one fingerprint")
    return hashed.drop("g1", "g2")


def branch_refs(branches: DataFrame, base_leaves: DataFrame) -> DataFrame:
    """For branches(branch_id, base_id, step binary[, parent_branch]): (branch_id, base_id, ord, kind, owner, at, fp1, fp2, n).

    A branch is the leaves of its base and then one leaf for each step from its first ancestor's to its own, all by
    reference: owner and at name the base's leaf or the branch whose step it is. No bytes are copied, so a fork costs a row
    for each leaf it refers to, however long the leaf is. With parent_branch (null: a fork of the base itself) a branch
    forks another one, which may be a fork in turn; base_id is then that of the first. A null step adds no leaf.
    """
    base = named_blocks(base_leaves.select(F.col("doc_id").alias("owner"), "ord", "leaf", "n"), "owner")
    steps = named_blocks(branches.filter("step is not null").select(F.col("branch_id").alias("owner"), F.lit(0).alias("ord"), F.col("step").alias("leaf"), F.octet_length("step").alias("n")), "owner")
    if "parent_branch" in branches.columns:
        chains = tree_ids(branches.select(F.lit(0).alias("tree"), F.col("branch_id").alias("id"), F.col("parent_branch").alias("parent"))).select(F.col("id").alias("branch_id"), "ids")
    else:
        chains = branches.select("branch_id", F.array("branch_id").alias("ids"))
    first = branches.select(F.col("branch_id").alias("_first"), "base_id")
    chains = stage(chains.withColumn("_first", F.get("ids", F.lit(0))).join(first, "_first").select("branch_id", "base_id", "ids"), "branch-chains")
    shared = chains.select("branch_id", "base_id").join(base.withColumnRenamed("owner", "base_id"), "base_id")
    shared = shared.select("branch_id", "base_id", F.col("at").alias("ord"), F.lit("base").alias("kind"), F.col("base_id").alias("owner"), "at", *BLOCK)
    ends = base.groupBy(F.col("owner").alias("base_id")).agg((F.max("at") + 1).alias("_n"))
    own = chains.join(ends, "base_id", "left").select("branch_id", "base_id", F.coalesce("_n", F.lit(0)).alias("_n"), F.posexplode("ids").alias("_i", "owner")).join(steps, "owner")
    own = own.select("branch_id", "base_id", (F.col("_n") + F.col("_i")).cast(shared.schema["ord"].dataType).alias("ord"), F.lit("step").alias("kind"), "owner", "at", *BLOCK)
    return shared.unionByName(own)


def branch_content(refs: DataFrame, branches: DataFrame, base_leaves: DataFrame, keys: tuple[str, ...] = ("branch_id",)) -> DataFrame:
    """(keys, data): the bytes of branches, on request; each reference is looked up where it points."""
    base = base_leaves.select(F.lit("base").alias("kind"), F.col("doc_id").alias("owner"), F.col("ord").alias("at"), "leaf")
    steps = branches.select(F.lit("step").alias("kind"), F.col("branch_id").alias("owner"), F.lit(0).alias("at"), F.col("step").alias("leaf"))
    return materialize(refs.select(*keys, "ord", "kind", "owner", "at").join(base.unionByName(steps), ["kind", "owner", "at"]), keys)


def branch_fingerprint(branches: DataFrame, base_fp: DataFrame, step_fp: DataFrame) -> DataFrame:
    """(branch_id, n, fp1, fp2) from the two fingerprints alone: H(AB) = H(A) + x^|A| H(B)."""
    a = base_fp.select(F.col("doc_id").alias("base_id"), F.col("n").alias("na"), *[F.col(x).alias(f"a_{x}") for x in LANES])
    b = step_fp.select("branch_id", F.col("n").alias("nb"), *[F.col(x).alias(f"b_{x}") for x in LANES])
    both = branches.select("branch_id", "base_id").join(a, "base_id").join(b, "branch_id")
    fps = [((F.col(f"a_{x}") + power(F.col("na"), BASES[k]) * F.col(f"b_{x}")) % MODULUS).alias(x) for k, x in enumerate(LANES)]
    return both.select("branch_id", (F.col("na") + F.col("nb")).cast("long").alias("n"), *fps)


def sharing_stats(refs: DataFrame, keys: list[str], content: list[str] = BLOCK) -> DataFrame:
    """References, distinct blocks by content, distinct by kind, and their ratio. Blocks are reduced by content first."""
    blocks = refs.groupBy(*keys, *content).agg(F.count(F.lit(1)).alias("c"), F.max((F.col("kind") == "base").cast("int")).alias("base"))
    out = blocks.groupBy(*keys).agg(F.sum("c").alias("n_refs"), F.count(F.lit(1)).alias("n_blocks"), F.sum("base").cast("long").alias("n_base"))
    return out.withColumns({"n_step": F.col("n_blocks") - F.col("n_base"), "sharing_ratio": F.col("n_refs") / F.col("n_blocks")})


def sharing_sketch(refs: DataFrame, keys: list[str], lg_k: int = 14) -> DataFrame:
    """(keys, n_refs, sketch): as sharing_stats, with a sketch of the distinct blocks (16 KB at most) that can be merged."""
    return refs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_refs"), F.hll_sketch_agg(F.xxhash64(*BLOCK), F.lit(lg_k)).alias("sketch"))


def merge_sharing(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One sketch for each key from those of several increments; no reference is read again."""
    return sketches.groupBy(*keys).agg(F.sum("n_refs").alias("n_refs"), F.hll_union_agg("sketch").alias("sketch"))


def sharing_estimate(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_refs, n_blocks, sharing_ratio): blocks within 1.04 / sqrt(2^lg_k) at one standard deviation, 0.8 % for 14."""
    n = F.hll_sketch_estimate("sketch")
    return sketches.select(*keys, "n_refs", n.alias("n_blocks"), (F.col("n_refs") / n).alias("sharing_ratio"))


def copy_vs_share(refs: DataFrame, keys: list[str]) -> DataFrame:
    """Logical bytes if every branch copies its leaves, and if equal leaves are stored once."""
    blocks = refs.groupBy(*keys, *BLOCK).agg(F.count(F.lit(1)).alias("c"))
    return blocks.groupBy(*keys).agg(F.sum(F.col("c") * F.col("n")).alias("copied_bytes"), F.sum("n").cast("long").alias("shared_bytes"))


def new_blocks(child: DataFrame, parent: DataFrame, keys: list[str], content: list[str] = BLOCK) -> DataFrame:
    """(keys, n_new): distinct blocks of the child that the parent lacks; 0 where there are none."""
    fresh = child.select(*keys, *content).distinct().join(parent.select(*keys, *content).distinct(), [*keys, *content], "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_new"))
    return child.select(*keys).distinct().join(fresh, keys, "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))


def token_blocks(tokens: DataFrame, size: int, keys: tuple[str, ...]) -> DataFrame:
    """For (keys, pos, token): (keys, block, fp1, fp2, n) with the fingerprint of the whole prefix to the block's end,
    so two blocks are one only where everything before them is equal too."""
    h = [(F.pmod(F.xxhash64(F.lit(k), "token"), F.lit(MODULUS)) + 1) * power(F.col("pos"), BASES[k]) % MODULUS for k in range(2)]
    blocks = tokens.groupBy(*keys, F.floor(F.col("pos") / size).cast("int").alias("block")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{k}") for k, x in enumerate(h)])
    sums = scan(blocks, list(keys), "block", {x: f"s{k}" for k, x in enumerate(LANES)})
    return sums.select(*keys, "block", "n", *[(F.col(x) % MODULUS).alias(x) for x in LANES])


def append_delta(turns: DataFrame, keys: list[str], order: str, tokens: Column) -> DataFrame:
    """turns with delta_tokens, those of the appended turn alone, and total_tokens of the whole context so far. The running
    count is a two-level scan along the places of turns, so a context of very many turns is many tasks."""
    return scan(turns.withColumn("delta_tokens", tokens.cast("long")), keys, order, {"total_tokens": "delta_tokens"})


def block_table(tokens: DataFrame, sizes: list[int], group: str, key: str = "doc_id") -> DataFrame:
    """(group, block_size, table_entries, live_blocks) of paged sequences; entries are the sum of ceil(tokens / size).

    Tokens are hashed once, in blocks of the sizes' greatest common divisor; a larger block's chain is that of the
    last small one in it. All steps are staged, in many partitions, so that a task's memory does not grow with the input.
    """
    with dealt_finely(tokens.sparkSession):
        return stage(_block_table(tokens, sizes, group, key), "block-table")


def _block_table(tokens: DataFrame, sizes: list[int], group: str, key: str) -> DataFrame:
    unit = math.gcd(*sizes)
    small = token_blocks(tokens, unit, (group, key))
    last = F.max("block").over(Window.partitionBy(group, key))
    small = small.withColumn("last", last).withColumn("block_size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    ends = small.filter(((F.col("block") + 1) * unit % F.col("block_size") == 0) | (F.col("block") == F.col("last")))
    place = F.floor(F.col("block") * unit / F.col("block_size"))
    # the tokens of the last, part-filled block count too: a longer sequence's full block is another one
    chained = ends.groupBy(group, "block_size", place.alias("at"), *LANES).agg(F.count(F.lit(1)).alias("c"))
    return chained.groupBy(group, "block_size").agg(F.sum("c").alias("table_entries"), F.count(F.lit(1)).alias("live_blocks"))


def tail_block(n: Column, size: Column) -> Column:
    return F.when(n % size == 0, "new").otherwise("copy")


def compression_ratio(rows: DataFrame, paged: str, shared: str) -> DataFrame:
    """One row: ratio of sums, mean and population deviation of the rows' ratios."""
    each = F.col(paged) / F.nullif(F.col(shared), F.lit(0))
    return rows.agg((F.sum(paged) / F.nullif(F.sum(shared), F.lit(0))).alias("ratio_of_sums"), F.avg(each).alias("ratio_mean"), F.stddev_pop(each).alias("ratio_std"))


def run_encode(units: DataFrame, keys: tuple[str, ...], order: str, unit: str) -> DataFrame:
    """(keys, start, unit, q): runs of equal neighbours; `order` counts a key's units from 0 without gaps.

    A unit learns from the one before it, a row of the same key, whether it begins a run; runs are numbered by a two-level
    scan. A key of very many units is many tasks in both; units are compared by two 64-bit hashes and read once a run.
    """
    hashed = lambda u: F.struct(F.xxhash64(u).alias("a"), F.xxhash64(F.lit(1), u).alias("b"), F.col(u).isNull().alias("z"))
    rows = stage(units.select(*keys, F.col(order).cast("long").alias("_i"), F.col(unit).alias("unit"), hashed(unit).alias("_h")), "units")
    edge = [(F.col("_i") + k).alias("_i") for k in (0, 1)]
    pairs = rows.select(*keys, edge[0], "_h", F.lit(0).alias("_late")).unionByName(rows.select(*keys, edge[1], "_h", F.lit(1).alias("_late")))
    pick = lambda k: F.max(F.when(F.col("_late") == k, F.col("_h")))
    begins = pairs.groupBy(*keys, "_i").agg(pick(0).alias("mine"), pick(1).alias("before")).filter("mine is not null")
    begins = begins.select(*keys, "_i", F.when(F.col("mine").eqNullSafe(F.col("before")), 0).otherwise(1).cast("long").alias("_b"))
    runs = scan(begins, list(keys), "_i", {"_run": "_b"}).groupBy(*keys, "_run").agg(F.min("_i").alias("start"), F.count(F.lit(1)).alias("q"))
    kind = units.schema[order].dataType
    return runs.join(rows.select(*keys, F.col("_i").alias("start"), "unit"), [*keys, "start"]).select(*keys, F.col("start").cast(kind).alias("start"), "unit", "q")


def array_runs(units: Column) -> Column:
    """array<struct<start, unit, q>>: runs of equal neighbours (nulls are equal) of an array, in order; null for an empty one.

    Inside the row: nothing is shuffled or sorted, and a task holds one row's units. For units in rows of their own, see run_encode.
    """

    def of(u):
        begins = F.filter(F.sequence(F.lit(0), F.size(u) - 1), lambda i: (i == 0) | ~F.get(u, i).eqNullSafe(F.get(u, i - 1)))
        run = lambda b: F.transform(b, lambda i, k: F.struct(i.alias("start"), F.get(u, i).alias("unit"), (F.coalesce(F.get(b, k + 1), F.size(u)) - i).cast("long").alias("q")))
        return F.when(F.size(u) > 0, let(begins, run))

    return let(units, of)


def run_expand(runs: DataFrame, q: str = "q") -> DataFrame:
    """Each row q times, with its number i from 0; none for q = 0."""
    return runs.filter(F.col(q) > 0).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col(q) - 1)))


def run_fingerprint(fps: DataFrame, q: str = "q") -> DataFrame:
    """fps(n, fp1, fp2, q) -> the fingerprint of q copies: H(S) (1 + x^n + ... + x^((q-1)n)), by doubling."""
    each = {x: F.col(x) * geometric(F.col(q), power(F.col("n"), BASES[k])) % MODULUS for k, x in enumerate(LANES)}
    return fps.withColumns(each | {"n": F.col("n") * F.col(q)})


def first_leaf_change(a: Column, b: Column) -> Column:
    """Place of the first leaf that differs."""
    return let(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda d: F.array_position(d, F.lit(True)) - 1)
