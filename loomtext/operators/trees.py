"""Search trees: paths, contexts, beams, values, solutions, sharing. Node tables hold (tree, id, parent, step, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import discard, stage


def tree_ids(nodes: DataFrame) -> DataFrame:
    """(tree, id, ids): the ids from the root to every node, staged; by pointer doubling, so a chain of n nodes takes about
    log2(n) rounds of one join each, whatever the shape. No texts travel. Nodes whose chain of parents ends at an id that is
    not there are left out; a cycle is an error. (tree, id) must be unique.
    """
    now = stage(nodes.select("tree", "id", F.col("parent").cast(nodes.schema["id"].dataType).alias("up"), F.array("id").alias("ids")), "tree-reach")
    most = 2 + now.count().bit_length()
    for _ in range(most):
        if not now.filter("up is not null").limit(1).count():
            return now.select("tree", "id", "ids")
        # each row takes over what its topmost ancestor has reached: twice as many as before
        above = now.select("tree", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("ids").alias("_ids"))
        on = now.filter("up is not null").join(above, ["tree", "up"]).select("tree", "id", F.col("_up").alias("up"), F.concat("_ids", "ids").alias("ids"))
        before, now = now, stage(now.filter("up is null").unionByName(on), "tree-reach")
        discard(before)
    raise ValueError("the parents of some nodes form a cycle")


def tree_path(nodes: DataFrame, step: str = "step") -> DataFrame:
    """(tree, id, depth, path, ids): concatenated steps and the ids from the root, for every node.

    Ids first (see tree_ids); then each node's steps are looked up once, by the ids on its path, and joined in order.
    """
    ids = tree_ids(nodes)
    texts = nodes.select("tree", F.col("id").alias("_at"), F.col(step).alias("_s"))
    each = ids.select("tree", "id", F.posexplode("ids").alias("_pos", "_at")).join(texts, ["tree", "_at"])
    parts = F.array_sort(F.collect_list(F.struct("_pos", "_s")))
    joined = F.concat(F.array_join(F.transform(parts, lambda x: x["_s"]), ""), F.when(F.bool_or(F.col("_s").isNull()), F.lit(None)).otherwise(F.lit("")))  # a null step makes a null path
    paths = each.groupBy("tree", "id").agg(joined.alias("path"))
    return ids.join(paths, ["tree", "id"]).select("tree", "id", (F.size("ids") - 1).alias("depth"), "path", "ids")


def tree_context(paths: DataFrame, prefix: Column) -> DataFrame:
    return paths.select("tree", "id", F.concat(prefix, F.col("path")).alias("context"))


def tree_expansions(paths: DataFrame) -> DataFrame:
    """(tree, expansions, by_depth): nodes less the root, and the number of nodes at each depth."""
    per = paths.groupBy("tree", "depth").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("tree").agg((F.sum("c") - 1).alias("expansions"), F.sort_array(F.collect_list(F.struct("depth", "c"))).alias("by_depth")).select("tree", "expansions", F.transform("by_depth", lambda x: x["c"]).alias("by_depth"))


def depth_stats(paths: DataFrame, step_bytes: str = "path") -> DataFrame:
    """(depth, n_nodes, n_trees, mean_bytes): expansions of each depth over all trees, and the mean length of their paths."""
    return paths.groupBy("depth").agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("tree").alias("n_trees"), F.avg(F.octet_length(step_bytes)).alias("mean_bytes"))


def beam_select(candidates: DataFrame, width: int = 5) -> DataFrame:
    """The `width` best of each (tree, depth): score first, then order of generation."""
    place = F.row_number().over(Window.partitionBy("tree", "depth").orderBy(F.desc("score"), "id"))
    return candidates.withColumn("place", place).filter(F.col("place") <= width)


def final_beam(trees: DataFrame, beams: str = "beams") -> DataFrame:
    """(tree, id) of the deepest recorded beam; string keys count as numbers, an empty map gives none."""
    rows = trees.select("tree", F.explode(beams).alias("depth", "ids"))
    return rows.groupBy("tree").agg(F.max_by("ids", F.col("depth").cast("int")).alias("ids")).select("tree", F.explode("ids").alias("id"))


def value_aggregate(evals: DataFrame, keys: list[str], order: str, score: str = "score", label: str = "label") -> DataFrame:
    """Mean score and the label of the first largest score."""
    return evals.groupBy(*keys).agg(F.avg(score).alias("value"), F.min_by(label, F.struct(-F.col(score), F.col(order))).alias("label"))


def solution_path(nodes: DataFrame, paths: DataFrame, solved: str = "is_solution") -> DataFrame:
    """(tree, solved, ids): the path to the first solved node by id; null without one."""
    first = nodes.groupBy("tree").agg(F.min(F.when(F.col(solved), F.col("id"))).alias("id"))
    return first.join(paths.select("tree", "id", "ids"), ["tree", "id"], "left").select("tree", F.col("id").isNotNull().alias("solved"), "ids")


def tree_distinct(nodes: DataFrame, group: str, content: list[str]) -> DataFrame:
    """Trees and distinct signatures of each group; a signature digests the digests of all nodes in id order, so no texts meet."""
    node = F.sha2(F.to_json(F.struct(*content)), 256)
    sig = F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("id", "_d")))), 256)
    trees = nodes.select(group, "tree", "id", node.alias("_d")).groupBy(group, "tree").agg(sig.alias("sig"))
    return trees.groupBy(group).agg(F.count(F.lit(1)).alias("n_trees"), F.countDistinct("sig").alias("n_distinct"))
