"""Queries that write derived files into the shared folder and read them back with the library's readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import new_path
from ..sources import readers
from .registering import query, table


def _one_file_each(rows, spark, name, key):
    """Each row's JSON text in a file of its own, under a folder named by its key."""
    path = new_path(spark, name)
    rows.repartition(key).write.partitionBy(key).text(path)
    return path


#: Rows in a document at most, roughly: what a reader of whole documents holds at once.
_IN_A_DOCUMENT = 10_000


def _dealt(rows, *by):
    """rows with g, the number of their document: as many documents as the rows need, dealt by a hash of columns."""
    n = max(1, -(-rows.count() // _IN_A_DOCUMENT))
    return rows.withColumn("g", F.pmod(F.xxhash64(*by), F.lit(n)))


def _documents(docs, spark, name):
    """Each row's JSON text in a file of its own, all in one folder."""
    path = new_path(spark, name)
    docs.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


def _written(rows, spark, name):
    path = new_path(spark, name)
    rows.write.text(path)
    return path


@query("read_conversations_jsonl", "SELECT conv_id::VARCHAR AS id, count(*)::INT AS n_turns, string_agg(role || '/' || text, chr(10) ORDER BY turn) AS said FROM conversations GROUP BY conv_id HAVING count(*) >= 4")
def _(spark, sf):
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("s"))
    turns = F.transform("s", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    rows = readers.jsonl(t, F.col("conv_id").cast("string").alias("id"), turns.alias("turns"), F.size("s").alias("n_turns"))
    path = _written(rows.union(spark.createDataFrame([("",), ("{broken",)], "value string")), spark, "conversations")
    got = readers.read_conversations_jsonl(spark, path)
    return got.select("id", "n_turns", F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("/"), x["content"])), "\n").alias("said"))


@query("read_traces", "SELECT doc_id // 40 AS puzzle_id, 42 + (doc_id // 40) % 3 AS seed, doc_id % 40 AS id, CASE WHEN doc_id % 40 > 0 THEN (doc_id % 40 - 1) // 3 END AS parent_id, text AS thought_text, (n_chars % 3)::DOUBLE AS value_score FROM documents")
def _(spark, sf):
    from .versions import nodes

    n = nodes(spark, sf).select("tree", F.struct(F.col("id"), F.col("parent").alias("parent_id"), F.col("step").alias("thought_text"), F.col("score").cast("double").alias("value_score"), "is_solution").alias("n"))
    trees = n.groupBy("tree").agg(F.collect_list("n").alias("nodes"))
    path = _written(readers.jsonl(trees, F.col("tree").alias("puzzle_id"), (F.col("tree") % 3 + 42).alias("seed"), "nodes"), spark, "traces")
    return readers.read_traces(spark, path).select("puzzle_id", "seed", "id", "parent_id", "thought_text", "value_score")


@query("read_runs", "SELECT 42 + l_suppkey % 3 AS seed, l_partkey % 3 AS inv, l_linenumber AS n, round(sum(l_quantity), 2) AS value, count(*)::INT AS reps FROM lineitem GROUP BY ALL")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    cells = li.groupBy((F.col("l_suppkey") % 3 + 42).alias("seed"), (F.col("l_partkey") % 3).alias("inv"), "l_linenumber").agg(F.round(F.sum("l_quantity"), 2).alias("mean"), F.count(F.lit(1)).alias("reps"))
    runs = cells.groupBy("seed", "inv").agg(F.map_from_entries(F.collect_list(F.struct(F.col("l_linenumber").cast("string").alias("key"), F.struct("mean", "reps").alias("value")))).alias("cells"))
    one = runs.select(F.concat_ws("-", "seed", "inv").alias("run"), F.to_json(F.struct("seed", "inv", "cells")).alias("value"))
    return readers.read_runs(spark, _one_file_each(one, spark, "runs", "run"))


@query("read_trees", "WITH RECURSIVE nd AS (SELECT doc_id // 40 AS tree, doc_id % 40 AS id, CASE WHEN doc_id % 40 > 0 THEN (doc_id % 40 - 1) // 3 END AS parent FROM documents), dp AS (SELECT tree, id, 0 AS depth FROM nd WHERE parent IS NULL UNION ALL SELECT nd.tree, nd.id, dp.depth + 1 FROM nd JOIN dp ON nd.tree = dp.tree AND nd.parent = dp.id), b AS (SELECT tree, depth, list(id ORDER BY id) AS ids FROM dp GROUP BY tree, depth) SELECT tree AS puzzle_id, count(*) AS n_beams, max(depth) AS deepest, arg_max(ids, depth) AS last_beam FROM b GROUP BY tree")
def _(spark, sf):
    """Whole trees with their beams, written as JSON lines with depths as names and read back."""
    from ..operators import trees
    from .versions import paths

    beams = paths(spark, sf).groupBy("tree", "depth").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    whole = beams.groupBy("tree").agg(F.map_from_entries(F.collect_list(F.struct(F.col("depth").cast("string").alias("key"), F.col("ids").alias("value")))).alias("beams"))
    got = readers.read_trees(spark, _written(readers.jsonl(whole, F.col("tree").alias("puzzle_id"), "beams"), spark, "trees")).select(F.col("puzzle_id").alias("tree"), "beams")
    last = trees.final_beam(got).groupBy("tree").agg(F.sort_array(F.collect_list("id")).alias("last_beam"))
    return got.select("tree", F.size("beams").cast("long").alias("n_beams"), F.array_max(F.transform(F.map_keys("beams"), lambda x: x.cast("int"))).alias("deepest")).join(last, "tree").withColumnRenamed("tree", "puzzle_id")


@query("read_cells", """SELECT l_orderkey || '-' || l_linenumber AS cell_id, count(*)::BIGINT AS n_cells, count_if(l_linenumber % 4 = 3) AS skipped, count_if(l_linenumber % 4 = 2) AS absent, sum(CASE WHEN l_linenumber % 4 < 2 THEN l_quantity END) AS joules, sum(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 7 END)::BIGINT AS n_checks, count_if(l_linenumber % 2 = 0) AS gated FROM lineitem GROUP BY 1""")
def _(spark, sf):
    """Grid documents of some orders each, with cells that are measured, skipped with a reason, or lack a track."""
    k = F.col("l_linenumber") % 4
    track_a = F.when(k == 3, F.struct(F.lit(True).alias("skipped"), F.lit("no memory").alias("reason"), F.lit(None).cast("double").alias("joules_per_token"))).when(k != 2, F.struct(F.lit(None).cast("boolean").alias("skipped"), F.lit(None).cast("string").alias("reason"), F.col("l_quantity").alias("joules_per_token")))
    track_b = F.when(F.col("l_linenumber") % 2 == 0, F.struct(F.struct((F.col("l_partkey") % 7).alias("n_checks"), F.lit(0).alias("mismatches")).alias("gate")))
    cell = F.struct(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("cell_id"), (k == 0).alias("cache_on"), F.lit(42).alias("seed"), k.alias("inv"), F.lit(1000).alias("L"), track_a.alias("track_a"), track_b.alias("track_b"))
    docs = _dealt(table(spark, sf, "lineitem"), "l_orderkey").groupBy("g").agg(F.to_json(F.struct(F.collect_list(cell).alias("cells"))).alias("value"))
    got = readers.read_cells(spark, _documents(docs, spark, "cells"))
    count = lambda s: F.count_if(F.col("state") == s)
    return got.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_cells"), count("skipped").alias("skipped"), count("absent").alias("absent"), F.sum("joules_per_token").alias("joules"), F.sum("n_checks").alias("n_checks"), F.count("n_checks").alias("gated"))


@query("read_controls", "SELECT l_shipmode_ AS key, sum(total)::BIGINT AS total, sum(detected)::BIGINT AS detected FROM (SELECT (l_partkey % 5)::VARCHAR AS l_shipmode_, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber ELSE 2 END AS total, CASE WHEN l_linenumber % 2 = 0 THEN CASE WHEN l_quantity > 5 THEN l_linenumber ELSE 1 END ELSE CASE WHEN l_discount > 0.01 THEN 2 ELSE 1 END END AS detected FROM lineitem) GROUP BY 1")
def _(spark, sf):
    """Control documents of both shapes, a number with a flag or a sample, and a list."""
    li = table(spark, sf, "lineitem").select((F.col("l_partkey") % 5).cast("string").alias("dataset"), "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount")
    flag = lambda x: F.struct(x.alias("detected"))
    counted = F.to_json(F.struct("dataset", F.col("l_linenumber").alias("controls"), F.when(F.col("l_quantity") > 5, F.lit(True)).alias("all_detected"), F.array(flag(F.lit(True)), flag(F.lit(False))).alias("sample")))
    listed = F.to_json(F.struct("dataset", F.array(flag(F.lit(True)), flag(F.col("l_discount") > 0.01)).alias("controls")))
    row = F.when(F.col("l_linenumber") % 2 == 0, counted).otherwise(listed)
    docs = _dealt(li, "l_orderkey", "l_partkey", "l_linenumber").groupBy("g").agg(F.concat(F.lit('{"seed": 42, "rows": ['), F.array_join(F.collect_list(row), ","), F.lit("]}")).alias("value"))
    got = readers.read_controls(spark, _documents(docs, spark, "controls"))
    return got.groupBy("key").agg(F.sum("total").alias("total"), F.sum("detected").alias("detected"))


@query("read_bench_estimates", "SELECT l_linestatus AS group_id, l_linenumber * 1000 AS n, round(sum(l_quantity), 2) / 10 AS per_unit FROM lineitem WHERE l_linenumber IN (1, 3, 5) GROUP BY ALL")
def _(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_linestatus", "l_linenumber").agg(F.round(F.sum("l_quantity"), 2).alias("mean"))
    root = new_path(spark, "bench")
    folders = [F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("size"), F.lit("new").alias("kind")]
    about = F.to_json(F.struct(F.col("l_linestatus").alias("group_id"), (F.col("l_linenumber") * 1000).cast("string").alias("value_str")))
    result = F.to_json(F.struct(F.struct(F.col("mean").alias("point_estimate")).alias("mean")))
    for name, value in (("benchmark", about), ("estimates", result)):  # one folder a cell, all from one write
        li.select(value.alias("value"), *folders).write.partitionBy("status", "size", "kind").text(f"{root}/{name}")
    return readers.read_bench_estimates(spark, root, 10, [1000, 3000, 5000])


@query("read_csv_metrics", "SELECT o_orderkey AS step, o_totalprice AS native_ms FROM orders")
def _(spark, sf):
    path = new_path(spark, "metrics")
    table(spark, sf, "orders").select(F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("native_ms")).write.option("header", True).csv(path)
    return readers.read_csv_metrics(spark, path, "step long, native_ms double")


@query("read_ranked", "SELECT event_id AS rank, string_split_regex(event_type || ' ' || user_id, '[\\s,]+') AS puzzles FROM events WHERE event_id BETWEEN 100 AND 299")
def _(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("rank"), F.concat("event_type", F.lit(" "), F.col("user_id").cast("string")).alias("puzzles"))
    return readers.read_ranked(rows, 100, 200)


@query("skip_completed", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    path = _written(readers.jsonl(d.filter("doc_id % 3 = 0"), "doc_id").union(spark.createDataFrame([("{half a li",)], "value string")), spark, "done")
    return readers.skip_completed(d, path, ["doc_id"], "doc_id long")


@query("write_results", "SELECT c_custkey, c_acctbal FROM customer")
def _(spark, sf):
    rows, path = table(spark, sf, "customer").select("c_custkey", "c_acctbal"), new_path(spark, "results")
    readers.write_results(rows.limit(1), path, "20260101T000000Z")
    readers.write_results(rows, path, "20260102T000000Z")
    return readers.latest(spark, path).drop("run")
