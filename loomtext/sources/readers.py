"""Readers with explicit schemas, and a writer of dated results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONVERSATION = "id string, turns array<struct<role:string,content:string>>, n_turns int"
TRACE = (
    "puzzle_id long, puzzle string, seed int, nodes array<struct<id:int,parent_id:int,depth:int,thought_text:string,value_label:string,value_score:double,"
    "in_beam:boolean,is_terminal:boolean,is_solution:boolean>>, beams map<string,array<int>>, solved boolean, solution_path array<int>"
)
RUN = "seed int, inv int, cells map<string,struct<mean:double,reps:int>>"
CELLS = (
    "cells array<struct<cell_id:string,regime:string,cache_on:boolean,seed:int,inv:int,L:long,"
    "track_a:struct<skipped:boolean,reason:string,detail:string,joules_per_token:double,ttft:double>,"
    "track_b:struct<latency:double,gate:struct<n_checks:long,mismatches:long>>>>"
)
CONTROLS = "seed int, all_detected boolean, rows array<struct<dataset:string,L:long,controls:string,all_detected:boolean,sample:array<struct<detected:boolean>>>>"
BENCHMARK = "group_id string, function_id string, value_str string"
ESTIMATES = "mean struct<point_estimate:double>"


def read_conversations_jsonl(spark: SparkSession, path: str, min_turns: int = 4) -> DataFrame:
    """Conversations of a JSON-lines file with at least min_turns; blank and broken lines are skipped."""
    rows = spark.read.schema(CONVERSATION).option("mode", "DROPMALFORMED").json(path)
    return rows.filter(F.col("id").isNotNull() & (F.size("turns") >= min_turns)).withColumn("n_turns", F.size("turns"))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """A row for each node of each search tree."""
    return spark.read.schema(TRACE).json(path).select("puzzle_id", "seed", F.inline("nodes"))


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """A row for each search tree, with its beams by depth and its path to the solution."""
    return spark.read.schema(TRACE).json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run files with cells keyed by size -> tidy rows (seed, inv, n, value, reps). Files that are missing are no error."""
    rows = spark.read.schema(RUN).option("multiLine", True).option("ignoreMissingFiles", True).json(path)
    return rows.select("seed", "inv", F.explode("cells").alias("n", "c")).select("seed", "inv", F.col("n").cast("long").alias("n"), F.col("c.mean").alias("value"), "c.reps")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """A row for each cell of nested grid documents: the cell's keys, and state 'measured', 'skipped' or 'absent' of its
    first track with the reason, its figures where measured, the second track's latency, and the gate's counts."""
    c = spark.read.schema(CELLS).option("multiLine", True).json(path).select(F.explode("cells").alias("c")).select("c.*")
    skipped = F.coalesce(F.col("track_a.skipped"), F.lit(False))
    state = F.when(F.col("track_a").isNull(), "absent").when(skipped, "skipped").otherwise("measured")
    known = lambda x: F.when(~skipped, F.col(f"track_a.{x}")).alias(x)
    gate = lambda x: F.when(F.col("track_b").isNotNull(), F.coalesce(f"track_b.gate.{x}", F.lit(0))).alias(x)
    return c.select("cell_id", "regime", "cache_on", "seed", "inv", F.col("L").alias("length"), state.alias("state"), F.when(skipped, F.col("track_a.reason")).alias("reason"), known("joules_per_token"), known("ttft"), F.col("track_b.latency").alias("latency"), gate("n_checks"), gate("mismatches"))


def read_controls(spark: SparkSession, path: str) -> DataFrame:
    """(key, total, detected) of each row of negative-control documents in both shapes: a number of controls with a flag
    (without it, the detected ones of the row's sample count), and a list of controls with a flag each.

    A file is read once, as a text, and parsed from there: a JSON reader of files goes back to the file for each value that
    is no string but is read as one, as `controls` is."""
    whole = spark.read.option("wholetext", True).text(path).select(F.from_json("value", CONTROLS).alias("d"))
    r = whole.select(F.explode("d.rows").alias("r")).select("r.*")
    listed = F.from_json("controls", "array<struct<detected:boolean>>")
    n, many = F.col("controls").try_cast("long"), F.col("controls").startswith("[")
    hits = lambda a: F.size(F.filter(F.coalesce(a, F.array().cast("array<struct<detected:boolean>>")), lambda x: F.coalesce(x["detected"], F.lit(False)))).cast("long")
    total = F.when(many, F.size(listed)).otherwise(n).cast("long")
    detected = F.when(many, hits(listed)).when(F.col("all_detected"), n).otherwise(hits(F.col("sample")))
    return r.select(F.coalesce("dataset", F.col("L").cast("string")).alias("key"), total.alias("total"), detected.alias("detected")).filter("total is not null")


def read_bench_estimates(spark: SparkSession, root: str, per: int, sizes: list[int]) -> DataFrame:
    """Benchmarks and their estimates from two trees of nested folders under root, joined by the folder inside the tree:
    (group_id, n, per_unit)."""
    read = lambda name, schema: spark.read.schema(schema).json(f"{root}/{name}/*/*/*").withColumn("folder", F.regexp_extract(F.input_file_name(), rf"/{name}/(.*)/[^/]*$", 1))
    n = F.col("value_str").cast("long")
    both = read("benchmark", BENCHMARK).join(read("estimates", ESTIMATES), "folder").filter(n.isin(sizes))
    return both.select("group_id", n.alias("n"), (F.col("mean.point_estimate") / per).alias("per_unit"))


def read_csv_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_ranked(rows: DataFrame, start: int, count: int, rank: str = "rank", listed: str = "puzzles") -> DataFrame:
    """Ranks [start, start + count) with the list column split."""
    return rows.filter(F.col(rank).between(start, start + count - 1)).withColumn(listed, F.split(F.btrim(listed), r"[\s,]+"))


def skip_completed(wanted: DataFrame, done_path: str, keys: list[str], schema: str) -> DataFrame:
    """wanted without the keys that the output already has; malformed lines there count for nothing."""
    done = wanted.sparkSession.read.schema(schema).option("mode", "DROPMALFORMED").json(done_path)
    return wanted.join(done.select(*keys).dropna(), keys, "left_anti")


def write_results(rows: DataFrame, path: str, stamp: str) -> None:
    """One folder for each run stamp; `latest` reads the newest."""
    rows.withColumn("run", F.lit(stamp)).write.mode("append").partitionBy("run").parquet(path)


def latest(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("partitionColumnTypeInference.enabled", False).parquet(path)
    newest = rows.agg(F.max("run")).first()[0]  # from partition values
    return rows.filter(F.col("run") == newest)


def jsonl(rows: DataFrame, *cols: Column | str) -> DataFrame:
    """One JSON text for each row."""
    return rows.select(F.to_json(F.struct(*cols)).alias("value"))
