"""Streaming queries: derived rows are written to the shared folder and streamed from there, a file for a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import new_path, stage_at
from ..streaming import jobs
from .content import LB, docs
from .registering import SQL, query, table
from .runs import _WITH, runs
from .versions import _EDITED, _STEPS, _bytes_of, churn_tables, edit_tables


def _stream(spark, rows, parts, name):
    staged, path = stage_at(rows.repartition(parts), name)
    return jobs.file_stream(spark, path, staged.schema)


@query("stream_match_prefix", SQL["match_prefix"])
def _(spark, sf):
    d = docs(spark, sf).select("doc_id", "text")
    requests = _stream(spark, d.filter("doc_id % 2 = 1"), 2, "requests")
    return spark.read.parquet(jobs.match_prefix(requests, d.filter("doc_id % 2 = 0"), LB)).drop("batch")


_LINE = "role || ': ' || text || chr(10) || chr(10)"


@query("stream_context_fingerprint", f"WITH r AS (SELECT conv_id, turn, conv_id * 1000 + turn AS k, hex(encode(string_agg({_LINE}, '') OVER (PARTITION BY conv_id ORDER BY turn))) AS h FROM conversations), {_bytes_of('r', 'k', 'h')} SELECT conv_id, turn, n AS n_bytes, fp1, fp2 FROM f JOIN r USING (k)")
def _(spark, sf):
    line = F.concat("role", F.lit(": "), "text", F.lit("\n\n"))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", line.alias("line"))
    return spark.read.parquet(jobs.drain(jobs.context_fingerprint(_stream(spark, turns, 3, "turns")), "append")).drop("batch")


@query("stream_edit_identity", f"{_EDITED} SELECT doc_id, step, fp1, fp2 FROM f JOIN ends USING (k)")
def _(spark, sf):
    """Fingerprints from the stream's state; the SQL hashes the edited content."""
    d, e = edit_tables(spark, sf)
    return _edited(spark, d, e, _STEPS // 2).drop("n")


def _edited(spark, d, e, every):
    to = e["to"] if "to" in e.columns else F.lit(None)
    rows = e.withColumn("to", to.cast("long")).join(d.withColumn("step", F.lit(1).cast("long")), ["doc_id", "step"], "left")
    rows = rows.select("doc_id", "step", "pos", F.col("del_len").cast("long").alias("del_len"), "ins", "to", "data")
    return spark.read.parquet(jobs.drain(jobs.edit_identity(_stream(spark, rows, 3, "edits"), every), "append")).drop("batch")


@query("stream_edit_churn", SQL["edit_churn_identity"])
def _(spark, sf):
    """Deletes, inserts and moves as they arrive, out of order; the SQL hashes the edited content."""
    return _edited(spark, *churn_tables(spark, sf), 4)


_LEAVES = f"p AS (SELECT doc_id, k, md5(substr(h, 1, {2 * LB} * k)) AS pre FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), unnest(range(length(h) // {2 * LB} + 1)) u(k))"


@query("stream_growing_cache", f"WITH {_LEAVES}, m AS (SELECT a.doc_id, a.k, min(c.doc_id) AS cached_id FROM p a JOIN p c ON a.k = c.k AND a.pre = c.pre AND a.doc_id % 2 = 1 AND c.doc_id % 2 = 0 AND c.doc_id % 3 < a.doc_id % 3 GROUP BY a.doc_id, a.k) SELECT doc_id, arg_max(cached_id, k) AS cached_id, max(k) * {LB} AS lcp FROM m GROUP BY doc_id")
def _(spark, sf):
    """Entries and requests in one stream of three batches (by id % 3): requests see the entries of earlier batches."""
    d = docs(spark, sf).select("doc_id", "text", (F.col("doc_id") % 2 == 1).alias("asks"))
    path = new_path(spark, "arrivals")
    for batch in range(3):
        d.filter(F.col("doc_id") % 3 == batch).coalesce(1).write.mode("append").parquet(path)
    found = jobs.growing_cache(jobs.file_stream(spark, path, d.schema), LB)
    return spark.read.parquet(jobs.drain(found, "append", lambda b: jobs.longest(b, LB))).drop("batch")


@query("stream_energy_window", "WITH l AS (SELECT user_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS us, value, lag(value) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT user_id AS device, time_bucket(INTERVAL 1 HOUR, ts) AS start, sum((value + p) / 2 * us / 1e6) AS joules FROM l WHERE p IS NOT NULL GROUP BY 1, 2")
def _(spark, sf):
    """Samples stream in time order; the joules of each tumbling hour."""
    ev = table(spark, sf, "events").select(F.col("user_id").alias("device"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("watts"))
    path, at = new_path(spark, "samples"), F.col("ts").cast("double")
    cuts = [float("-inf"), *ev.select(at.alias("at")).approxQuantile("at", [0.25, 0.5, 0.75], 0.01), float("inf")]
    for since, until in zip(cuts, cuts[1:]):  # later samples in later files; a device's samples of one span in one file
        ev.filter((at >= since) & (at < until)).repartition(4, "device").write.mode("append").parquet(path)
    parts = spark.read.parquet(jobs.drain(jobs.energy_parts(jobs.file_stream(spark, path, ev.schema, 4)), "append"))
    hours = parts.groupBy("device", F.window("ts", "1 hour").alias("w")).agg(F.sum("joules").alias("joules"))
    return hours.select("device", F.col("w.start").cast("timestamp_ntz").alias("start"), "joules")


@query("stream_run_stats", f"{_WITH} SELECT arm, n, count(value) AS n_values, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std FROM runs GROUP BY arm, n")
def _(spark, sf):
    stream = jobs.run_stats(_stream(spark, runs(spark, sf), 4, "landing-runs"), ["arm", "n"])
    return jobs.last_of(spark, jobs.drain(stream, "update"), ["arm", "n"])
