"""Exact deduplication as a stream: keyed state on disk holds digest, stable identifier and content locator.

The documents' keys (digest, id, length, locator) arrive as a stream. The state, one entry for each digest, lives in
RocksDB under the checkpoint folder and never expires; it keeps the best row so far, its locator (file and position, by
which the row is read again) and a count. Each micro-batch emits the entries that it changed, and the last emission of a
digest is its group. Every row that hit a digest is then checked on full bytes before anything is decided: its text, read
again by its locator, is compared with its keeper's, in one join on the digest in which large groups are dealt over
copies of the keeper's text. Texts that were never hit stay where they are. Rows whose texts differ under one digest
(none are known for SHA-256) are grouped by their full text instead.

Null text counts as empty, all empty texts are equal. Ties go to the smallest doc_id, a null doc_id loses to any
other; of fully equal rows the first by its locator stays. doc_id may have any type that has an order. Rows that share
an id are rows of their own. Extra columns, whatever their names, do no harm. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, join_checked, new_path, of_row, picked, rows_of, stage, stage_at, text_or_empty, unpacked, without

_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of many small stores holds some MB of disk ahead
    "spark.sql.streaming.minBatchesToRetain": "1",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def _group() -> list[Column]:
    """Size and best row of a group: most code points, then smallest id (null last), then first locator."""
    best = F.struct((-F.col("n_points")).alias("neg_points"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("at"))
    return [F.count(F.lit(1)).alias("group_size"), F.min(best).alias("best")]


def normalised(text: Column) -> Column:
    """The text without white space."""
    return F.translate(text_or_empty(text), SPACES, "")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def keyed_state(keys: DataFrame, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Run the stream over the staged keys(doc_id, digest, n_points, at); (digest, group_size, best) as the state has
    them at the end."""
    spark = keys.sparkSession
    updates, before = new_path(spark, "updates"), {k: spark.conf.get(k, None) for k in _ROCKS}
    for k, v in _ROCKS.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(keys.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
        state = stream.groupBy("digest").agg(*_group())

        def emit(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

        query = state.writeStream.outputMode("update").foreachBatch(emit).option("checkpointLocation", new_path(spark, "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    empty = keys.groupBy("digest").agg(*_group())
    if not keys.limit(1).count():
        return empty
    last = spark.read.schema(empty.withColumn("batch", F.lit(0)).schema).parquet(updates)
    return last.groupBy("digest").agg(F.max_by(F.struct("group_size", "best"), "batch").alias("s")).select("digest", "s.group_size", "s.best")


def clashes(rows: DataFrame, keys: DataFrame, groups: DataFrame, text: str = "text", digest: Callable[[Column], Column] = _digest, hot: int = 1000) -> DataFrame:
    """Digests of the staged groups(digest, group_size, best) under which a full text of rows(row, at) differs from its
    keeper's; keys(digest, at) are those of the rows.

    Rows that were hit are known by their places before any text is read; only their texts are hashed and moved. The
    keeper's text of a group of more than `hot` rows is copied, one for each `hot` of them, and its rows are dealt over
    the copies. The groups that are told to all tasks for that are fewer than 100,000, whatever the table's size.
    """
    hits = stage(groups.filter("group_size > 1").select("digest", F.col("best.at").alias("at"), "group_size"), "hits")
    total = hits.agg(F.sum("group_size")).first()[0]
    if not total:
        return hits.select("digest")
    hot = max(hot, total // 100_000)
    parts = F.when(F.col("group_size") > hot, F.ceil(F.col("group_size") / hot)).otherwise(1).cast("int")
    copies = stage(keys.select("digest", "at").join(hits.select("digest", F.col("at").alias("head")), "digest").filter("at <> head").select("at"), "hit-places")
    texts = lambda df: df.select(digest(of_row(text)).alias("digest"), "at", normalised(of_row(text)).alias("full"))
    keepers = texts(picked(rows, hits)).join(hits.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))), ["digest", "at"])
    large = hits.filter(F.col("group_size") > hot).select("digest", parts.alias("parts"))
    dealt = texts(picked(rows, copies)).join(F.broadcast(large), "digest", "left")
    dealt = dealt.select("digest", F.pmod(F.xxhash64("at"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "full")
    met = dealt.join(keepers.select("digest", "part", F.col("full").alias("kept")).hint("merge"), ["digest", "part"])
    return met.filter("full <> kept").select("digest").distinct()


def _grouped(rows: DataFrame, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    """For rows(row, at): doc_id, digest, at, group_size, best."""
    measured = [of_row("doc_id").alias("doc_id"), digest(of_row(text)).alias("digest"), F.length(text_or_empty(of_row(text))).alias("n_points"), F.col("at")]
    keys, path = stage_at(rows.select(*measured), "keys")
    groups = stage(keyed_state(keys, path), "groups")
    bad = stage(clashes(rows, keys, groups, text, digest), "clashes")
    out = keys.join(groups, "digest")
    if bad.limit(1).count():
        split = stage(join_checked(rows.select(*measured, normalised(of_row(text)).alias("full")), bad, ["digest"]), "split")
        texts = split.groupBy("digest", "full").agg(*_group())
        out = join_checked(out, bad, ["digest"], "left_anti").unionByName(split.join(texts, ["digest", "full"]).drop("full"))
    return out.drop("n_points")


def exact_groups(docs: DataFrame, text: str = "text", files: bool = False, digest: Callable[[Column], Column] = _digest) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256. `files`: see common.rows_of."""
    rows = _grouped(rows_of(docs, files), text, digest)
    return rows.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("at") == F.col("best.at")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, text: str = "text", files: bool = False, digest: Callable[[Column], Column] = _digest) -> DataFrame:
    """One row of each group of equal texts, that which exact_groups keeps, with the columns of docs."""
    rows = rows_of(docs, files)
    gone = stage(_grouped(rows, text, digest).filter(F.col("at") != F.col("best.at")).select("at"), "copies")
    return unpacked(without(rows, gone), docs.columns)
