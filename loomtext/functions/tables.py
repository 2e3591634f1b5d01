"""Staged tables, size-checked joins, Bloom filters, ranks and running sums without a single sorting task."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table is broadcast only when its measured bytes stay at or below this number.
BROADCAST_BYTES = 16 << 20

#: While a table is staged: its shuffle files go as soon as the write ends, and batches for Python stay small.
_WHILE = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where there is one machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("loomtext.shared.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-loomtext-")
        spark.conf.set("loomtext.shared.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/loomtext-{name}-{uuid.uuid4().hex}"


def stage_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: lineage ends here and a lost executor loses nothing.

    Shuffle files of the write are dropped as soon as it ends, so that a job of many steps holds one step's files.
    """
    spark = df.sparkSession
    path, before = new_path(spark, name), {k: spark.conf.get(k, None) for k in _WHILE}
    for k, v in _WHILE.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path), path


@contextlib.contextmanager
def dealt_finely(spark: SparkSession, times: int = 16) -> Iterator[None]:
    """What is staged meanwhile is dealt into `times` as many partitions as usual, which adaptive execution joins again while
    they are small; so a task's share stops growing at the advised partition size."""
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(times * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    return stage_at(df, name)[0]


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; files outside of the shared folder are left alone."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if "/loomtext-" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _width(column: Column, kind: T.DataType) -> Column:
    """Bytes of a value, roughly: 8 for each number, the length of strings and binaries."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            return F.coalesce(F.aggregate(column, F.lit(0).cast("long"), lambda acc, x: acc + _width(x, kind.elementType)), F.lit(0)) + 16
        return 8 * F.greatest(F.size(column), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_width(column[f.name], f.dataType) for f in kind), F.lit(16))
    return F.lit(8)


def measured_bytes(df: DataFrame) -> int:
    """Bytes that the rows of df take in memory, from one aggregate over them."""
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(32))
    return int(df.agg(F.sum(width.cast("long"))).first()[0] or 0)


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a broadcast where small has at most `most` measured bytes (pass a staged table), else with a shuffled
    join whose large partitions adaptive execution splits."""
    return big.join(F.broadcast(small) if measured_bytes(small) <= most else small, on, how)


class Bloom:
    """A test of 64-bit hashes against those of a staged table's rows: false only for hashes that are not there.

    The filter is an array of at most most_bits / 64 longs (4 MB), whatever the table's size: beyond two million rows
    it lets more of the others pass, and callers must judge those that pass exactly or treat them alike.
    """

    def __init__(self, rows: DataFrame, hashed: Column, bits_for_each: int = 16, most_bits: int = 1 << 25):
        spark, n, self.bits = rows.sparkSession, rows.count(), 64
        while self.bits < min(n * bits_for_each, most_bits):
            self.bits *= 2
        marks = rows.select(F.explode(F.array(*self._marks(hashed))).alias("b"))
        marks = marks.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v"))
        full = spark.range(self.bits // 64).join(marks, F.col("id") == F.col("w"), "left").select("id", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
        self.words = stage(full.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "v"))), lambda x: x["v"]).alias("words")), "bloom")

    def _marks(self, h: Column) -> list[Column]:
        return [h.bitwiseAND(F.lit(self.bits - 1)), F.shiftrightunsigned(h, 34).bitwiseAND(F.lit(self.bits - 1))]

    def holds(self, h: Column) -> Column:
        words_ = self.words.scalar()
        hit = lambda b: F.getbit(F.get(words_, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1
        one, two = self._marks(h)
        return hit(one) & hit(two)

    def in_tasks(self) -> Callable[[np.ndarray], np.ndarray]:
        """The same test for arrays of unsigned hashes inside Python tasks."""
        words_ = self.words.toArrow().column(0).combine_chunks().values.to_numpy(zero_copy_only=False).view(np.uint64)
        shared, most = self.words.sparkSession.sparkContext.broadcast(words_), np.uint64(self.bits - 1)

        def holds(h: np.ndarray) -> np.ndarray:
            w, ok = shared.value, np.ones(len(h), dtype=bool)
            for b in (h & most, (h >> np.uint64(34)) & most):
                ok &= ((w[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1)).astype(bool)
            return ok

        return holds


def bloom(keys: DataFrame, key: Callable[[], Column]) -> Callable[[Column], Column]:
    """The test of a Bloom filter over a key of any type."""
    held = Bloom(keys, F.xxhash64(key()))
    return lambda value: held.holds(F.xxhash64(value))


def _dealt(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> tuple[DataFrame, list[Column]]:
    """df in staged range partitions, with (_at: partition) and the totals of `sums` in the partitions before each."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(df.repartitionByRange(parts, *order).withColumn("_at", F.spark_partition_id()), "ranges")
    rows = dealt.groupBy("_at").agg(*[F.sum(c).alias(x) for x, c in sums.items()]).collect()  # one row for each partition
    totals = {r["_at"]: r for r in rows}
    before = []
    for x in sums:
        run, listed = 0, []
        for at in range(max(totals, default=-1) + 1):
            listed.append(run)
            run += (totals[at][x] or 0) if at in totals else 0
        before.append(F.element_at(F.expr("array(" + ",".join(f"{n}L" for n in listed or [0]) + ")"), F.col("_at") + 1))
    return dealt, before


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """0-based rank over the whole table: range partitions, a row number in each, and the counts of those before."""
    dealt, before = _dealt(df, order, {"n": F.lit(1)})
    local = F.row_number().over(Window.partitionBy("_at").orderBy(*order)) - 1
    return dealt.withColumn(name, (local + before[0]).cast("long")).drop("_at")


def running_sum(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """The sum of value over all rows up to each, in the given order, found like global_rank."""
    dealt, before = _dealt(df, order, {"n": value})
    w = Window.partitionBy("_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn(name, (F.sum(value).over(w) + before[0]).cast("long")).drop("_at")


def scan(df: DataFrame, keys: list[str], order: str, sums: dict[str, str], block: int = 4096) -> DataFrame:
    """df, staged, with running sums: {new column: summed column}, within keys, along the whole numbers `order`, in two levels.

    Rows are summed along in blocks of `block` places, the blocks' totals along each key, and each block gets the totals of
    those before it; so a key with very many rows is many tasks. Sums must fit a long. Only keys of several blocks are
    joined, and theirs are few rows: one for each block.
    """
    at = F.floor(F.col(order) / block).cast("long")
    inner = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = stage(df.withColumn("_block", at).select("*", *[F.sum(c).over(inner).alias(x) for x, c in sums.items()]), "scan-blocks")
    totals = rows.groupBy(*keys, "_block").agg(*[F.sum(c).alias(x) for x, c in sums.items()])
    long = stage(totals.join(rows.filter("_block > 0").select(*keys).distinct(), keys, "left_semi"), "scan-totals")
    along = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = stage(long.select(*keys, "_block", *[F.coalesce(F.sum(x).over(along), F.lit(0)).alias(f"_before_{x}") for x in sums]), "scan-offsets")
    out = join_checked(rows, before, [*keys, "_block"], "left")
    return out.withColumns({x: F.col(x) + F.coalesce(F.col(f"_before_{x}"), F.lit(0)) for x in sums}).drop("_block", *[f"_before_{x}" for x in sums])


def let(value: Column, body) -> Column:
    """body(x) with x bound to value, which is then evaluated once."""
    return F.transform(F.array(value), body)[0]
