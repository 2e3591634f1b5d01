"""Energy from power samples and counters, running totals, and completeness of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def energy_trapezoid(samples: DataFrame, device: str = "device", ts: str = "ts", watts: str = "watts", order: str | None = None) -> DataFrame:
    """(device, joules): trapezoids between neighbours; 0 below two samples. In the order of `order`, if given, a
    decreasing time is an error."""
    w = Window.partitionBy(device).orderBy(order or ts)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    dt = (micros(F.col(ts)) - micros(F.lag(ts).over(w))) / 1e6
    checked = F.when(dt < 0, F.raise_error(F.lit("time runs backwards")).cast("double")).otherwise(dt)
    part = (F.col(watts) + F.lag(watts).over(w)) / 2 * checked
    return samples.select(device, part.alias("j")).groupBy(device).agg(F.coalesce(F.sum("j"), F.lit(0.0)).alias("joules"))


def energy_counter(counters: DataFrame, order: str, device: str = "device", millijoules: str = "millijoules") -> DataFrame:
    """(device, joules): last minus first reading of a cumulative counter; a negative difference is an error."""
    d = (F.max_by(millijoules, order) - F.min_by(millijoules, order)) / 1000.0
    return counters.groupBy(device).agg(d.alias("joules")).withColumn("joules", F.when(F.col("joules") < 0, F.raise_error(F.lit("the counter ran backwards")).cast("double")).otherwise(F.col("joules")))


def energy_source(counter: DataFrame, integrated: DataFrame, device: str = "device") -> DataFrame:
    """(device, source, joules): the counter where there is one, else the integral, else null."""
    both = counter.withColumnRenamed("joules", "c").join(integrated.withColumnRenamed("joules", "t"), device, "full")
    source = F.when(F.col("c").isNotNull(), "counter").when(F.col("t").isNotNull(), "integration")
    return both.select(device, source.alias("source"), F.coalesce("c", "t").alias("joules"))


def trace_cumulative(rows: DataFrame, keys: list[str], order: list[str], cost: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("total", F.sum(cost).over(w))


def control_totals(counted: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """Totals and detections over records of two shapes: (controls int, all_detected) and (controls array<detected>)."""
    a = counted.select(*keys, F.col("controls").cast("long").alias("total"), F.when(F.col("all_detected"), F.col("controls")).otherwise(0).cast("long").alias("detected"))
    b = listed.select(*keys, F.size("controls").cast("long").alias("total"), F.size(F.filter("controls", lambda c: c["detected"])).cast("long").alias("detected"))
    return a.unionByName(b).groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("detected").alias("detected"))


def env_complete(cells: DataFrame, keys: list[str], clock: str, required: list[str]) -> DataFrame:
    """Do all measured cells have clock metadata and the required fields?"""
    whole = F.count_if(F.col(clock).isNotNull()) == F.count(F.lit(1))
    for c in required:
        whole = whole & (F.count_if(F.col(c).isNull()) == 0)
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col(clock).isNotNull()).alias("with_clock"), whole.alias("complete"))
