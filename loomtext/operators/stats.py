"""Statistics over repeated measurement runs: summaries, paired arms, tests, slopes, crossovers, coverage, verdicts.

Tables of runs are tidy: arm, seed, inv, n (size), rep, value. Everything is an aggregate, a join on cell keys or a
column expression, so partial aggregation does the work before any shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import join_checked, let, running_sum, stage

# Two-sided 95 % Student t by degrees of freedom; 1.96 beyond 30.
T_COARSE = {
    1: 12.71, 2: 4.30, 3: 3.18, 4: 2.78, 5: 2.57, 6: 2.45, 7: 2.36, 8: 2.31, 9: 2.26, 10: 2.23, 11: 2.20, 12: 2.18,
    13: 2.16, 14: 2.14, 15: 2.13, 16: 2.12, 18: 2.10, 20: 2.09, 25: 2.06, 30: 2.04, 31: 1.96,
}
T_FINE = {
    1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 11: 2.201, 12: 2.179, 13: 2.160, 14: 2.145, 15: 2.131,
    16: 2.120, 17: 2.110, 18: 2.101, 19: 2.093, 20: 2.086, 21: 2.080, 22: 2.074, 23: 2.069, 24: 2.064, 25: 2.060, 26: 2.056, 27: 2.052, 28: 2.048, 29: 2.045, 30: 2.042, 31: 1.96,
}


def rep_median(runs: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return runs.groupBy(*keys).agg(F.median(value).alias("median"))


def group_stats(runs: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """n, mean, both standard deviations (sample: 0 below two), min, max and cv; nulls are left out."""
    v = F.col(value)
    out = runs.groupBy(*keys).agg(F.count(v).alias("n_values"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std_pop"), F.coalesce(F.stddev_samp(v), F.when(F.count(v) > 0, 0.0)).alias("std_samp"), F.min(v).alias("min"), F.max(v).alias("max"))
    return out.withColumn("cv", F.col("std_samp") / F.nullif(F.col("mean"), F.lit(0.0)))


def latency_percentiles(runs: DataFrame, keys: list[str], value: str = "value", exact: bool = True) -> DataFrame:
    """p50, p90, p99: exact, or of a bounded sketch."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))) if exact else F.percentile_approx(value, [0.5, 0.9, 0.99], 10_000)
    return runs.groupBy(*keys).agg(p.alias("p")).select(*keys, *[F.col("p")[i].alias(x) for i, x in enumerate(("p50", "p90", "p99"))])


def latency_sketch(runs: DataFrame, keys: list[str], value: str = "value", k: int = 400) -> DataFrame:
    """(keys, sketch): a quantile sketch of each group, a few KB whatever its size, that can be merged; nulls are left out."""
    return runs.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merge_latency(sketches: DataFrame, keys: list[str], k: int = 400) -> DataFrame:
    """One sketch for each key from those of several increments."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def latency_estimates(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_values, p50, p90, p99): values whose ranks lie within about 1 % of the asked ones for k = 400."""
    at = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(q))
    return sketches.select(*keys, F.kll_sketch_get_n_double("sketch").alias("n_values"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"))


def bootstrap_ci(runs: DataFrame, keys: list[str], value: str = "value", draws: int = 2000, seed: int = 7) -> DataFrame:
    """2.5 and 97.5 % points of the median over resamples; picks are hashes of draw and place, so reruns agree.

    Draws are dealt over all partitions first and then meet their group's values, so one group is many tasks.
    """
    n = F.size("v")
    cells = stage(runs.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("v")).filter(n > 0), "bootstrap-cells")
    pick = F.transform(F.sequence(F.lit(1), n), lambda i: F.get("v", F.pmod(F.xxhash64(F.col("draw"), i, F.lit(seed)), n).cast("int")))
    middle = F.sort_array(pick)
    median = (F.get(middle, F.floor((n - 1) / 2).cast("int")) + F.get(middle, F.floor(n / 2).cast("int"))) / 2
    dealt = cells.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    dealt = dealt.repartition(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "draw")
    drawn = join_checked(dealt, cells, keys).select(*keys, median.alias("m"))
    return drawn.groupBy(*keys).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("p"), F.count(F.lit(1)).alias("draws")).select(*keys, F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"), "draws")


def resampled_ranks(sizes: DataFrame, keys: list[str], draws: int, seed: int) -> DataFrame:
    """sizes(keys, n) -> (keys, draw, n, lo, hi): the 0-based ranks, among a group's sorted values, of the two middle values of
    each resample of n picks with replacement (the same one twice for odd n).

    Picks are uniform numbers whose integer part of n u is the rank picked. The m-th smallest of n uniform numbers is
    beta(m, n - m + 1), and the next one above it the least of n - m uniform numbers on what is left, so a draw takes two
    random numbers and not n. Numbers are seeded by group and seed: reruns agree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (n, h) in enumerate(zip(batch.column("n").to_pylist(), batch.column("_h").to_pylist(), strict=True)):
                random, m = np.random.Generator(np.random.PCG64(h & (2**64 - 1))), (n + 1) // 2
                low = random.beta(m, n - m + 1, draws)
                high = low + (1 - low) * -np.expm1(np.log1p(-random.random(draws)) / max(n - m, 1)) if n % 2 == 0 else low
                ranks = [np.minimum((x * n).astype(np.int64), n - 1) for x in (low, high)]
                group = [c.take(pa.array(np.full(draws, i))) for c in batch.columns[: len(keys)]]
                yield pa.RecordBatch.from_arrays([*group, pa.array(np.arange(1, draws + 1)), *map(pa.array, ranks)], names=[*keys, "draw", "lo", "hi"])

    schema = ", ".join(f"`{k}` {sizes.schema[k].dataType.simpleString()}" for k in keys)
    return sizes.select(*keys, "n", F.xxhash64(*keys, F.lit(seed)).alias("_h")).mapInArrow(run, f"{schema}, draw long, lo long, hi long")


def bootstrap_median(runs: DataFrame, keys: list[str], value: str = "value", draws: int = 2000, seed: int = 7) -> DataFrame:
    """(keys, n, median, lo, hi): the median and the 2.5 and 97.5 % points of the medians of `draws` resamples.

    Values are counted first (equal ones are one row), ranked by running counts over range partitions, and each draw looks
    up the values at two ranks; so no group's values meet in one row or task, and a group of any size costs `draws` look-ups
    beside its sort. Nulls are left out; keys must not be null.
    """
    counts = runs.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    order = [*[F.col(k) for k in keys], F.col("_v")]
    ranked = stage(running_sum(counts, order, F.col("_c"), "_upto"), "ranked-counts")
    sizes = stage(ranked.groupBy(*keys).agg(F.sum("_c").alias("n"), (F.min(F.col("_upto") - F.col("_c"))).alias("_from")), "group-sizes")
    picked = resampled_ranks(sizes, keys, draws, seed).join(sizes, keys)
    asked = picked.select(*keys, "draw", F.explode(F.array("lo", "hi")).alias("_r"), "_from")
    middle = sizes.select(*keys, F.lit(0).cast("long").alias("draw"), F.explode(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))).alias("_r"), "_from")
    at = asked.unionByName(middle).select(*keys, "draw", (F.col("_from") + F.col("_r")).alias("_at"), F.lit(None).cast("double").alias("_v"))
    # ranks and values in one order: each rank takes the first value whose running count is above it
    both = at.unionByName(ranked.select(*keys, F.lit(None).cast("long").alias("draw"), (F.col("_upto") - 1).alias("_at"), "_v"))
    return _middles(stage(_looked_up(both), "looked-up"), keys, sizes)


def _looked_up(rows: DataFrame) -> DataFrame:
    """Rows (_at, _v, ...) of which those without _v take that of the next row with one in order of _at: in range partitions,
    each of which knows the first value of those behind it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("_at").desc(), F.col("_v").isNull()]  # backwards: a frame that grows is linear
    dealt = stage(rows.repartitionByRange(parts, F.col("_at"), F.col("_v").isNotNull()).withColumn("_p", F.spark_partition_id()), "ranges")
    firsts = {r["_p"]: r["v"] for r in dealt.filter("_v is not null").groupBy("_p").agg(F.min_by("_v", "_at").alias("v")).collect()}  # one row for each partition
    behind, after = {}, None
    for p in range(max(firsts, default=-1), -2, -1):
        behind[p] = after
        after = firsts.get(p, after)
    later = F.coalesce(*[F.when(F.col("_p") == p, F.lit(v)) for p, v in behind.items() if v is not None] or [F.lit(None).cast("double")])
    w = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn("_v", F.coalesce(F.last("_v", ignorenulls=True).over(w), later)).filter("draw is not null").drop("_p", "_at")


def _middles(rows: DataFrame, keys: list[str], sizes: DataFrame) -> DataFrame:
    medians = rows.groupBy(*keys, "draw").agg(F.avg("_v").alias("m"))
    points = F.percentile(F.when(F.col("draw") > 0, F.col("m")), F.array(F.lit(0.025), F.lit(0.975)))
    out = medians.groupBy(*keys).agg(F.max(F.when(F.col("draw") == 0, F.col("m"))).alias("median"), points.alias("p"))
    return out.join(sizes.select(*keys, "n"), keys).select(*keys, "n", "median", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))


def t_value(df: Column, table: dict[int, float]) -> Column:
    """The table's t at the nearest lower degrees of freedom: an as-of lookup in a constant array."""
    rows = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(t).alias("t")) for d, t in table.items()])
    return F.element_at(F.filter(rows, lambda r: r["d"] <= df), -1)["t"]


def t_interval(runs: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """mean, half = t s / sqrt(n), lo, hi; a single value has half 0."""
    s = group_stats(runs, keys, value)
    n = F.col("n_values")
    half = F.when(n > 1, t_value(n - 1, T_COARSE) * F.col("std_samp") / F.sqrt(n)).otherwise(0.0)
    return s.select(*keys, "mean", half.alias("half"), (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"))


def t_band(runs: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Run-to-run band mean +- t s."""
    s = group_stats(runs, keys, value)
    half = F.when(F.col("n_values") > 1, t_value(F.col("n_values") - 1, T_FINE) * F.col("std_samp")).otherwise(0.0)
    return s.select(*keys, "mean", (F.col("mean") - half).alias("band_lo"), (F.col("mean") + half).alias("band_hi"))


def per_seed_means(runs: DataFrame, cell: list[str], seed: str = "seed", value: str = "value") -> DataFrame:
    """Mean of each seed in a cell, and of the cell (seed null), from one rollup."""
    return runs.rollup(*cell, seed).agg(F.avg(value).alias("mean"), F.count(value).alias("n_values"), F.grouping_id().alias("level")).filter("level <= 1").drop("level")


def paired_arms(runs: DataFrame, keys: list[str], a: str, b: str, arm: str = "arm", value: str = "value") -> DataFrame:
    """(keys, a, b): means of two arms, only keys with both; one grouping, no join."""
    side = lambda x: F.avg(F.when(F.col(arm) == x, F.col(value)))
    return runs.filter(F.col(arm).isin(a, b)).groupBy(*keys).agg(side(a).alias("a"), side(b).alias("b")).filter("a is not null and b is not null")


def paired_delta(pairs: DataFrame) -> DataFrame:
    """delta a - b and ratio a / b; null where a side is null or 0."""
    a, b = (F.nullif(F.col(x), F.lit(0.0)) for x in "ab")
    return pairs.withColumn("delta", a - b).withColumn("ratio", a / b)


def paired_wins(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.count_if(F.col("a") < F.col("b")).alias("wins"), F.count_if(F.col("a") > F.col("b")).alias("losses"), F.count(F.lit(1)).alias("pairs"))


def _stirling_error(n: Column) -> Column:
    """ln n! - (ln(2 pi n) / 2 + n ln n - n): exact below 16, by Stirling's series from there on (error below 1e-16)."""
    exact = [0.0, *(math.lgamma(k + 1) - (math.log(2 * math.pi * k) / 2 + k * math.log(k) - k) for k in range(1, 16))]
    x = 1.0 / n.cast("double")
    series = x * (1 / 12 - x * x * (1 / 360 - x * x * (1 / 1260 - x * x * (1 / 1680 - x * x / 1188))))
    return F.when(n < 16, F.element_at(F.array(*[F.lit(e) for e in exact]), n.cast("int") + 1)).otherwise(series)


def log_point(n: Column, k: Column) -> Column:
    """ln P(X = k) for X binomial(n, 1/2), 0 < k <= n: Stirling errors and a deviance, so nothing under- or overflows."""
    rest = n - k
    d = (k - rest) / n
    # n KL(k/n || 1/2); the logarithms are of 1 + d and 1 - d, so the middle loses nothing
    deviance = n / 2.0 * ((1 + d) * F.log1p(d) + (1 - d) * F.log1p(-d))
    inner = _stirling_error(n) - _stirling_error(k) - _stirling_error(rest) - deviance + 0.5 * (F.log(n / k) - F.log(rest * (2 * math.pi)))
    return F.when(rest == 0, n * -math.log(2.0)).otherwise(inner)


def log_upper_tail(n: Column, k: Column) -> Column:
    """ln P(X >= k) for X binomial(n, 1/2) and n / 2 < k <= n: the point at k times 1 + r1 + r1 r2 + ..., whose terms, all
    positive, fall below 1e-17 of the sum after at most 5 sqrt(n) + 60 of them."""
    terms = F.least(n - k, (F.ceil(5 * F.sqrt(n)) + 60).cast("long"))
    zero = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(acc, j):
        t = acc["t"] * (n - k - j + 1) / (k + j)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    ratios = F.when(terms > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(terms, F.lit(1).cast("long"))), zero, step)["s"]).otherwise(1.0)
    return log_point(n, k) + F.log(ratios)


def upper_tail(n: Column, k: Column) -> Column:
    """P(X >= k) for X binomial(n, 1/2) and any n, in log space; below the middle by the complement. 0 only where the value
    is below the smallest double; log_upper_tail has its logarithm even then."""

    def of(x):
        far = F.greatest(x["k"], x["n"] - x["k"] + 1)  # P(X >= k) = 1 - P(X >= n - k + 1)
        tail = F.when(far > x["n"], 0.0).otherwise(F.exp(log_upper_tail(x["n"], far)))
        return F.when(x["k"] * 2 > x["n"], tail).otherwise(1.0 - tail)

    return let(F.struct(n.cast("long").alias("n"), k.cast("long").alias("k")), of)


def sign_test_one(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Exact one-sided sign test that a < b; ties dropped, null without pairs."""
    w = paired_wins(pairs, keys).withColumn("n_untied", F.col("wins") + F.col("losses"))
    return w.select(*keys, "wins", "n_untied", F.when(F.col("n_untied") > 0, upper_tail(F.col("n_untied"), F.col("wins"))).alias("p_value"))


def sign_test_two(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Two-sided: p_max doubles the larger side's tail (1 without pairs), p_min the smaller of both tails; at most 1."""
    w = paired_wins(pairs, keys).withColumn("n_untied", F.col("wins") + F.col("losses"))
    n, wins, losses = F.col("n_untied"), F.col("wins"), F.col("losses")
    tail = upper_tail(n, F.greatest(wins, losses))
    both = F.least(upper_tail(n, wins), upper_tail(n, losses))
    return w.select(*keys, "n_untied", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)).alias("p_max"), F.when(n > 0, F.least(F.lit(1.0), 2 * both)).alias("p_min"))


def speedups(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Ratio of means and mean of ratios of a over b: two different numbers."""
    return pairs.groupBy(*keys).agg((F.avg("a") / F.nullif(F.avg("b"), F.lit(0.0))).alias("ratio_of_means"), F.avg(F.col("a") / F.nullif(F.col("b"), F.lit(0.0))).alias("mean_of_ratios"))


def loglog_slope(cells: DataFrame, keys: list[str], x: str = "n", y: str = "mean", floor: float = 0.0) -> DataFrame:
    """OLS of ln y on ln x over x >= floor: slope, intercept, r2 (1 for constant y); null with a single x."""
    lx, ly = F.log(F.col(x).cast("double")), F.log(F.col(y))
    fit = cells.filter((F.col(x) >= floor) & (F.col(x) > 0) & (F.col(y) > 0)).groupBy(*keys)
    r2 = F.when(F.regr_syy(ly, lx) == 0, 1.0).otherwise(F.regr_r2(ly, lx))
    return fit.agg(F.regr_slope(ly, lx).alias("slope"), F.regr_intercept(ly, lx).alias("intercept"), r2.alias("r2"))


def per_run_slope(runs: DataFrame, arm: list[str], run: list[str], x: str = "n", y: str = "value") -> DataFrame:
    """A log-log slope inside each run over the sizes that all runs of the arm have; then mean and sample deviation."""
    cell = runs.groupBy(*arm, *run, x).agg(F.avg(y).alias("y"))
    n_runs = cell.select(*arm, *run).distinct().groupBy(*arm).agg(F.count(F.lit(1)).alias("_runs"))
    complete = cell.groupBy(*arm, x).agg(F.count(F.lit(1)).alias("_have")).join(n_runs, arm).filter("_have = _runs").select(*arm, x)
    slopes = loglog_slope(cell.join(complete, [*arm, x]), [*arm, *run], x, "y")
    return slopes.groupBy(*arm).agg(F.avg("slope").alias("slope_mean"), F.coalesce(F.stddev_samp("slope"), F.lit(0.0)).alias("slope_sd"), F.count("slope").alias("n_runs"))


def slope_per_doubling(cells: DataFrame, keys: list[str], x: str = "n", y: str = "mean") -> DataFrame:
    return cells.groupBy(*keys).agg(F.regr_slope(F.col(y), F.log2(F.col(x).cast("double"))).alias("per_doubling"))


def sides(stats: DataFrame, keys: list[str], a: str, b: str, arm: str = "arm") -> DataFrame:
    """(keys, n, mean_a, std_a, mean_b, std_b) from the arms' statistics by size."""
    get = lambda x, c, name: F.max(F.when(F.col(arm) == x, F.col(c))).alias(name)
    return stats.groupBy(*keys, "n").agg(get(a, "mean", "mean_a"), get(a, "std_samp", "std_a"), get(b, "mean", "mean_b"), get(b, "std_samp", "std_b"))


def crossovers(both: DataFrame, keys: list[str]) -> DataFrame:
    """Where a becomes faster than b: by bands (mean_a + std_a < mean_b - std_b), by means, and as a bracket
    (largest n where b is faster, smallest n where a is not slower)."""
    band = (F.col("mean_a") + F.col("std_a")) < (F.col("mean_b") - F.col("std_b"))
    at = lambda how, cond: how(F.when(cond, F.col("n")))
    a, b = F.col("mean_a"), F.col("mean_b")
    return both.groupBy(*keys).agg(at(F.min, band).alias("cross_band"), at(F.min, a < b).alias("cross_mean"), at(F.max, b < a).alias("bracket_lo"), at(F.min, a <= b).alias("bracket_hi"))


def crossover_stable(both: DataFrame, keys: list[str], tolerance: float = 1.001) -> DataFrame:
    """Does the band hold from its crossover on, and is b no slower below it (within tolerance)? Null without a crossover."""
    rows = both.join(crossovers(both, keys).select(*keys, "cross_band"), keys)
    band = (F.col("mean_a") + F.col("std_a")) < (F.col("mean_b") - F.col("std_b"))
    above = F.bool_and(F.when(F.col("n") >= F.col("cross_band"), band))
    below = F.bool_and(F.when(F.col("n") < F.col("cross_band"), F.col("mean_b") <= F.col("mean_a") * tolerance))
    return rows.groupBy(*keys, "cross_band").agg(F.when(F.col("cross_band").isNotNull(), F.coalesce(above, F.lit(True)) & F.coalesce(below, F.lit(True))).alias("stable"))


def grid_neighbour(both: DataFrame, keys: list[str], target: int, column: str = "cross_mean") -> DataFrame:
    """Is the crossover within one step of the size grid from `target`? The grid, a row of distinct sizes, is a scalar."""
    grid = both.agg(F.sort_array(F.collect_set("n")).alias("grid")).scalar()
    step = lambda n: F.nullif(F.array_position(grid, n), F.lit(0).cast("long"))
    goal = step(F.lit(target).cast(both.schema["n"].dataType))
    return crossovers(both, keys).select(*keys, F.col(column).alias("cross")).withColumn("near", F.abs(step(F.col("cross")) - goal) <= 1)


def monotone_increasing(cells: DataFrame, keys: list[str], x: str = "n", y: str = "mean") -> DataFrame:
    before = F.lag(y).over(Window.partitionBy(*keys).orderBy(x))
    return cells.withColumn("_up", before.isNull() | (F.col(y) > before)).groupBy(*keys).agg(F.bool_and("_up").alias("increasing"))


def losing_cells(both: DataFrame, keys: list[str]) -> DataFrame:
    """Cells where a does not win."""
    return both.filter(F.col("mean_b") <= F.col("mean_a")).select(*keys, "n", "mean_a", "mean_b")


def grid_coverage(runs: DataFrame, axes: list[str]) -> DataFrame:
    """Cells of the full grid of the axes' values that no run has. The axes' values meet in one row, which unfolds axis by
    axis; the grid of an experiment is its output."""
    have = runs.select(*axes).distinct()
    grid = have.agg(*[F.collect_set(x).alias(x) for x in axes])
    for x in axes:
        grid = grid.withColumn(x, F.explode(x))
    return grid.join(have, axes, "left_anti")


def criterion(clauses: DataFrame, keys: list[str]) -> DataFrame:
    """clauses(keys, clause, hard, ok) -> verdict: a false hard clause FAILED, all true SUPPORTED, else NOT SUPPORTED."""
    hard_ok = F.coalesce(F.bool_and(F.when(F.col("hard"), F.col("ok"))), F.lit(True))
    return clauses.groupBy(*keys).agg(F.when(~hard_ok, "FAILED").when(F.bool_and("ok"), "SUPPORTED").otherwise("NOT SUPPORTED").alias("verdict"), F.count(F.lit(1)).alias("n_clauses"))


def off_on_effect(cells: DataFrame, keys: list[str], off: str, on: str, arm: str = "arm") -> DataFrame:
    """Paired effect of a switch over cells(keys, seed, inv, arm, joules_per_token, ttft): energy ratio off/on, mean
    ttft gain, regressions (on needs more energy), one-sided sign test."""
    get = lambda x, c: F.max(F.when(F.col(arm) == x, F.col(c)))
    pair = cells.groupBy(*keys, "seed", "inv").agg(get(off, "joules_per_token").alias("b"), get(on, "joules_per_token").alias("a"), get(off, "ttft").alias("t_off"), get(on, "ttft").alias("t_on")).filter("a is not null and b is not null")
    effect = pair.groupBy(*keys).agg(F.avg(F.col("b") / F.nullif(F.col("a"), F.lit(0.0))).alias("energy_ratio"), F.avg(F.col("t_off") - F.col("t_on")).alias("ttft_gain"), F.count_if(F.col("a") > F.col("b")).alias("regressions"))
    return effect.join(sign_test_one(pair, keys).select(*keys, "p_value"), keys)


def arm_latency(runs: DataFrame, keys: list[str], cell: list[str], a: str, b: str, arm: str = "arm", value: str = "value") -> DataFrame:
    """Mean of cell means of both arms and their difference b - a."""
    means = runs.groupBy(*keys, *cell, arm).agg(F.avg(value).alias("m"))
    side = lambda x: F.avg(F.when(F.col(arm) == x, F.col("m")))
    return means.groupBy(*keys).agg(side(a).alias("latency_a"), side(b).alias("latency_b"), (side(b) - side(a)).alias("delta"))


def rates(rows: DataFrame, tokens: str, seconds: str, joules: str) -> DataFrame:
    """tokens_per_second and joules_per_token of each row; null on zero."""
    return rows.withColumns({"tokens_per_second": F.try_divide(F.col(tokens), F.col(seconds)), "joules_per_token": F.try_divide(F.col(joules), F.col(tokens))})
