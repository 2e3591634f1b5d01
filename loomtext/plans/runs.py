"""Queries over measurement runs, energy samples and serving records, derived from lineitem and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import join_checked, stage
from ..operators import stats, timeseries
from .registering import query, table

#: lineitem as runs: two arms, three seeds and invocations, four sizes, five repetitions.
RUNS = """
SELECT l_linestatus AS arm, 42 + l_suppkey % 3 AS seed, l_partkey % 3 AS inv,
       CASE (l_linenumber - 1) % 4 WHEN 0 THEN 1000 WHEN 1 THEN 10000 WHEN 2 THEN 100000 ELSE 1000000 END AS n,
       l_orderkey % 5 AS rep, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2, 3, 4, 5"""
_WITH = f"WITH runs AS ({RUNS})"
_STATS = f"{_WITH}, s AS (SELECT arm, n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std FROM runs GROUP BY arm, n)"
_BOTH = f"{_STATS}, both_ AS (SELECT n, max(CASE WHEN arm = 'F' THEN mean END) AS mean_a, max(CASE WHEN arm = 'F' THEN std END) AS std_a, max(CASE WHEN arm = 'O' THEN mean END) AS mean_b, max(CASE WHEN arm = 'O' THEN std END) AS std_b FROM s GROUP BY n)"
_PAIRS = f"{_WITH}, m AS (SELECT arm, n, seed, inv, avg(value) AS v FROM runs GROUP BY ALL), pairs AS (SELECT x.n, x.seed, x.inv, x.v AS a, y.v AS b FROM m x JOIN m y USING (n, seed, inv) WHERE x.arm = 'F' AND y.arm = 'O')"
_T = lambda table_: "(SELECT arg_max(t, d) FROM (VALUES " + ", ".join(f"({d}, {t})" for d, t in table_.items()) + ") AS tt(d, t) WHERE d <= k - 1)"
_BINOMIAL = "(SELECT sum(exp(lgamma(n_ + 1) - lgamma(i + 1) - lgamma(n_ - i + 1) - n_ * ln(2.0))) FROM range(0, 1000) r(i) WHERE i BETWEEN k_ AND n_)"


def runs(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    size = F.element_at(F.array(*[F.lit(10**k) for k in (3, 4, 5, 6)]), ((F.col("l_linenumber") - 1) % 4 + 1).cast("int"))
    keys = [F.col("l_linestatus").alias("arm"), (F.col("l_suppkey") % 3 + 42).alias("seed"), (F.col("l_partkey") % 3).alias("inv"), size.alias("n"), (F.col("l_orderkey") % 5).alias("rep")]
    return li.groupBy(*keys).agg(F.avg("l_extendedprice").alias("value"))


def pairs(spark, sf):
    return stats.paired_arms(runs(spark, sf), ["n", "seed", "inv"], "F", "O")


def both(spark, sf):
    return stats.sides(stats.group_stats(runs(spark, sf), ["arm", "n"]), [], "F", "O")


def _arm(df, keys):
    return df.withColumn("pair", F.lit("F/O")).select("pair", *keys)


@query("rep_median", f"{_WITH} SELECT arm, seed, inv, n, median(value) AS median FROM runs GROUP BY ALL")
def _(spark, sf):
    return stats.rep_median(runs(spark, sf), ["arm", "seed", "inv", "n"])


@query("group_stats", f"{_WITH} SELECT arm, n, count(value) AS n_values, avg(value) AS mean, stddev_pop(value) AS std_pop, coalesce(stddev_samp(value), 0) AS std_samp, min(value) AS min, max(value) AS max FROM runs GROUP BY arm, n")
def _(spark, sf):
    return stats.group_stats(runs(spark, sf), ["arm", "n"]).drop("cv")


@query("cv", f"{_WITH} SELECT arm, n, coalesce(stddev_samp(value), 0) / avg(value) AS cv FROM runs GROUP BY arm, n")
def _(spark, sf):
    return stats.group_stats(runs(spark, sf), ["arm", "n"]).select("arm", "n", "cv")


@query("latency_percentiles", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.9) AS p90, quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY 1")
def _(spark, sf):
    return stats.latency_percentiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")


@query("latency_estimates", "SELECT l_returnflag, count(*) AS n_values, true AS near FROM lineitem GROUP BY 1")
def _(spark, sf):
    """Percentiles by sketches of two increments, merged: the share of values up to each is within 2 % of what was asked."""
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", F.col("l_extendedprice").cast("double").alias("value"))
    increments = [stats.latency_sketch(li.filter(F.col("l_orderkey") % 2 == k), ["l_returnflag"]) for k in (0, 1)]
    guess = stats.latency_estimates(stats.merge_latency(increments[0].unionByName(increments[1]), ["l_returnflag"]), ["l_returnflag"])
    points = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    shares = join_checked(li, stage(guess, "latency-guess"), ["l_returnflag"]).groupBy("l_returnflag", "n_values").agg(*[F.avg((F.col("value") <= F.col(p)).cast("double")).alias(p) for p in points])
    near = [F.abs(F.col(p) - q) <= 0.02 for p, q in points.items()]
    return shares.select("l_returnflag", "n_values", (near[0] & near[1] & near[2]).alias("near"))


@query("bootstrap_ci")
def _(spark, sf):
    return stats.bootstrap_ci(runs(spark, sf), ["arm", "n"], draws=2000)


@query("bootstrap_median")
def _(spark, sf):
    """Medians of prices with resampled bounds: groups of any size, no array of their values."""
    return stats.bootstrap_median(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")


@query("t_interval", f"{_WITH}, s AS (SELECT arm, n, count(*) AS k, avg(value) AS mean, stddev_samp(value) AS sd FROM runs GROUP BY arm, n), h AS (SELECT *, CASE WHEN k > 1 THEN {_T(stats.T_COARSE)} * sd / sqrt(k) ELSE 0 END AS half FROM s) SELECT arm, n, mean, half, mean - half AS lo, mean + half AS hi FROM h")
def _(spark, sf):
    return stats.t_interval(runs(spark, sf), ["arm", "n"])


@query("t_band", f"{_WITH}, s AS (SELECT arm, n, count(*) AS k, avg(value) AS mean, stddev_samp(value) AS sd FROM runs GROUP BY arm, n), h AS (SELECT *, CASE WHEN k > 1 THEN {_T(stats.T_FINE)} * sd ELSE 0 END AS half FROM s) SELECT arm, n, mean, mean - half AS band_lo, mean + half AS band_hi FROM h")
def _(spark, sf):
    return stats.t_band(runs(spark, sf), ["arm", "n"])


@query("per_seed_means", f"{_WITH} SELECT arm, n, seed, avg(value) AS mean, count(value) AS n_values FROM runs GROUP BY arm, n, seed UNION ALL SELECT arm, n, NULL, avg(value), count(value) FROM runs GROUP BY arm, n")
def _(spark, sf):
    return stats.per_seed_means(runs(spark, sf), ["arm", "n"])


@query("paired_arms", f"{_PAIRS} SELECT * FROM pairs")
def _(spark, sf):
    return pairs(spark, sf)


@query("paired_delta", f"{_PAIRS} SELECT *, a - b AS delta, a / b AS ratio FROM pairs")
def _(spark, sf):
    return stats.paired_delta(pairs(spark, sf))


@query("paired_wins", f"{_PAIRS} SELECT n, count_if(a < b) AS wins, count_if(a > b) AS losses, count(*) AS pairs FROM pairs GROUP BY n")
def _(spark, sf):
    return stats.paired_wins(pairs(spark, sf), ["n"])


@query("sign_test_one", f"{_PAIRS}, w AS (SELECT n, count_if(a < b) AS wins, count_if(a <> b) AS n_untied FROM pairs GROUP BY n) SELECT n, wins, n_untied, CASE WHEN n_untied > 0 THEN {_BINOMIAL.replace('n_', 'n_untied').replace('k_', 'wins')} END AS p_value FROM w")
def _(spark, sf):
    return stats.sign_test_one(pairs(spark, sf), ["n"])


@query("sign_test_two", f"{_PAIRS}, w AS (SELECT n, count_if(a < b) AS wins, count_if(a > b) AS losses, count_if(a <> b) AS nn, greatest(count_if(a < b), count_if(a > b)) AS top FROM pairs GROUP BY n) SELECT n, nn AS n_untied, CASE WHEN nn = 0 THEN 1 ELSE least(1, 2 * {_BINOMIAL.replace('n_', 'nn').replace('k_', 'top')}) END AS p_max, CASE WHEN nn > 0 THEN least(1, 2 * least({_BINOMIAL.replace('n_', 'nn').replace('k_', 'wins')}, {_BINOMIAL.replace('n_', 'nn').replace('k_', 'losses')})) END AS p_min FROM w")
def _(spark, sf):
    return stats.sign_test_two(pairs(spark, sf), ["n"])


#: The first two lines of each order as a pair, in three parts of thousands of pairs each; weights of a binomial relative
#: to its middle, by cumulated logarithms of their ratios.
_LINE_PAIRS = """WITH o AS (SELECT l_orderkey % 3 AS part, max(CASE WHEN l_linenumber = 1 THEN l_extendedprice END) AS a, max(CASE WHEN l_linenumber = 2 THEN l_extendedprice END) AS b FROM lineitem GROUP BY l_orderkey),
w AS (SELECT part, count_if(a < b)::BIGINT AS wins, count_if(a <> b)::BIGINT AS n FROM o WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY part),
i AS (SELECT part, wins, n, unnest(range((n + 1) // 2, n + 1)) AS i FROM w),
t AS (SELECT part, wins, n, i, exp(sum(CASE WHEN 2 * i > n + 1 THEN ln((n - i + 1) / i) ELSE 0 END) OVER (PARTITION BY part ORDER BY i)) AS x FROM i),
g AS (SELECT part, any_value(wins) AS wins, any_value(n) AS n, sum(CASE WHEN 2 * i = n THEN x ELSE 2 * x END) AS total, sum(x) FILTER (i >= greatest(wins, n - wins + 1)) AS up, sum(x) FILTER (i >= greatest(n - wins, wins + 1)) AS down FROM t GROUP BY part),
p AS (SELECT part, wins, n, CASE WHEN 2 * wins > n THEN up / total ELSE 1 - coalesce(up, 0) / total END AS one, CASE WHEN 2 * (n - wins) > n THEN down / total ELSE 1 - coalesce(down, 0) / total END AS other FROM g)"""


@query("sign_tests_large", f"{_LINE_PAIRS} SELECT part, wins, n AS n_untied, one AS p_one, least(1, 2 * CASE WHEN 2 * wins >= n THEN one ELSE other END) AS p_max, least(1, 2 * least(one, other)) AS p_min FROM p")
def _(spark, sf):
    """One- and two-sided sign tests of groups of thousands of pairs: is an order's first line cheaper than its second?"""
    line = lambda k: F.max(F.when(F.col("l_linenumber") == k, F.col("l_extendedprice")))
    p = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(line(1).alias("a"), line(2).alias("b")).filter("a is not null and b is not null")
    p = p.withColumn("part", F.col("l_orderkey") % 3)
    one = stats.sign_test_one(p, ["part"]).withColumnRenamed("p_value", "p_one")
    return one.join(stats.sign_test_two(p, ["part"]).drop("n_untied"), "part")


@query("speedup_ratio_of_means", f"{_PAIRS} SELECT n, avg(a) / avg(b) AS ratio_of_means FROM pairs GROUP BY n")
def _(spark, sf):
    return stats.speedups(pairs(spark, sf), ["n"]).drop("mean_of_ratios")


@query("speedup_mean_of_ratios", f"{_PAIRS} SELECT n, avg(a / b) AS mean_of_ratios FROM pairs GROUP BY n")
def _(spark, sf):
    return stats.speedups(pairs(spark, sf), ["n"]).drop("ratio_of_means")


@query("loglog_slope", f"{_STATS} SELECT arm, regr_slope(ln(mean), ln(n)) AS slope, regr_intercept(ln(mean), ln(n)) AS intercept, regr_r2(ln(mean), ln(n)) AS r2 FROM s WHERE n >= 1000 GROUP BY arm")
def _(spark, sf):
    return stats.loglog_slope(stats.group_stats(runs(spark, sf), ["arm", "n"]), ["arm"], floor=1000)


@query("per_run_slope", f"{_WITH}, c AS (SELECT arm, seed, inv, n, avg(value) AS y FROM runs WHERE NOT (arm = 'O' AND seed = 43 AND inv = 1 AND n = 10000) GROUP BY ALL), r AS (SELECT arm, count(DISTINCT seed * 10 + inv) AS k FROM c GROUP BY arm), ok AS (SELECT arm, n FROM c JOIN r USING (arm) GROUP BY arm, n, k HAVING count(*) = k), sl AS (SELECT arm, seed, inv, regr_slope(ln(y), ln(n)) AS slope FROM c JOIN ok USING (arm, n) GROUP BY ALL) SELECT arm, avg(slope) AS slope_mean, stddev_samp(slope) AS slope_sd, count(*) AS n_runs FROM sl GROUP BY arm")
def _(spark, sf):
    return stats.per_run_slope(runs(spark, sf).filter("not (arm = 'O' and seed = 43 and inv = 1 and n = 10000)"), ["arm"], ["seed", "inv"])


@query("slope_per_doubling", f"{_STATS} SELECT arm, regr_slope(mean, log2(n)) AS per_doubling FROM s GROUP BY arm")
def _(spark, sf):
    return stats.slope_per_doubling(stats.group_stats(runs(spark, sf), ["arm", "n"]), ["arm"])


for _name, _column, _sql in (
    ("crossover_band", "cross_band", "min(n) FILTER (mean_a + std_a < mean_b - std_b)"),
    ("crossover_mean", "cross_mean", "min(n) FILTER (mean_a < mean_b)"),
):
    query(_name, f"{_BOTH} SELECT 'F/O' AS pair, {_sql} AS {_column} FROM both_")(lambda spark, sf, c=_column: _arm(stats.crossovers(both(spark, sf), []), [c]))


@query("crossover_bracket", f"{_BOTH} SELECT 'F/O' AS pair, max(n) FILTER (mean_b < mean_a) AS bracket_lo, min(n) FILTER (mean_a <= mean_b) AS bracket_hi FROM both_")
def _(spark, sf):
    return _arm(stats.crossovers(both(spark, sf), []), ["bracket_lo", "bracket_hi"])


def _by_seed(spark, sf):
    return stats.sides(stats.group_stats(runs(spark, sf), ["seed", "arm", "n"]), ["seed"], "F", "O")


_SEED = f"{_WITH}, s AS (SELECT seed, arm, n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std FROM runs GROUP BY ALL), both_ AS (SELECT seed, n, max(CASE WHEN arm = 'F' THEN mean END) AS mean_a, max(CASE WHEN arm = 'F' THEN std END) AS std_a, max(CASE WHEN arm = 'O' THEN mean END) AS mean_b, max(CASE WHEN arm = 'O' THEN std END) AS std_b FROM s GROUP BY seed, n)"


@query("crossover_stable", f"{_SEED}, c AS (SELECT seed, min(n) FILTER (mean_a + std_a < mean_b - std_b) AS cross_band FROM both_ GROUP BY seed) SELECT seed, cross_band, CASE WHEN cross_band IS NOT NULL THEN coalesce(bool_and(mean_a + std_a < mean_b - std_b) FILTER (n >= cross_band), true) AND coalesce(bool_and(mean_b <= mean_a * 1.001) FILTER (n < cross_band), true) END AS stable FROM both_ JOIN c USING (seed) GROUP BY seed, cross_band")
def _(spark, sf):
    return stats.crossover_stable(_by_seed(spark, sf), ["seed"])


@query("grid_neighbour", f"{_SEED}, g AS (SELECT n, row_number() OVER (ORDER BY n) AS step FROM (SELECT DISTINCT n FROM both_)), c AS (SELECT seed, min(n) FILTER (mean_a < mean_b) AS x FROM both_ GROUP BY seed) SELECT seed, x AS cross, abs(g.step - (SELECT step FROM g WHERE n = 10000)) <= 1 AS near FROM c LEFT JOIN g ON g.n = c.x".replace("AS cross,", 'AS "cross",'))
def _(spark, sf):
    return stats.grid_neighbour(_by_seed(spark, sf), ["seed"], 10000)


@query("monotone_increasing", f"{_STATS}, l AS (SELECT arm, mean, lag(mean) OVER (PARTITION BY arm ORDER BY n) AS p FROM s) SELECT arm, bool_and(p IS NULL OR mean > p) AS increasing FROM l GROUP BY arm")
def _(spark, sf):
    return stats.monotone_increasing(stats.group_stats(runs(spark, sf), ["arm", "n"]), ["arm"])


@query("losing_cells", f"{_SEED} SELECT seed, n, mean_a, mean_b FROM both_ WHERE mean_b <= mean_a")
def _(spark, sf):
    return stats.losing_cells(_by_seed(spark, sf), ["seed"])


@query("grid_coverage", f"{_WITH}, have AS (SELECT DISTINCT arm, seed, inv, n FROM runs WHERE NOT (arm = 'O' AND seed = 43 AND inv = 1 AND n = 10000)) SELECT * FROM (SELECT DISTINCT arm FROM have), (SELECT DISTINCT seed FROM have), (SELECT DISTINCT inv FROM have), (SELECT DISTINCT n FROM have) EXCEPT SELECT * FROM have")
def _(spark, sf):
    return stats.grid_coverage(runs(spark, sf).filter("not (arm = 'O' and seed = 43 and inv = 1 and n = 10000)"), ["arm", "seed", "inv", "n"])


@query("control_totals", "SELECT l_shipdate::date AS day, sum(CASE WHEN l_returnflag = 'N' THEN l_linenumber ELSE 1 END)::BIGINT AS total, sum(CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_quantity > 5 THEN l_linenumber ELSE 0 END ELSE CASE WHEN l_discount > 0.01 THEN 1 ELSE 0 END END)::BIGINT AS detected FROM lineitem GROUP BY 1")
def _(spark, sf):
    """Two shapes of control records: a count with a flag, and a list of single controls."""
    li = table(spark, sf, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    counted = li.filter("l_returnflag = 'N'").select("day", F.col("l_linenumber").alias("controls"), (F.col("l_quantity") > 5).alias("all_detected"))
    listed = li.filter("l_returnflag <> 'N'").groupBy("day").agg(F.collect_list(F.struct((F.col("l_discount") > 0.01).alias("detected"))).alias("controls"))
    return timeseries.control_totals(counted, listed, ["day"])


@query("env_complete", "SELECT user_id, count(*) AS n_cells, count_if(value IS NOT NULL) AS with_clock, count(*) = count_if(value IS NOT NULL) AND count_if(props IS NULL) = 0 AS complete FROM (SELECT user_id, props, CASE WHEN event_id % 97 <> 0 THEN value END AS value FROM events) GROUP BY user_id")
def _(spark, sf):
    ev = table(spark, sf, "events").withColumn("clock", F.when(F.col("event_id") % 97 != 0, F.col("value")))
    return timeseries.env_complete(ev, ["user_id"], "clock", ["props"])


@query("criterion", f"{_BOTH} SELECT n, CASE WHEN NOT (mean_a > 0) THEN 'FAILED' WHEN mean_a < mean_b AND std_a < std_b AND mean_a > 0 THEN 'SUPPORTED' ELSE 'NOT SUPPORTED' END AS verdict, 3 AS n_clauses FROM both_")
def _(spark, sf):
    b = both(spark, sf)
    clause = lambda name, hard, ok: b.select("n", F.lit(name).alias("clause"), F.lit(hard).alias("hard"), ok.alias("ok"))
    rows = clause("measured", True, F.col("mean_a") > 0).unionByName(clause("faster", False, F.col("mean_a") < F.col("mean_b"))).unionByName(clause("steadier", False, F.col("std_a") < F.col("std_b")))
    return stats.criterion(rows, ["n"])


_CELLS = "WITH c AS (SELECT (l_linenumber - 1) % 4 AS regime, 42 + l_suppkey % 3 AS seed, l_partkey % 3 AS inv, l_linestatus AS arm, sum(l_extendedprice) / sum(l_quantity) AS j, avg(l_tax) AS t FROM lineitem GROUP BY ALL)"


def cells(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(((F.col("l_linenumber") - 1) % 4).alias("regime"), (F.col("l_suppkey") % 3 + 42).alias("seed"), (F.col("l_partkey") % 3).alias("inv"), F.col("l_linestatus").alias("arm")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("joules_per_token"), F.avg("l_tax").alias("ttft"))


@query("off_on_effect", f"{_CELLS}, p AS (SELECT x.regime, x.j AS a, y.j AS b, x.t AS ta, y.t AS tb FROM c x JOIN c y USING (regime, seed, inv) WHERE x.arm = 'O' AND y.arm = 'F'), w AS (SELECT regime, avg(b / a) AS energy_ratio, avg(tb - ta) AS ttft_gain, count_if(a > b) AS regressions, count_if(a < b) AS wins, count_if(a <> b) AS nn FROM p GROUP BY regime) SELECT regime, energy_ratio, ttft_gain, regressions, CASE WHEN nn > 0 THEN {_BINOMIAL.replace('n_', 'nn').replace('k_', 'wins')} END AS p_value FROM w")
def _(spark, sf):
    return stats.off_on_effect(cells(spark, sf), ["regime"], "F", "O")


@query("arm_latency", f"{_WITH}, m AS (SELECT n, seed, inv, arm, avg(value) AS m FROM runs GROUP BY ALL) SELECT n, avg(m) FILTER (arm = 'F') AS latency_a, avg(m) FILTER (arm = 'O') AS latency_b, avg(m) FILTER (arm = 'O') - avg(m) FILTER (arm = 'F') AS delta FROM m GROUP BY n")
def _(spark, sf):
    return stats.arm_latency(runs(spark, sf), ["n"], ["seed", "inv"], "F", "O")


_RATES = "SELECT l_orderkey, l_linenumber, l_quantity AS tokens, round(l_tax * 100) AS seconds, l_extendedprice AS joules FROM lineitem"


@query("tokens_per_second", f"SELECT l_orderkey, l_linenumber, CASE WHEN seconds <> 0 THEN tokens / seconds END AS tokens_per_second FROM ({_RATES})")
def _(spark, sf):
    return stats.rates(_rate_rows(spark, sf), "tokens", "seconds", "joules").select("l_orderkey", "l_linenumber", "tokens_per_second")


@query("joules_per_token", f"SELECT l_orderkey, l_linenumber, CASE WHEN tokens <> 0 THEN joules / tokens END AS joules_per_token FROM ({_RATES})")
def _(spark, sf):
    return stats.rates(_rate_rows(spark, sf), "tokens", "seconds", "joules").select("l_orderkey", "l_linenumber", "joules_per_token")


def _rate_rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("tokens"), F.round(F.col("l_tax") * 100).alias("seconds"), F.col("l_extendedprice").alias("joules"))


# --- energy: events are power samples of devices ---


def samples(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("device"), "ts", F.col("value").alias("watts"))


_LAG = "SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS us, value, lag(value) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)"


@query("energy_trapezoid", f"SELECT user_id AS device, coalesce(sum((value + p) / 2 * us / 1e6), 0) AS joules FROM ({_LAG}) GROUP BY user_id")
def _(spark, sf):
    return timeseries.energy_trapezoid(samples(spark, sf))


@query("energy_counter", "SELECT user_id AS device, (max(mj) - min(mj)) / 1000.0 AS joules FROM (SELECT user_id, event_id AS mj FROM events) GROUP BY user_id")
def _(spark, sf):
    counters = table(spark, sf, "events").select(F.col("user_id").alias("device"), F.col("event_id").alias("at"), F.col("event_id").alias("millijoules"))
    return timeseries.energy_counter(counters, "at")


@query("energy_source", f"WITH t AS (SELECT user_id, coalesce(sum((value + p) / 2 * us / 1e6), 0) AS j FROM ({_LAG}) GROUP BY user_id), c AS (SELECT user_id, (max(event_id) - min(event_id)) / 1000.0 AS j FROM events WHERE user_id % 2 = 0 GROUP BY user_id) SELECT user_id AS device, CASE WHEN c.j IS NOT NULL THEN 'counter' ELSE 'integration' END AS source, coalesce(c.j, t.j) AS joules FROM t LEFT JOIN c USING (user_id)")
def _(spark, sf):
    counters = table(spark, sf, "events").filter("user_id % 2 = 0").select(F.col("user_id").alias("device"), F.col("event_id").alias("at"), F.col("event_id").alias("millijoules"))
    return timeseries.energy_source(timeseries.energy_counter(counters, "at"), timeseries.energy_trapezoid(samples(spark, sf)))


@query("avg_power", "SELECT user_id AS device, avg(value) AS watts FROM events GROUP BY user_id")
def _(spark, sf):
    return samples(spark, sf).groupBy("device").agg(F.avg("watts").alias("watts"))


@query("trace_cumulative", "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS total FROM lineitem")
def _(spark, sf):
    return timeseries.trace_cumulative(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_quantity").select("l_orderkey", "l_linenumber", "total")
