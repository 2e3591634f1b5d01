"""Resampled medians by order statistics: against resampling by hand, coverage, and a group of millions of values."""

import numpy as np
from pyspark.sql import functions as F

from loomtext.operators import stats


def test_distribution_of_ranks(spark):
    """Ranks of the middles of resamples, against picks by hand, for odd and even sizes."""
    sizes = spark.createDataFrame([("a", 1), ("b", 2), ("c", 9), ("d", 10)], "k string, n long")
    got = stats.resampled_ranks(sizes, ["k"], 20_000, 3).toPandas()
    random = np.random.default_rng(5)
    for k, n in (("a", 1), ("b", 2), ("c", 9), ("d", 10)):
        mine = got[got.k == k]
        picks = np.sort(random.integers(0, n, (20_000, n)), axis=1)
        for column, at in (("lo", (n - 1) // 2), ("hi", n // 2)):
            one, other = (np.bincount(x, minlength=n) / 20_000 for x in (mine[column], picks[:, at]))
            assert abs(one - other).max() < 0.02, (k, column)
        assert (mine.lo <= mine.hi).all() and abs(np.corrcoef(mine.lo, mine.hi)[0, 1] - np.corrcoef(picks[:, (n - 1) // 2], picks[:, n // 2])[0, 1]) < 0.05 if n > 2 else True


def test_values_at_ranks(spark):
    """Ties, single values, nulls and empty groups; equal to resampling the sorted values at the same ranks."""
    groups = {"a": [3.0, 1.0, 2.0, 2.0, 2.0, 9.0, 4.0, -1.5], "b": [5.0] * 4, "c": [7.0], "d": [None], "e": [1.0, 2.0]}
    df = spark.createDataFrame([(k, v, "mine") for k, vs in groups.items() for v in vs], "k string, value double, draw string")
    got = {r.k: r for r in stats.bootstrap_median(df, ["k"], draws=500).collect()}
    assert set(got) == {"a", "b", "c", "e"}
    ranks = stats.resampled_ranks(spark.createDataFrame([(k, len(v)) for k, v in groups.items() if k != "d"], "k string, n long"), ["k"], 500, 7).toPandas()
    for k, r in got.items():
        v, mine = np.sort(groups[k]), ranks[ranks.k == k]
        medians = (v[mine.lo] + v[mine.hi]) / 2
        assert r.n == len(v) and r.median == np.median(v)
        assert np.allclose([r.lo, r.hi], np.percentile(medians, [2.5, 97.5]))
    assert stats.bootstrap_median(df.limit(0), ["k"]).count() == 0


def test_coverage(spark):
    """Of 400 samples of 60 from a known distribution, about 95 % of the bounds hold its median."""
    random = np.random.default_rng(8)
    values = random.exponential(1.0, (400, 60))
    df = spark.createDataFrame([(i, float(v)) for i, row in enumerate(values) for v in row], "k long, value double")
    got = stats.bootstrap_median(df, ["k"], draws=1000).collect()
    held = sum(r.lo <= np.log(2) <= r.hi for r in got) / len(got)
    assert 0.91 <= held <= 0.985


def test_millions_of_values(spark):
    """One group of three million distinct values: many tasks, bounds around the median as theory has them."""
    n = 3_000_000
    df = spark.range(n).select(F.lit("g").alias("k"), (F.col("id") * 7919 % n).cast("double").alias("value"))
    r = stats.bootstrap_median(df, ["k"], draws=1000).first()
    half = 1.96 * np.sqrt(n) / 2
    assert r.n == n and r.median == (n - 1) / 2 and abs(r.hi - r.median - half) < 0.15 * half and abs(r.median - r.lo - half) < 0.15 * half
