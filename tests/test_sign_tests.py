"""Tails of the sign tests against exact integers, and beyond them."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from loomtext.operators import stats


def exact(n, k):
    return Fraction(sum(math.comb(n, i) for i in range(max(k, 0), n + 1)), 2**n)


def test_tail_equals_exact_integers(spark):
    """To 1e-12 of the value for all n to 40 and many up to 2,000, the whole range of k where a double can hold the value."""
    cells = [(n, k) for n in range(41) for k in range(n + 1)]
    for n in (57, 100, 333, 500, 999, 1000, 1074, 1075, 1100, 1500, 1999, 2000):
        cells += [(n, k) for k in {0, 1, n // 4, n // 2 - 20, n // 2 - 1, n // 2, n // 2 + 1, n // 2 + 2, n // 2 + 15, n // 2 + 40, 3 * n // 4, n - 1, n}]
    got = spark.createDataFrame(cells, "n long, k long").select("n", "k", stats.upper_tail(F.col("n"), F.col("k")).alias("p")).collect()
    for r in got:
        want = exact(r.n, r.k)
        if want > Fraction(1, 10**300):
            assert abs(Fraction(r.p) - want) <= want / 10**12, (r.n, r.k, r.p, float(want))
    assert len(got) == len(cells)


def test_logarithms_do_not_underflow(spark):
    rows = [(2000, 1990), (5000, 5000), (100_000, 90_000)]
    for r in spark.createDataFrame(rows, "n long, k long").select("n", "k", stats.log_upper_tail(F.col("n"), F.col("k")).alias("l")).collect():
        whole = sum(math.comb(r.n, i) for i in range(r.k, r.n + 1)) if r.n < 10_000 else sum(math.comb(r.n, i) for i in range(r.k, r.k + 200))
        assert math.isclose(r.l, math.log(whole) - r.n * math.log(2), rel_tol=1e-12)


@pytest.mark.parametrize("n", [10**5, 10**6, 10**7])
def test_large_groups(spark, n):
    """Against the normal limit with its first correction; finite, ordered, and symmetric around the middle."""
    ks = [n // 2 + d for d in (-3000, -1, 0, 1, 500, 1000, 3000)]
    p = [r.p for r in spark.createDataFrame([(n, k) for k in ks], "n long, k long").coalesce(1).select(stats.upper_tail(F.col("n"), F.col("k")).alias("p")).collect()]
    assert p == sorted(p, reverse=True) and all(0 < x <= 1 for x in p)
    assert math.isclose(p[2] + p[3], 1.0, rel_tol=1e-12)
    for k, x in zip(ks, p, strict=True):
        z = (k - 0.5 - n / 2) / math.sqrt(n / 4)
        assert math.isclose(x, math.erfc(z / math.sqrt(2)) / 2, rel_tol=max(1e-4, abs(z) ** 4 / n))


def test_both_sign_tests_on_large_groups(spark):
    """1,000 wins of 2,000 pairs, and 2,000 of 2,600; ties are left out."""
    pairs = spark.range(2000).select(F.lit("even").alias("k"), (F.col("id") % 2).cast("double").alias("a"), F.lit(0.5).alias("b"))
    pairs = pairs.union(spark.range(3000).select(F.lit("skew"), F.when(F.col("id") < 2000, 0.0).when(F.col("id") < 2600, 1.0).otherwise(0.5), F.lit(0.5)))
    one = {r.k: (r.n_untied, r.p_value) for r in stats.sign_test_one(pairs, ["k"]).collect()}
    two = {r.k: (r.p_max, r.p_min) for r in stats.sign_test_two(pairs, ["k"]).collect()}
    assert one["even"][0] == 2000 and math.isclose(one["even"][1], float(exact(2000, 1000)), rel_tol=1e-12)
    assert two["even"] == (1.0, 1.0)
    assert one["skew"][0] == 2600 and math.isclose(one["skew"][1], float(exact(2600, 2000)), rel_tol=1e-12)
    assert math.isclose(two["skew"][0], 2 * float(exact(2600, 2000)), rel_tol=1e-12)
