"""Packing by optimal length buckets.

The global histogram of document lengths (one aggregate over all documents) goes to the driver, where dynamic
programming chooses the bucket boundaries that minimise the padding of the whole corpus. Inside each bucket, batches
of equal capacity form: a batch holds as many documents as fit the token budget at the bucket's boundary length.

Lengths up to `exact_to` (131,072) are bins of their own, so boundaries are optimal among all lengths where none is
longer. Longer ones share bins of a relative width of at most 2/`exact_to`, whose sums of lengths and largest length are
exact: padding is counted exactly, but boundaries inside a bin are not considered. An optimal boundary raised to the top
of its bin adds less than 2/`exact_to` of it to each document below, so the lost padding is less than 1/65,536 of the
padded size of the buckets beyond `exact_to`, and the histogram stays bounded for any corpus.

A bucket may hold most of the corpus, so ranks inside a bucket come from shards: a row number in each shard and the
counts of the shards before it. Only the last batch of a bucket can be part-filled.

Null and empty texts have length 0 and are packed like any others. Repeated rows are packed each. A document longer
than the budget has a batch of its own. An empty table gives an empty result. Extra columns are kept, whatever their
names; only those that bear the name of a column added here give way to it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_checked, let, n_words, of_row, stage

EXACT_TO = 1 << 17
_OWN = ["n_tokens", "bucket", "bucket_length", "batch", "slot", "padding"]


def length_bin(length: Column, exact_to: int) -> Column:
    """The bin of a length: itself up to exact_to, then steps that double with the length."""
    shift = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(length, F.lit(1)) / F.lit(float(exact_to)))) + 1)
    step = F.pow(F.lit(2.0), shift).cast("long")
    return F.floor(length / step) * step


def best_boundaries(top: np.ndarray, count: np.ndarray, total: np.ndarray, n_buckets: int) -> tuple[list[int], int]:
    """Boundaries (largest lengths of the buckets, ascending) with the least padding, and that padding.

    top, count and total are the bins' largest length, documents and sum of lengths, ascending. With C and S the
    running counts and sums, a bucket of bins i+1..j pads top[j]*(C[j]-C[i]) - (S[j]-S[i]). For fixed j that is a line
    in top[j] with slope -C[i], and slopes and tops are monotone: each of the n_buckets rounds is one pass with a
    convex hull.
    """
    m = len(top)
    c, s = [0, *np.cumsum(count).tolist()], [0, *np.cumsum(total).tolist()]
    tops = [int(x) for x in top]
    best = [0] + [tops[j - 1] * c[j] - s[j] for j in range(1, m + 1)]
    back = [[0] * (m + 1)]
    for k in range(2, min(n_buckets, m) + 1):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i; slopes fall
        at, now, cut = 0, [0] * (m + 1), [0] * (m + 1)
        for j in range(1, m + 1):
            i = j - 1
            if i >= k - 1:
                line = (-c[i], best[i] + s[i], i)
                while len(hull) >= 2 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
                at = min(at, len(hull) - 1)
            if j < k:
                now[j], cut[j] = best[j], -1  # fewer bins than buckets
                continue
            x = tops[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            now[j], cut[j] = hull[at][0] * x + hull[at][1] + x * c[j] - s[j], hull[at][2]
        best, back = now, [*back, cut]
    bounds, j = [], m
    for cut in reversed(back):
        if j > 0 and cut[j] >= 0:
            bounds.append(tops[j - 1])
            j = cut[j]
    return sorted(bounds), best[m]


def plan_buckets(lengths: DataFrame, n_buckets: int, exact_to: int) -> list[int]:
    """Bucket boundaries for lengths(n_tokens), from the histogram of all rows."""
    bins = lengths.groupBy(length_bin(F.col("n_tokens"), exact_to).alias("bin")).agg(F.max("n_tokens").alias("top"), F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("s"))
    rows = sorted(bins.collect())  # a bounded number of bins
    if not rows:
        return []
    top, n, s = (np.array([r[k] for r in rows], dtype=np.int64) for k in (1, 2, 3))
    return best_boundaries(top, n, s, n_buckets)[0]


def pack(docs: DataFrame, text: str = "text", n_buckets: int = 16, token_budget: int = 16384, exact_to: int = EXACT_TO, rows_per_shard: int = 50_000, length: Column | None = None) -> DataFrame:
    """docs with n_tokens, bucket, bucket_length, batch (bucket and number), slot (place in the batch) and padding.

    `length` is the token count of a row, words by default.
    """
    taken = {c for c in docs.columns if c.lower() in _OWN}
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # so that no working column meets one of docs
    ids = [of_row(c) for c in ("doc_id",) if c in docs.columns]
    n = n_words(of_row(text)) if length is None else F.col("n_given")
    rows = docs.select(whole, *([] if length is None else [length.cast("long").alias("n_given")]))
    rows = rows.select("row", n.alias("n_tokens"), F.xxhash64(*ids, F.length(of_row(text))).alias("seed"))
    sizes = stage(rows.select("n_tokens", "seed"), "lengths")  # texts are measured once for all statistics
    bounds = plan_buckets(sizes, n_buckets, exact_to)
    edges = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    bucket = let(F.col("n_tokens"), lambda n: F.size(F.filter(edges, lambda b: b < n)))
    sizes = sizes.withColumn("bucket", bucket)
    counts = sizes.groupBy("bucket").count().collect()  # one row for each bucket
    shards = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r[0], max(1, -(-r[1] // rows_per_shard)))]), F.col("bucket")) if counts else F.lit(1)
    shard = F.pmod(F.col("seed"), shards).cast("int")
    rows, sizes = rows.withColumn("bucket", bucket).withColumn("shard", shard), sizes.withColumn("shard", shard)
    per = sizes.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = stage(per.select("bucket", "shard", F.coalesce(before, F.lit(0)).alias("before")), "offsets")
    local = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("seed", *ids)) - 1
    rows = join_checked(rows.withColumn("local", local), offsets, ["bucket", "shard"]).withColumn("bucket_length", F.get(edges, F.col("bucket")))
    place, room = F.col("before") + F.col("local"), F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("bucket_length"), F.lit(1))))
    rows = rows.withColumns({"batch": F.concat_ws("-", "bucket", F.floor(place / room)), "slot": (place % room).cast("int"), "padding": F.col("bucket_length") - F.col("n_tokens")})
    return rows.select(*[of_row(c).alias(c) for c in docs.columns if c not in taken], *_OWN)


def report(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """One row for each document: where it is packed."""
    lengths = stage(docs.select("doc_id", n_words(F.col(text)).alias("n")), "words")
    return pack(lengths.withColumn("text", F.lit("")), "text", length=F.col("n"), **how).select("doc_id", *_OWN)
