"""The leaf table: texts cut and hashed once, kept in buckets by document, so that joins on it move nothing.

Queries that ask for leaves, fingerprints or prefixes of the same documents read this table instead of cutting the texts
again. Tables with the same number of buckets on the same key join, and group by it, without an exchange.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.fingerprint import BASES, LANES, MODULUS, power
from ..functions.tables import new_path, scan
from .identity import LEAF, fingerprint_leaves
from .leaves import content, cut

BUCKETS = 64


def bucketed(df: DataFrame, key: str, buckets: int = BUCKETS, name: str = "bucketed") -> DataFrame:
    """df as a table in the shared folder, in buckets of `key` and sorted by it; choose some 128 MB for each bucket."""
    spark, table = df.sparkSession, f"loomtext_{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", new_path(spark, name)).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


def leaf_table(docs: DataFrame, size: int = LEAF, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, ord, byte_start, n, leaf, fp1, fp2, p1, p2): every leaf with its own fingerprint and that of the prefix that
    ends with it; bucketed by doc_id. `text` is a string or a binary column; an empty or null one has no leaf. Columns that a query does not name are not read."""
    data = F.coalesce(F.col(text), F.lit(b"")) if isinstance(docs.schema[text].dataType, BinaryType) else content(F.col(text))
    hashed = fingerprint_leaves(docs.select("doc_id", F.inline(cut(data, size, empty_leaf=False))))
    placed = hashed.withColumns({f"_{x}": F.col(x) * power(F.col("byte_start"), BASES[k]) % MODULUS for k, x in enumerate(LANES)})
    prefixes = scan(placed, ["doc_id"], "ord", {"p1": "_fp1", "p2": "_fp2"})
    return bucketed(prefixes.select("doc_id", "ord", "byte_start", "n", "leaf", *LANES, (F.col("p1") % MODULUS).alias("p1"), (F.col("p2") % MODULUS).alias("p2")), "doc_id", buckets, "leaves")


def changed_leaves(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, n_before, n_after, n_same, n_new) of the documents in either of two leaf tables of equal buckets: leaves of
    both versions, those of the later one that stand where they stood, and its distinct leaves that the earlier one lacks.

    Grouped and joined on doc_id where the leaves lie, without an exchange; a document's leaves meet as 24 bytes each.
    """

    def listed(table: DataFrame, name: str) -> DataFrame:
        leaves = F.sort_array(F.collect_list(F.struct("ord", F.struct(*LANES, "n").alias("h"))))
        return table.groupBy("doc_id").agg(F.transform(leaves, lambda x: x["h"]).alias(name))

    both = listed(before, "a").join(listed(after, "b"), "doc_id", "full")
    both = both.select("doc_id", *[F.coalesce(x, F.array().cast(both.schema[x].dataType)).alias(x) for x in "ab"])
    same = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x == y), lambda x: x))
    return both.select("doc_id", F.size("a").cast("long").alias("n_before"), F.size("b").cast("long").alias("n_after"), same.cast("long").alias("n_same"), F.size(F.array_except("b", "a")).cast("long").alias("n_new"))
