"""Cutting texts into leaves: fixed byte blocks, and blocks aligned to lone spaces that keep the token stream."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import byte_values
from ..functions.tables import let

# A safe cut is at a space with other than ASCII white space on both sides.
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
#: Pre-tokens: a space leads its word, other white space stands alone.
TOKEN = r" ?[^ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]"


def content(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def cut(data: Column, size: int, empty_leaf: bool = True) -> Column:
    """array<struct<ord, byte_start, leaf, n>> of blocks of `size` bytes; empty data has one empty leaf, or none."""

    def blocks(d):
        n = F.octet_length(d)
        last = F.greatest(F.lit(0), F.floor((n - 1) / size)).cast("int")
        leaf = lambda i: F.substring(d, i * size + 1, F.lit(size))
        out = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("ord"), (i.cast("long") * size).alias("byte_start"), leaf(i).alias("leaf"), F.octet_length(leaf(i)).alias("n")))
        return out if empty_leaf else F.when(n > 0, out).otherwise(F.slice(out, 1, 0))

    return let(data, blocks)


def leaves_fixed(docs: DataFrame, size: int, text: str = "text", keys: tuple[str, ...] = ("doc_id",), empty_leaf: bool = True) -> DataFrame:
    """(keys, ord, byte_start, leaf, n). Narrow: nothing is shuffled, and one row becomes many in its own task."""
    return docs.select(*keys, F.inline(cut(content(F.col(text)), size, empty_leaf)))


def aligned_cuts(text: Column, target: int) -> Column:
    """array<int>: 0 and the bytes at which further leaves begin, each the first lone space at or after the target; none
    where the rest fits the target. Lone spaces of a whole batch are found at once, then each cut is a look-up."""

    @F.arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        data, offsets = byte_values(texts)
        white = _WHITE[data]
        lone = np.zeros(len(data), dtype=bool)
        lone[1:-1] = (data[1:-1] == 32) & ~white[:-2] & ~white[2:]
        for edge in (offsets[:-1], offsets[1:] - 1):  # no neighbour beyond the text's ends
            edge = edge[(edge >= 0) & (edge < len(data))]
            lone[edge] = False
        places, out, sizes = np.flatnonzero(lone), [], []
        firsts = np.searchsorted(places, offsets).tolist()
        for i, (start, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            mine, at, n = places[firsts[i] : firsts[i + 1]], start, 1
            out.append(0)
            while at + target < end and (k := int(np.searchsorted(mine, at + target))) < len(mine):
                at = int(mine[k])
                out.append(at - start)
                n += 1
            sizes.append(n)
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(out, pa.int32()))

    return of(F.coalesce(text, F.lit("")))


def aligned(text: Column, target: int) -> Column:
    """array<struct<ord, byte_start, leaf, n>> of leaves of at least `target` bytes that begin at lone spaces."""

    def leaf(x):
        n = F.octet_length(x["data"])
        end = lambda i: F.coalesce(F.get(x["cuts"], i + 1), n)
        return F.transform(x["cuts"], lambda c, i: F.struct(i.alias("ord"), c.cast("long").alias("byte_start"), F.decode(F.substring(x["data"], c + 1, end(i) - c), "UTF-8").alias("leaf"), (end(i) - c).alias("n")))

    return let(F.struct(content(text).alias("data"), aligned_cuts(text, target).alias("cuts")), leaf)


def leaves_aligned(docs: DataFrame, target: int, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, ord, byte_start, leaf, n): see aligned. Narrow."""
    return docs.select(*keys, F.inline(aligned(F.col(text), target)))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def token_rows(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, pos, token): pre-tokens of the whole text."""
    return docs.select(*keys, F.posexplode(tokens(F.col(text))).alias("pos", "token"))


def leaf_tokens(leaves: Column, binary: bool = False) -> Column:
    """Pre-tokens of each leaf alone, in order, of an array<struct<leaf>>; bad bytes of binary leaves are replaced."""
    read = (lambda x: F.make_valid_utf8(x.cast("string"))) if binary else (lambda x: x)
    return F.flatten(F.transform(leaves, lambda x: tokens(read(x["leaf"]))))


def leaf_token_rows(docs: DataFrame, target: int, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, pos, token): pre-tokens of each aligned leaf alone, in order. Narrow."""
    return docs.select(*keys, F.posexplode(leaf_tokens(aligned(F.col(text), target))).alias("pos", "token"))


def identity_report(docs: DataFrame, leaves: Column, text: str = "text", key: str = "doc_id", binary: bool = False) -> DataFrame:
    """Whole against leaf-wise token streams: exact_match, n_leaves, whole_tok, chunked_tok, first_divergence,
    divergent_positions (differing places and the difference in length), invalid_leaves.

    `leaves` is an array<struct<leaf>> of the text, strings or binaries. Both streams are compared inside the row.
    """
    rows = docs.select(key, F.col(text).alias("text"), leaves.alias("leaves")).select(key, "leaves", tokens(F.col("text")).alias("a"), leaf_tokens(F.col("leaves"), binary).alias("b"))
    differs = F.when(F.col("a") == F.col("b"), F.array().cast("array<boolean>")).otherwise(F.zip_with("a", "b", lambda x, y: ~x.eqNullSafe(y)))
    bad = F.size(F.filter("leaves", lambda x: ~F.is_valid_utf8(x["leaf"].cast("string") if binary else x["leaf"])))
    rows = rows.select(key, F.size("leaves").cast("long").alias("n_leaves"), F.size("a").cast("long").alias("whole_tok"), F.size("b").cast("long").alias("chunked_tok"), differs.alias("differs"), bad.cast("long").alias("invalid_leaves"))
    first = F.nullif(F.array_position("differs", F.lit(True)), F.lit(0)) - 1
    return rows.select(key, first.isNull().alias("exact_match"), "n_leaves", "whole_tok", "chunked_tok", first.alias("first_divergence"), F.size(F.filter("differs", lambda x: x)).cast("long").alias("divergent_positions"), "invalid_leaves")


def size_sweep(docs: DataFrame, sizes: list[int], text: str = "text") -> DataFrame:
    """(target, n_docs, n_leaves, exact_docs) for each leaf size: texts are read and tokenised whole once for all sizes.

    Each size's leaves are compared inside the row and only counts leave it. Null counts as an empty text, which is exact
    and has the leaves that `aligned` gives it; without rows there is no result row.
    """
    rows = docs.select(F.col(text).alias("text"), tokens(F.col(text)).alias("whole"), *[aligned(F.col(text), n).alias(f"cut_{n}") for n in sizes])
    told = [F.struct(F.lit(n).alias("target"), F.size(f"cut_{n}").cast("long").alias("n_leaves"), (leaf_tokens(F.col(f"cut_{n}")) == F.col("whole")).alias("exact")) for n in sizes]
    each = rows.select(F.inline(F.array(*told)))
    return each.groupBy("target").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_leaves").alias("n_leaves"), F.count_if("exact").alias("exact_docs"))
