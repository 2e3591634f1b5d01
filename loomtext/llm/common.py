"""Shared helpers: the word rules of the contracts, rows with locators, Bloom filters, and the library's staged tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import BROADCAST_BYTES, Bloom, bloom, discard, global_rank, join_checked, let, measured_bytes, new_path, running_sum, stage, stage_at

__all__ = [
    "BROADCAST_BYTES", "Bloom", "SPACES", "bloom", "discard", "documents", "fold_key", "global_rank", "join_checked", "let", "measured_bytes", "n_words", "new_path", "of_row", "picked", "rows_of", "running_sum",
    "stage", "stage_at", "text_or_empty", "unpacked", "with_sparse", "without", "words",
]

#: White space of the word contracts: space, \\t, \\n, \\v, \\f, \\r.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The maximal runs of other than SPACES; an empty array for null."""
    bare = F.btrim(text_or_empty(text), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RE))


def n_words(text: Column) -> Column:
    """Number of words, counted without building them."""
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def fold_key(df: DataFrame, col: str) -> DataFrame:
    """Two key columns that join null with null: _k (null as empty) and _kn (is it null?)."""
    return df.withColumns({"_k": F.coalesce(F.col(col).cast("string"), F.lit("")), "_kn": F.col(col).isNull()})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def of_row(name: str) -> Column:
    return F.col("row")[name]


def rows_of(docs: DataFrame, files: bool = False) -> DataFrame:
    """(row, at): each row whole, as a struct, so that no name can clash; and its place, the same on every read.

    The place is a hash of the file's path and the position in the file. `files` says that docs is a plain read of
    files, whose places are taken; any other table is first written to the shared folder.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("pos")).alias("at")
    if files:
        try:
            return docs.select(whole, place)
        except AnalysisException:  # no read of files after all
            pass
    return stage(docs.select(whole), "rows").select("row", place)


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the struct `row`."""
    return rows.select(*[of_row(c).alias(c) for c in columns])


def picked(rows: DataFrame, listed: DataFrame, most: int = 1 << 21) -> DataFrame:
    """The rows(row, at) whose place is in the staged table listed(at, ...), found in place, and about one in 70 others.

    A Bloom filter holds at most some `most` places at 16 bits each. Longer lists are taken in blocks of files, each with
    a filter of its own places, and what is found is staged, block by block; each block reads its own files alone. So
    as few others pass at any size (but from a single file with more than `most` places).
    """
    blocks = -(-listed.count() // most)
    if blocks <= 1:
        return rows.filter(bloom(listed, lambda: F.col("at"))(F.col("at")))
    block, found = F.pmod(F.col("at.file"), F.lit(blocks)), None
    for b in range(blocks):
        places = stage(listed.filter(block == b).select("at"), "block-places")
        part = stage(rows.filter(block == b).filter(bloom(places, lambda: F.col("at"))(F.col("at"))), "picked")
        found = found.unionByName(part) if found else part
    return found


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows(row, at) without those whose place is in the staged table gone(at).

    A short list goes to every task. For a longer one a Bloom filter tells in place which rows surely stay, and only
    the others are shuffled.
    """
    if measured_bytes(gone) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(gone), "at", "left_anti")
    listed = bloom(gone, lambda: F.col("at"))
    return rows.filter(~listed(F.col("at"))).unionByName(rows.filter(listed(F.col("at"))).join(gone, "at", "left_anti"))


def with_sparse(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows(row, at) left-joined on `at` with a staged table that has few of them; see without."""
    if measured_bytes(table) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), "at", "left")
    listed = bloom(table, lambda: F.col("at"))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name != "at"]
    met = rows.filter(listed(F.col("at"))).join(table, "at", "left")
    return met.unionByName(rows.filter(~listed(F.col("at"))).select("*", *nothing))
