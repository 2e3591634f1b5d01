"""A corpus pipeline: quality rules, exact and near deduplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet into the shared folder
and reads again for the next one; what went before is then deleted. All but the last return the columns of documents,
extra ones with them. An empty table passes through all stages and gives an empty result. Stages take docs as a read
of files; a table of another kind is first written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import common, exact_dedup, mixing, ngram_join, packing, quality_rules


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules. Null and empty texts have too few words and go; equal rows go or stay together."""
    return quality_rules.keep_good(docs, files=True)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts. Null counts as empty; rows that share an id are rows of their own."""
    return exact_dedup.keep_first(docs, files=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies, whatever the ids; rows without words are copies of none."""
    return ngram_join.keep_one(docs, files=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them. A null source is a source; rows without words have size 0."""
    return mixing.mixed(docs, files=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with their bucket, batch and slot. Rows without words have length 0."""
    return packing.pack(docs)


STAGES = [("quality rules", rules), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mix), ("packing", pack)]

#: Mixing rounds by hash functions of Spark, which DuckDB lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        before, docs = docs, common.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.discard(before)
    return docs
