"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from . import exact_dedup, html_text, lattice_lm, line_dedup, mixing, ngram_join, packing, periodic_runs, prefix_trie, quality_mil, quality_rules, simhash, toxicity
from .common import documents

QUERIES = {
    "op1_length_buckets": lambda spark, sf: packing.report(documents(spark, sf)),
    "op2_pivotal_mix": lambda spark, sf: mixing.report(documents(spark, sf)),
    "op3_exact_dedup": lambda spark, sf: exact_dedup.exact_groups(documents(spark, sf), files=True),
    "op4_line_suffixes": lambda spark, sf: line_dedup.report(documents(spark, sf), files=True),
    "op5_attention_mil": lambda spark, sf: quality_mil.score(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")),
    "op6_counterfactual": lambda spark, sf: toxicity.score(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")),
    "op7_block_rules": lambda spark, sf: html_text.extract(spark.read.parquet(f"{sf}/pages.parquet")),
    "op8_ngram_jaccard": lambda spark, sf: ngram_join.link_components(documents(spark, sf), files=True),
    "op10_lattice_lm": lambda spark, sf: lattice_lm.score(documents(spark, sf)),
    "op11_prefix_trie": lambda spark, sf: prefix_trie.report(spark.read.parquet(f"{sf}/conversations.parquet")),
    "op12_simhash_anchors": lambda spark, sf: simhash.link_components(documents(spark, sf)),
    "op13_periodic_runs": lambda spark, sf: periodic_runs.report(documents(spark, sf)),
    "op9_host_rules": lambda spark, sf: quality_rules.report(documents(spark, sf), files=True),
}
