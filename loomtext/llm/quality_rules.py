"""Host-level quality rules: documents fail rules, hosts collect failures, shrunken rates judge the hosts.

Each document is measured from its whole text. A host's failure rate under each rule is shrunk towards the rate of
all hosts with a beta prior whose two parameters come from the hosts themselves (moments). The verdict on the host
then goes back to its documents: a host whose shrunken rate under any rule exceeds `reject_rate` loses all documents,
one above `suspect_rate` loses those that fail a soft rule.

Everything is an expression or an aggregate; the text is never shuffled. The texts are measured once into a narrow
table, from which host counts and verdicts come. Three-word windows are compared by 64-bit hashes, so two different
windows of one text would count as equal once in some 10^13 long texts.

Null text counts as empty (no words: base_failed). A null host is a host of its own. Equal rows get equal verdicts, and
rows that share an id get their own. An empty table gives an empty result. Extra columns, whatever their names, do no
harm and `keep_good` returns the columns of docs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fold_key, join_checked, let, of_row, rows_of, stage, text_or_empty, unpacked, without, words

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 50  # symbols for 100 words
    max_dup_line_percent: int = 50  # of the lines with a word
    min_word_chars: int = 2  # characters for each word, on average
    max_word_chars: int = 20
    suspect_rate: float = 0.25
    reject_rate: float = 0.5


SOFT = ("symbols", "dup_lines", "word_length")


def repeated_words(ws: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the array.

    Windows are sorted with their positions; a window equal to a neighbour marks three positions, and the marked
    positions are counted as a union of intervals. Linear but for the sort; nothing leaves the row.
    """

    def marked(at):
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"))
        return F.aggregate(at, zero, step, lambda acc: acc["n"])

    def of_windows(wins):
        pairs = F.sort_array(F.transform(wins, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        twins = lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["w"] == x["w"], F.lit(False)))
        return F.when(F.size(F.array_distinct(wins)) == F.size(wins), 0).otherwise(marked(F.sort_array(F.transform(let(pairs, twins), lambda x: x["i"]))))

    def of_words(w):
        wins = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, 0).otherwise(let(wins, of_windows))

    return let(ws, of_words)


def measure(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """docs with _m: the struct of all measures and of the rules failed."""
    t = text_or_empty(F.col(text))
    with_word = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    first = let(words(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    lines = let(with_word, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    drop = lambda chars: F.length(F.translate(t, chars, "")).cast("long")
    out = docs.withColumns({"_w": first, "_l": lines, "_chars": drop(SPACES), "_sym": F.length(t).cast("long") - drop(SYMBOLS)})
    n = F.col("_w.n_words")
    return out.withColumn("_m", F.struct(
        n.alias("n_words"), F.col("_chars").alias("word_chars"), F.col("_sym").alias("n_symbols"), F.col("_l.dup").alias("n_dup_lines"), F.col("_w.n_repeat_words").alias("n_repeat_words"),
        ((n < rules.min_words) | (100 * F.col("_w.n_repeat_words") > rules.max_repeat_percent * n)).alias("base"),
        (100 * F.col("_sym") > rules.max_symbol_percent * n).alias("symbols"),
        (100 * F.col("_l.dup") > rules.max_dup_line_percent * F.col("_l.n")).alias("dup_lines"),
        ((n > 0) & ((F.col("_chars") < rules.min_word_chars * n) | (F.col("_chars") > rules.max_word_chars * n))).alias("word_length"),
    )).drop("_w", "_l", "_chars", "_sym")


def host_table(measured: DataFrame, host: str) -> DataFrame:
    """One row for each host: documents and failures under each rule. Only these counts are shuffled."""
    fails = [F.sum(F.col(f"_m.{r}").cast("long")).alias(f"f_{r}") for r in ("base", *SOFT)]
    return fold_key(measured, host).groupBy("_k", "_kn").agg(F.count(F.lit(1)).alias("n"), *fails)


def host_verdicts(hosts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """hosts with the shrunken rate of each rule, and whether the host is suspect or rejected.

    Moments: m pooled rate, v variance of the hosts' rates weighted by documents, less the part that sampling explains
    (m(1-m) times hosts over documents); a+b = m(1-m)/v - 1, kept within 1 and a million. The six sums for each rule
    come to the driver as one row.
    """
    names = ("base", *SOFT)
    sums = [F.sum("n").alias("n"), F.count(F.lit(1)).alias("h")]
    for r in names:
        p = F.col(f"f_{r}") / F.col("n")
        sums += [F.sum(f"f_{r}").alias(f"s_{r}"), F.sum(F.col("n") * p * p).alias(f"q_{r}")]
    row = hosts.agg(*sums).first()
    total, n_hosts = row["n"] or 0, row["h"]
    rates = {}
    for r in names:
        m = (row[f"s_{r}"] or 0) / max(total, 1)
        v = (row[f"q_{r}"] or 0.0) / max(total, 1) - m * m - n_hosts * m * (1 - m) / max(total, 1)
        strength = min(max(m * (1 - m) / max(v, 1e-12) - 1, 1.0), 1e6)
        rates[f"rate_{r}"] = (F.col(f"f_{r}") + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
    over = lambda most: F.greatest(*[F.col(x) for x in rates]) > F.lit(most)
    return hosts.withColumns(rates).withColumns({"host_suspect": over(rules.suspect_rate), "host_rejected": over(rules.reject_rate)})


def _judged(rows: DataFrame, text: str, host: str, rules: Rules) -> DataFrame:
    """For rows(row, at): doc_id, at, _m (the measures) and _kept (the verdict)."""
    narrow = stage(measure(rows.select(of_row("doc_id").alias("doc_id"), "at", of_row(host).alias("_host"), of_row(text).alias("_text")), "_text", rules).drop("_text"), "measures")
    hosts = stage(host_table(narrow, "_host"), "hosts")
    verdicts = stage(host_verdicts(hosts, rules).select("_k", "_kn", "host_suspect", "host_rejected"), "verdicts")
    soft = F.col("_m.symbols") | F.col("_m.dup_lines") | F.col("_m.word_length")
    kept = ~F.col("_m.base") & ~F.col("host_rejected") & ~(F.col("host_suspect") & soft)
    return join_checked(fold_key(narrow, "_host"), verdicts, ["_k", "_kn"], "left").select("doc_id", "at", "_m", kept.alias("_kept"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules(), files: bool = False) -> DataFrame:
    """The documents that stay, with the columns of docs. `files`: see common.rows_of."""
    rows = rows_of(docs, files)
    gone = stage(_judged(rows, text, host, rules).filter(~F.col("_kept")).select("at"), "rejected")
    return unpacked(without(rows, gone), docs.columns)


def report(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules(), files: bool = False) -> DataFrame:
    """One row for each document: its measures, base_failed and kept."""
    m = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return _judged(rows_of(docs, files), text, host, rules).select("doc_id", *[f"_m.{x}" for x in m], F.col("_m.base").alias("base_failed"), F.col("_kept").alias("kept"))
