"""Line deduplication: repeated runs of lines by a suffix array over line-ID sequences.

A run of lines with at least `min_words` words that also occurs earlier (by doc_id, then line) is a later copy, and its
lines are deleted. Steps:

1. Lines get ids by content; lines that occur once leave. What is left are suffixes (document, line).
2. Distributed prefix doubling sorts the suffixes: the rank of 2^(k+1) lines comes from the ranks of the two halves. A
   half that is missing (the document ends, or a line that occurs once stands there) is a symbol of its own. The last
   ranks are the suffix array, to a depth that covers the longest run asked for.
3. The longest common prefix of each suffix with its neighbour in that order is found by descending the ranks of all
   levels: where the ranks of 2^k lines agree, both move on by 2^k lines.
4. Intervals of suffixes whose common prefixes reach a run's length are its copies: a new interval begins where the
   common prefix is shorter, and a running sum over the suffix order numbers them. The runs asked for are the shortest
   ones with enough words from each line onwards and up to each line; together they cover exactly the maximal repeated
   runs with enough words. The first member of an interval stays, later ones are deleted.

Overlapping repeats inside one document count like any others. Groups are only ever reduced (count, first place) and
joined, so a line or run that a third of all documents share is pre-aggregated in each task and split in the join.
Documents may have any number of lines. Lines are equal when their 128-bit hashes are.

Null and empty texts have one empty line, never deleted (it has no words). Rows that repeat with their doc_id are
copies in the order of their places in the table's files; null doc_ids come last. Extra columns, whatever their names,
are kept by `clean`. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, global_rank, join_checked, let, of_row, rows_of, running_sum, stage, text_or_empty, with_sparse

MIN_WORDS = 50


def windows(n_words: list[int], least: int) -> tuple[list[int], list[int]]:
    """For each line, the lines in the shortest run of `least` words that begins with it, and that ends with it; or 0."""
    n = len(n_words)
    onward, upto = [0] * n, [0] * n
    total = start = 0
    for end in range(n):
        total += n_words[end]
        while total - n_words[start] >= least:
            total -= n_words[start]
            start += 1
        if total >= least:
            upto[end] = end - start + 1
    total, end = 0, n - 1
    for start in range(n - 1, -1, -1):
        total += n_words[start]
        while total - n_words[end] >= least:
            total -= n_words[end]
            end -= 1
        if total >= least:
            onward[start] = end - start + 1
    return onward, upto


def _lines(rows: DataFrame, min_words: int) -> DataFrame:
    """rows(file, pos, text) -> a row for each line: file, pos, i, id1, id2 (128-bit content id), chars, onward, upto."""
    names = ["file", "pos", "i", "id1", "id2", "chars", "onward", "upto"]
    kinds = [pa.int64()] * 6 + [pa.int32()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in names]

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
            for c in cols:
                c.clear()
            return out

        for batch in batches:
            for file, pos, text in zip(batch.column("file").to_pylist(), batch.column("pos").to_pylist(), batch.column("text"), strict=True):
                lines = (text.as_py() or "").split("\n")
                data = [x.encode() for x in lines]
                ids = [xxhash.xxh3_128_intdigest(x) for x in data]
                onward, upto = windows([len(x.split()) for x in data], min_words)
                cols[0] += [file] * len(lines)
                cols[1] += [pos] * len(lines)
                cols[2] += range(len(lines))
                cols[3] += [(i >> 64) - (1 << 63) for i in ids]
                cols[4] += [(i & ((1 << 64) - 1)) - (1 << 63) for i in ids]
                cols[5] += map(len, lines)
                cols[6] += onward
                cols[7] += upto
                if len(cols[0]) > 50_000:
                    yield flush()
        if cols[0]:
            yield flush()

    return rows.select("file", "pos", "text").mapInArrow(run, "file long, pos long, i long, id1 long, id2 long, chars long, onward int, upto int")


def _ranked(rows: DataFrame, keys: list[str], name: str, least: int = 1) -> DataFrame:
    """rows with r: the rank of their keys, among those that occur at least `least` times."""
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(*keys)
    return stage(rows.join(global_rank(groups, [F.col(k) for k in keys], "r"), keys), name)


def suffix_order(first: DataFrame, depth: int) -> list[DataFrame]:
    """For first(d, i, r), the ranks of the lines that occur again: tables (d, i, r) with the ranks of 1, 2, 4 ... lines
    from each of them, until they cover `depth` lines; the last one is the order of the suffixes."""
    levels, k = [first], 0
    while (1 << k) < depth:
        level = levels[-1]
        half = level.select("d", (F.col("i") - (1 << k)).alias("i"), F.col("r").alias("r2"))
        none = F.col("r2").isNull()
        pairs = level.join(half, ["d", "i"], "left").select("d", "i", F.col("r").alias("r1"), F.coalesce("r2", F.lit(-1)).alias("r2"), F.when(none, F.col("d")).otherwise(-1).alias("own_d"), F.when(none, F.col("i")).otherwise(-1).alias("own_i"))
        pairs = stage(pairs, "halves")
        levels.append(_ranked(pairs, ["r1", "r2", "own_d", "own_i"], f"ranks-{k + 1}").select("d", "i", "r"))
        discard(pairs)
        k += 1
    return levels


def common_prefixes(levels: list[DataFrame]) -> DataFrame:
    """(d, i, place, lcp): the suffixes in order, and the lines that each shares with the one before it, to twice the
    depth of the last level less one."""
    order = stage(global_rank(levels[-1], [F.col("r"), F.col("d"), F.col("i")], "place"), "suffix-array")
    before = order.select((F.col("place") + 1).alias("place"), F.col("d").alias("e"), F.col("i").alias("j"))
    pairs = stage(order.join(before, "place", "left").select("d", "i", "place", "e", "j", F.lit(0).cast("long").alias("lcp")), "neighbours")
    for k in range(len(levels) - 1, -1, -1):
        mine = levels[k].select("d", F.col("i").alias("at"), F.col("r").alias("a"))
        theirs = levels[k].select(F.col("d").alias("e"), F.col("i").alias("to"), F.col("r").alias("b"))
        moved = pairs.withColumns({"at": F.col("i") + F.col("lcp"), "to": F.col("j") + F.col("lcp")}).join(mine, ["d", "at"], "left").join(theirs, ["e", "to"], "left")
        after = stage(moved.select("d", "i", "place", "e", "j", (F.col("lcp") + F.when(F.col("a") == F.col("b"), 1 << k).otherwise(0)).alias("lcp")), f"common-{k}")
        discard(pairs)
        pairs = after
    discard(order)
    return pairs.select("d", "i", "place", "lcp")


def deletions(rows: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For rows(row, at): the deleted lines (d, i, chars), the documents (doc_id, at, d) with d their rank by doc_id
    (null last) and place, and the sizes (file, pos, n_lines, n_chars)."""
    lines = stage(_lines(rows.select("at.file", "at.pos", of_row(text).alias("text")), min_words), "lines")
    whole = lines.groupBy("file", "pos").agg(F.count(F.lit(1)).alias("n_lines"), (F.sum("chars") + F.count(F.lit(1)) - 1).alias("n_chars"))
    ids = stage(rows.select(of_row("doc_id").alias("doc_id"), "at"), "ids")
    order = stage(global_rank(ids, [F.col("doc_id").isNull(), F.col("doc_id"), F.col("at")], "d"), "order")
    repeated = _ranked(lines, ["id1", "id2"], "repeated-lines", 2).drop("id1", "id2")
    repeated = stage(repeated.join(order.select("at.file", "at.pos", "d"), ["file", "pos"]).drop("file", "pos"), "repeated")
    asked = repeated.filter("onward > 0").select("d", "i", F.col("onward").alias("n")).union(repeated.filter("upto > 0").select("d", F.col("i") - F.col("upto") + 1, "upto"))
    asked = stage(asked.distinct(), "runs")
    levels = suffix_order(repeated.select("d", "i", "r"), asked.agg(F.max("n")).first()[0] or 1)
    suffixes = stage(common_prefixes(levels), "lcp-array")
    runs = suffixes.join(asked, ["d", "i"]).withColumn("begins", (F.col("lcp") < F.col("n")).cast("int"))
    numbered = stage(running_sum(runs, [F.col("n"), F.col("place")], F.col("begins"), "interval"), "intervals")
    firsts = numbered.groupBy("interval").agg(F.min(F.struct("d", "i")).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    later = join_checked(numbered, stage(firsts, "firsts"), ["interval"]).filter(F.struct("d", "i") != F.col("first"))
    gone = later.select("d", F.explode(F.sequence(F.col("i"), F.col("i") + F.col("n") - 1)).alias("i")).distinct()
    out = stage(repeated.select("d", "i", "chars").join(gone, ["d", "i"], "left_semi"), "deleted")
    discard(*levels[1:], suffixes, numbered, repeated, asked, ids)
    return out, order, whole


def report(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, files: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_lines, n_deleted, n_chars (of the text that stays), deleted (line numbers from
    0). `files`: see common.rows_of."""
    gone, order, whole = deletions(rows_of(docs, files), text, min_words)
    per = gone.groupBy("d").agg(F.count(F.lit(1)).alias("k"), F.sum("chars").alias("c"), F.sort_array(F.collect_list("i")).alias("deleted"))
    k = F.coalesce("k", F.lit(0))
    left = F.when(k == F.col("n_lines"), 0).otherwise(F.col("n_chars") - F.coalesce("c", F.lit(0)) - k)
    out = whole.join(order.select("doc_id", "d", "at.file", "at.pos"), ["file", "pos"]).join(per, "d", "left")
    return out.select("doc_id", "n_lines", k.alias("n_deleted"), left.alias("n_chars"), F.coalesce("deleted", F.array().cast("array<bigint>")).alias("deleted"))


def clean(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, files: bool = False) -> DataFrame:
    """docs without the later copies of repeated runs."""
    rows = rows_of(docs, files)
    gone, order, _ = deletions(rows, text, min_words)
    per = stage(gone.groupBy("d").agg(F.collect_list("i").alias("gone")).join(order, "d").select("at", "gone"), "gone")
    lines = F.split(text_or_empty(of_row(text)), "\n")
    numbers = lambda x: F.array_except(F.sequence(F.lit(0).cast("long"), F.size(x).cast("long") - 1), F.col("gone"))
    left = let(lines, lambda x: F.array_join(F.transform(numbers(x), lambda n: F.get(x, n.cast("int"))), "\n"))
    out = with_sparse(rows, per)
    cleaned = F.when(F.col("gone").isNull(), of_row(text)).otherwise(left)
    return out.select(*[(cleaned if c == text else of_row(c)).alias(c) for c in docs.columns])
