"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies that each of its documents should get. The whole part is
certain; the fraction is a probability, equal for all documents of the source. Dependent rounding pairs two
documents that are still open and moves mass (probability times size) from one to the other, in a random direction
whose expectation is zero, until one of the two is 0 or 1. The mass of the source never changes on the way, so the
words taken miss the target by less than one document.

Documents fold in blocks of about `block` rows, each leaving at most one open document; those fold again, block by
block, up to one root for each source: a reduction tree whose levels are plain groupings. A source that holds a
third of all rows is a third of the blocks. Random numbers are hashes of the two documents, so reruns agree.

Null text has size 0, null source is a source of its own (last in the order), documents of size 0 take the whole
part only. Rows that repeat, or share an id, are documents of their own. Extra columns, whatever their names, do no
harm. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold_key, global_rank, join_checked, let, n_words, of_row, rows_of, stage, unpacked

WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """A row for each source of sizes(_k, _kn, size): n, source_size, target.

    The sources share `share` times all sizes by weight; none gets more than `most` times its size. What a source
    can't take goes to the others by weight: the level at which a unit of weight stands rises until the capped
    sources no longer change. Each step brings two sums to the driver.
    """
    by = sizes.groupBy("_k", "_kn").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    ranked = global_rank(by, [F.col("_kn"), F.col("_k")], "_rank")
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = stage(ranked.withColumn("_weight", cycle), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("source_size") * F.lit(most) <= F.col("_weight") * F.lit(level)
        row = table.agg(F.sum(full.cast("long")), F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("_weight")))).first()
        if (row[0] or 0) == capped or not row[2]:
            break
        capped, level = row[0] or 0, (share * total - most * (row[1] or 0)) / row[2]
    return table.withColumn("target", F.least(F.col("source_size") * F.lit(float(most)), F.col("_weight") * F.lit(float(level)))).drop("_rank", "_weight")


def _uniform(*cols: Column) -> Column:
    """A number in [0, 1) from the hash of cols."""
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1))).cast("double") / F.lit(float(1 << 53))


def _item(x: Column, p: Column) -> Column:
    return F.struct(x["u"].alias("u"), x["row"].alias("row"), x["size"].alias("size"), p.cast("double").alias("p"))


def _fold(items: Column, done_type: str, seed: int) -> Column:
    """One pass of pairings over an array of open items: the one left open, and (row, copies) of the others."""

    def pair(acc, x):
        c = acc["open"]
        a, b = c["size"], x["size"]
        up = F.struct((a * (1 - c["p"])).alias("c"), (b * x["p"]).alias("x"))  # what c can still take, what x can give
        down = F.struct((a * c["p"]).alias("c"), (b * (1 - x["p"])).alias("x"))

        def choose(m):
            take, give = F.least(m["up"]["c"], m["up"]["x"]), F.least(m["down"]["c"], m["down"]["x"])
            rise = _uniform(c["u"], x["u"], F.lit(seed)) * (take + give) < give  # c rises with probability give/(take+give)
            rise = rise | (take + give == 0) | (take == 0)
            closed = lambda it, n: F.array(F.struct(it["row"].alias("row"), F.lit(n).alias("copies")))
            nxt = lambda it, p, out: F.struct(_item(it, p).alias("open"), F.concat(acc["done"], out).alias("done"))
            return F.when(
                rise,
                F.when(m["up"]["c"] <= m["up"]["x"], nxt(x, (m["up"]["x"] - take) / b, closed(c, 1))).otherwise(nxt(c, c["p"] + take / a, closed(x, 0))),
            ).otherwise(
                F.when(m["down"]["c"] <= m["down"]["x"], nxt(x, x["p"] + give / b, closed(c, 0))).otherwise(nxt(c, (m["down"]["c"] - give) / a, closed(x, 1))),
            )

        return let(F.struct(up.alias("up"), down.alias("down")), choose)

    zero = F.struct(_item(items[0], items[0]["p"]).alias("open"), F.array().cast(done_type).alias("done"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items), F.lit(1))), zero, pair)


def _numbered(sizes: DataFrame) -> DataFrame:
    """sizes(_k, _kn, key, u, size, _part) with u made different for rows that are equal in it, by their number among them.

    Equal rows are numbered within the task that wrote them and then across tasks, so a name that a third of all rows have
    is many tasks; names that stand alone keep u. Which of equal rows has which number does not matter.
    """
    name = ["_k", "_kn", "u"]
    several = stage(sizes.groupBy(*name).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*name, F.lit(True).alias("_equal")), "equal-names")
    if not several.limit(1).count():
        return sizes.drop("_part")
    marked = join_checked(sizes, several, name, "left")
    counts = marked.filter("_equal").groupBy(*name, "_part").agg(F.count(F.lit(1)).alias("_c"))
    along = Window.partitionBy(*name).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    before = stage(counts.select(*name, "_part", F.coalesce(F.sum("_c").over(along), F.lit(0)).alias("_before")), "equal-before")
    inside = F.row_number().over(Window.partitionBy(*name, "_part").orderBy("size"))
    equal = join_checked(marked.filter("_equal").withColumn("_i", inside), before, [*name, "_part"])
    nth = F.col("_i") - 1 + F.col("_before")
    equal = equal.withColumn("u", F.when(nth > 0, F.xxhash64("u", nth)).otherwise(F.col("u")))
    return stage(equal.select(*sizes.columns).unionByName(marked.filter("_equal is null").select(*sizes.columns)).drop("_part"), "numbered")


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17, block: int = 64) -> DataFrame:
    """For rows(key, name, source, size): key, _k and _kn (the source), size, source_size, target, copies.

    `key` is carried along. `name` seeds a row's random numbers; rows of one name and size are interchangeable, and are dealt
    over blocks like others.
    """
    sizes = _numbered(stage(fold_key(rows, "source").select("_k", "_kn", "key", F.xxhash64("name").alias("u"), "size", F.spark_partition_id().alias("_part")), "sizes"))
    sources = stage(source_targets(sizes, weights, share, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    every = join_checked(sizes, sources, ["_k", "_kn"]).withColumns({"_whole": F.floor(rate).cast("int"), "_p": rate - F.floor(rate)})
    opens = (F.col("size") > 0) & (F.col("_p") > 0)
    done_type = f"array<struct<row:struct<key:{sizes.schema['key'].dataType.simpleString()},size:bigint>,copies:int>>"
    item = F.struct(F.xxhash64("u", F.lit(seed)).alias("u"), F.struct("key", "size").alias("row"), F.col("size").cast("double").alias("size"), F.col("_p").alias("p"))
    blocks = F.ceil(F.col("n") / block)
    level = every.filter(opens).select("_k", "_kn", F.pmod(F.xxhash64("u", F.lit(seed + 1)), blocks).alias("blk"), item.alias("it"))
    deepest = every.agg(F.max(blocks)).first()[0] or 1
    parts = []
    while True:
        folded = level.groupBy("_k", "_kn", "blk").agg(_fold(F.sort_array(F.collect_list("it")), done_type, seed).alias("f"))
        folded = stage(folded.select("_k", "_kn", "blk", "f.open", "f.done"), "folded")
        parts.append(folded.select("_k", "_kn", F.explode("done").alias("d")).select("_k", "_kn", "d.row", "d.copies"))
        if deepest <= 1:
            break
        deepest = -(-deepest // block)
        level = folded.select("_k", "_kn", F.floor(F.col("blk") / block).alias("blk"), F.col("open").alias("it"))
    root = (_uniform(F.col("open.u"), F.lit(seed)) < F.col("open.p")).cast("int")
    parts.append(folded.select("_k", "_kn", F.col("open.row").alias("row"), root.alias("copies")))
    rounded = parts[0]
    for p in parts[1:]:
        rounded = rounded.union(p)
    rounded = rounded.select("_k", "_kn", "row.key", "row.size", "copies").unionByName(every.filter(~opens).select("_k", "_kn", "key", "size", F.lit(0).alias("copies")))
    out = join_checked(rounded, sources, ["_k", "_kn"])
    return out.select("key", "_k", "_kn", "size", "source_size", "target", (F.floor(rate).cast("int") + F.col("copies")).alias("copies"))


def _units(rows: DataFrame, key: Column, text: str, source: str) -> DataFrame:
    """For rows(row, at): what `mix` needs. Texts are measured in place; none is shuffled."""
    name = F.struct(of_row("doc_id").alias("doc_id"), F.xxhash64(of_row(text)).alias("text"))
    return rows.select(key.alias("key"), name.alias("name"), of_row(source).alias("source"), n_words(of_row(text)).alias("size"))


def report(docs: DataFrame, text: str = "text", source: str = "source", **how) -> DataFrame:
    """One row for each document: what the mix takes of it."""
    rows = docs.select(F.struct("doc_id", F.col(f"`{text}`"), F.col(f"`{source}`")).alias("row"))
    taken = mix(_units(rows, of_row("doc_id"), text, source), **how)
    return taken.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, text: str = "text", source: str = "source", files: bool = False, **how) -> DataFrame:
    """The mix itself: docs with each row as often as the mix takes it. `files`: see common.rows_of.

    Every row is a unit of its own, told by its place in its file. Of rows that are equal in id and text, it is not
    fixed which are taken, only how many.
    """
    rows = rows_of(docs, files)
    taken = stage(mix(_units(rows, F.col("at"), text, source), **how).filter("copies > 0").select(F.col("key").alias("at"), "copies"), "copies")
    times = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth")
    return unpacked(join_checked(rows, taken, ["at"]).select("row", times), docs.columns)
