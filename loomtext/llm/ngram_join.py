"""Jaccard self-join on word shingles with adaptive multi-match prefixes.

Two sets link when 100 * intersection >= 80 * union (`percent`). Equal sets are one node from the start. A set's
tokens stand in the order of their hashes. With c the least overlap of a set of n tokens with any partner, its
prefix of n - c + l tokens must share l tokens with the prefix of a partner, for every l: a longer prefix asks for
more matches. The steps, each of which loses no link:

1. Every text is cut into shingles once and stages the longest prefix that it may need. In its shortest one (l = 1) a
   set whose tokens occur nowhere else has no partner and is done; for the others the lengths of their tokens' lists
   estimate the cost of their candidates.
2. Tokens on very long lists ("heavy": popular passages), held in a Bloom filter, take no part in finding pairs; what
   the filter lets pass counts as heavy everywhere. A set's l starts with its cost and grows until its prefix has
   h < l heavy tokens: it then needs l - h matches among the others, and a pair needs the smaller of its two numbers.
3. Sets for which l would exceed 16 % of their tokens are dense, nearly all heavy: members of large families of near
   copies. What many of them share outside of their prefixes is heavy too. Among themselves they join on prefixes with
   light tokens first: verified stars around the set that has fewest of those tie most of a family together, and only
   pairs between different components, close enough in size and in the place of the token, are then compared, and only
   if they share every large bundle that sets of their sizes must share: tokens that always stand together, as those of
   a popular passage do, are matched at once. No family is expanded into its pairs. To the other sets they offer all
   their light tokens.
4. Pairs that can still reach the overlap are verified on the complete sets, links become components. Complete sets are
   cut again from the texts that are asked for, found in place by a Bloom filter; texts never move.

The plan is the same at every size. Null and empty texts have an empty set and link with nothing. Rows may repeat, with
or without equal doc_id, and doc_id may be null. Extra columns, whatever their names, do no harm. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shingles
from .common import BROADCAST_BYTES, SPACES, Bloom, discard, join_checked, measured_bytes, of_row, picked, rows_of, stage, text_or_empty, unpacked, without
from .components import components

HEAVY = 64
LONGEST = 0.16  # of a set's tokens, by which its prefix may grow
K, PERCENT = 5, 80


def _least_own(n, percent):
    """The least overlap of a set of n tokens with any partner."""
    return (percent * n + 99) // 100


def _needed(na: Column, nb: Column, percent: int) -> Column:
    """The overlap that two sets need: the ceiling of percent (na + nb) / (100 + percent)."""
    return F.ceil((na + nb) * percent / F.lit(100.0 + percent) - 1e-9)


def _sized(na: Column, nb: Column, percent: int) -> Column:
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent)


def _arrow_pass(rows: DataFrame, keep: list[str], made: str, make, k: int) -> DataFrame:
    """mapInArrow over rows(text, *keep): keep, and the columns `made`, whose values make(set) gives; the last is an array."""
    kept = rows.select(*keep).dtypes
    names = [*keep, *[c.split()[0] for c in made.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, weight, at = [], 0, 0
            for i, s in enumerate(shingles.sets_of(batch.column("text"), k)):
                got.append(make(s))
                weight += len(got[-1][-1])
                if weight > 500_000:
                    yield pack(batch.slice(at, len(got)), got)
                    got, weight, at = [], 0, i + 1
            if got:
                yield pack(batch.slice(at, len(got)), got)

    def pack(part, got):
        cols = [list(c) for c in zip(*got, strict=True)]
        arrays = [shingles.lists(c) if isinstance(c[0], np.ndarray) else pa.array(c) for c in cols]
        return pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *arrays], names=names)

    return rows.select("text", *keep).mapInArrow(run, ", ".join([*[f"`{c}` {t}" for c, t in kept], made]))


def _sets(rows: DataFrame, nodes: DataFrame, text: str, k: int) -> DataFrame:
    """(node, n, toks): the complete sets of the staged nodes(node, at, ...).

    A Bloom filter of the nodes' places picks their rows in place, so that only texts that are asked for are cut into
    shingles, and only their sets move; no text does, at any number of nodes.
    """
    texts = picked(rows, nodes).select(of_row(text).alias("text"), "at.file", "at.pos")
    sets = _arrow_pass(texts, ["file", "pos"], "n long, toks array<long>", lambda s: (len(s), s), k)
    return nodes.select("node", "at.file", "at.pos").join(sets, ["file", "pos"]).select("node", "n", "toks")


def verified(rows: DataFrame, pairs: DataFrame, nodes: DataFrame, text: str, k: int, percent: int) -> DataFrame:
    """Of the staged pairs(a, b), those whose sets link. Each pair carries one set to the other; nothing is grouped."""
    if not pairs.limit(1).count():
        return pairs
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = stage(nodes.join(ends, "node", "left_semi"), "ends")
    sets = stage(_sets(rows, wanted, text, k).select("node", "toks"), "sets")
    full = pairs.join(sets.withColumnsRenamed({"node": "b", "toks": "tb"}), "b").join(sets.withColumnsRenamed({"node": "a", "toks": "ta"}), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, out = batch.column("ta"), batch.column("tb"), []
            av, bv = a.values.to_numpy().view(np.uint64), b.values.to_numpy().view(np.uint64)
            ao, bo = a.offsets.to_numpy(), b.offsets.to_numpy()
            for i in range(len(batch)):
                x, y = av[ao[i] : ao[i + 1]], bv[bo[i] : bo[i + 1]]
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                out.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(out, pa.bool_()))

    return full.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def _lists_met(entries: DataFrame, heads: DataFrame, hot: int = 1000, most: int = BROADCAST_BYTES) -> DataFrame:
    """entries(tok, ...) joined with heads(tok, c, ...), one row for each token, c the length of its list.

    Heads of long lists that fit a broadcast go to all tasks, the longest first, so that such a list stays where it
    lies; all others are shuffled. A list too long for one task is among the first: there are at most entries / c of
    lists of length c.
    """
    heads = stage(heads, "heads")
    by_power = F.floor(F.log2("c"))
    width = measured_bytes(heads.filter(F.col("c") > hot))
    if width > most:  # lists are taken by powers of two of their lengths, from the longest on, while their heads fit
        sizes = dict(heads.filter(F.col("c") > hot).groupBy(by_power.alias("p")).agg(F.count(F.lit(1)).alias("k")).collect())  # at most 64 rows
        each, total = width / sum(sizes.values()), 0
        for p in sorted(sizes, reverse=True):
            total += sizes[p] * each
            if total > most:
                hot = max(hot, 2 ** (p + 1) - 1)
                break
    long = heads.filter(F.col("c") > hot)
    met = entries.join(F.broadcast(long), "tok")
    rest = entries.join(F.broadcast(long.select("tok")), "tok", "left_anti").join(heads.filter(F.col("c") <= hot), "tok")
    return met.unionByName(rest)


def _dense_tokens(rows: DataFrame, nodes: DataFrame, text: str, k: int, heavy: int) -> DataFrame:
    """(tok) on more than `heavy` of the complete sets of nodes(node, at); each task adds up its own sets first, over all its
    batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toks, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            sets = list(shingles.sets_of(batch.column("text"), k))
            toks, c = _added_up(np.concatenate([toks, *sets]), np.concatenate([c, np.ones(sum(map(len, sets)), np.int64)]))
            if len(toks) > 1_000_000:
                yield from told(toks, c)
                toks, c = toks[:0], c[:0]
        yield from told(toks, c)

    def told(toks, c):
        for at in range(0, len(toks), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(toks[at : at + 100_000].view(np.int64)), pa.array(c[at : at + 100_000])], names=["tok", "c"])

    texts = picked(rows, nodes).select(of_row(text).alias("text"), "at.file", "at.pos")  # and some that the filter of places lets pass
    texts = join_checked(texts, nodes.select("at.file", "at.pos"), ["file", "pos"], "left_semi")
    counts = texts.select("text").mapInArrow(run, "tok long, c long")
    return counts.groupBy("tok").agg(F.sum("c").alias("c")).filter(F.col("c") > heavy).select("tok")


def _added_up(toks: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens with the sums of their counts."""
    toks, at = np.unique(toks, return_inverse=True)
    return toks, np.bincount(at, weights=c, minlength=len(toks)).astype(np.int64)


def _dense_sets(rows: DataFrame, nodes: DataFrame, heavy: Bloom, text: str, k: int, percent: int) -> DataFrame:
    """(node, n, pos, light, front) of the dense nodes(node, at): the light tokens with their places among all, and the
    prefix that one match is asked of, light tokens first."""
    test = heavy.in_tasks()

    def made(s: np.ndarray):
        load = test(s)
        front = np.concatenate((s[~load], s[load]))[: len(s) - _least_own(len(s), percent) + 1]
        return len(s), np.flatnonzero(~load).astype(np.uint64), s[~load], front

    texts = picked(rows, nodes).select(of_row(text).alias("text"), "at.file", "at.pos")
    sets = _arrow_pass(texts, ["file", "pos"], "n long, places array<long>, light array<long>, front array<long>", made, k)
    return nodes.select("node", "at.file", "at.pos").join(sets, ["file", "pos"]).select("node", "n", F.col("places").alias("pos"), "light", "front")


def _dense_entries(dense: DataFrame) -> DataFrame:
    """(tok, node, n, pos): prefixes of dense(node, n, front), without the tokens of a single set."""
    entries = dense.select("node", "n", F.posexplode("front").alias("pos", "tok")).select("tok", "node", "n", F.col("pos").cast("long").alias("pos"))
    return _lists_met(entries, entries.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")).drop("c")


def _stars(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the sets in each token's list with the one that has the token first in its order."""
    heads = entries.groupBy("tok").agg(F.min(F.struct("pos", "node", "n")).alias("h"), F.count(F.lit(1)).alias("c"))
    star = _lists_met(entries, heads).filter(F.col("node") != F.col("h.node")).filter(_sized(F.col("n"), F.col("h.n"), percent))
    star = star.filter(F.least(F.col("n") - F.col("pos"), F.col("h.n") - F.col("h.pos")) >= _needed(F.col("n"), F.col("h.n"), percent))
    return star.select(F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b")).distinct()


def _size_band(n: Column, ratio: float = 1.06) -> Column:
    return F.floor(F.log(n.cast("double")) / float(np.log(ratio)))


def _passages(rows: DataFrame, nodes: DataFrame, text: str, k: int, percent: int) -> DataFrame:
    """(node, big): the large bundles of the staged nodes(node, at), as an array of (w, x, y).

    A bundle is all the tokens of a set that stand in the very same sets of `nodes`: mostly the inside of one passage.
    A partner has a bundle whole or not at all. x and y are its name, made of the sets that it stands in, and w is its
    number of tokens. Only bundles that no partner can lack at equal sizes are told, so a node has few of them.
    """
    entries = stage(_sets(rows, nodes, text, k).select("node", "n", F.explode("toks").alias("tok")), "bundle-entries")
    named = entries.groupBy("tok").agg(F.count(F.lit(1)).alias("c"), F.expr("bit_xor(xxhash64(node, 1))").alias("x"), F.expr("bit_xor(xxhash64(node, 2))").alias("y"))
    bundles = _lists_met(entries, named).groupBy("node", "x", "y").agg(F.count(F.lit(1)).alias("w"), F.max("n").alias("n"))
    large = bundles.filter(F.col("w") * (100 + percent) > F.col("n") * (100 - percent))
    out = large.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("x", "y", "w"))).alias("big"))
    out = stage(out, "bundles")
    discard(entries)
    return out


def _must_share(big: Column, ba: Column, bb: Column, percent: int, ratio: float = 1.06) -> Column:
    """A hash of the bundles that two linked sets in the size bands ba and bb have both or neither.

    Of sets of n and m tokens that link, the first has at most (n - p m) / (1 + p) tokens that the second lacks.
    """
    p, low, high = percent / 100.0, lambda b: F.pow(F.lit(ratio), b), lambda b: F.pow(F.lit(ratio), b + 1)
    most = F.greatest(high(ba) - p * low(bb), high(bb) - p * low(ba)) / (1 + p) + 1e-6
    return F.xxhash64(F.transform(F.filter(big, lambda g: g["w"] > most), lambda g: F.struct(g["x"], g["y"])))


def _across(entries: DataFrame, roots: DataFrame, rows: DataFrame, nodes: DataFrame, text: str, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of sets in different components (node, root) that share a token of their prefixes and all the large
    bundles that sets of their sizes must share, and can link."""
    rooted = stage(join_checked(entries, roots, ["node"], "left").withColumn("root", F.coalesce("root", "node")), "dense-rooted")
    per = rooted.groupBy("tok", "root").agg(F.count(F.lit(1)).alias("k"))
    main = per.groupBy("tok").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("k", "root")).alias("top"), F.sum("k").alias("c")).filter("roots > 1")
    mixed = stage(_lists_met(rooted, main.select("tok", "c", F.col("top.root").alias("main"))), "mixed-lists")
    met = stage(nodes.join(mixed.select("node").distinct(), "node", "left_semi").select("node", "at"), "mixed-nodes")
    big = _passages(rows, met, text, k, percent)
    none = F.array().cast(big.schema["big"].dataType)
    mixed = join_checked(mixed, big, ["node"], "left").withColumn("big", F.coalesce("big", none))
    # a partner of size m at best has its token in front: n - pos >= percent (n + m) / (100 + percent) bounds m
    n, pos = F.col("n"), F.col("pos")
    largest = F.least(n * 100.0 / percent, (n - pos) * (100.0 + percent) / percent - n)
    smallest = n * percent / 100.0
    mixed = mixed.filter(largest >= smallest).withColumns({"own": _size_band(n), "other": F.explode(F.sequence(_size_band(smallest - 1e-6), _size_band(largest + 1e-6)))})
    shown = lambda df, x, own, other: df.select(
        "tok", F.col("own").alias(own), F.col("other").alias(other), _must_share(F.col("big"), F.col("own"), F.col("other"), percent).alias("must"), F.struct("node", "n", "pos", "root").alias(x)
    )
    probes = shown(mixed.filter(F.col("root") != F.col("main")), "p", "b1", "b2")
    near = probes.join(shown(mixed, "q", "b2", "b1"), ["tok", "b1", "b2", "must"]).filter("p.root <> q.root").filter(_sized(F.col("p.n"), F.col("q.n"), percent))
    near = near.filter(F.least(F.col("p.n") - F.col("p.pos"), F.col("q.n") - F.col("q.pos")) >= _needed(F.col("p.n"), F.col("q.n"), percent))
    return near.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct()


def _nodes(rows: DataFrame, text: str, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """For rows(row, at): base, the staged table of prefixes; ids (doc_id, file, pos, n, digest) of all rows, nodes (node, digest, at, doc_id), one for each
    distinct set, and prefixes (file, pos, n, toks), the longest that may be asked for, of the rows that stand for a node."""
    longest = lambda s: (len(s), shingles.digest(s), s[: len(s) - _least_own(len(s), percent) + int(len(s) * LONGEST) + 1])
    texts = rows.select(of_row(text).alias("text"), of_row("doc_id").alias("doc_id"), "at.file", "at.pos")
    base = stage(_arrow_pass(texts, ["doc_id", "file", "pos"], "n long, digest binary, toks array<long>", longest, k), "base")
    ids = stage(base.select("doc_id", "file", "pos", "n", "digest"), "ids")
    own = ids.filter("n > 0").withColumns({"at": F.struct("file", "pos"), "id": F.struct(F.col("doc_id").isNull().alias("z"), "doc_id")})
    heads = own.groupBy("digest").agg(F.min("at").alias("at"), F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    nodes = stage(heads.select(F.monotonically_increasing_id().alias("node"), "digest", "at", "id.doc_id", "copies"), "nodes")
    several = nodes.filter("copies > 1").select("digest", F.col("at").alias("head"))
    copies = stage(own.select("digest", "at").join(several, "digest").filter("at <> head").select("at"), "copies")
    return base, ids, nodes, without(base.filter("n > 0").select("file", "pos", F.struct("file", "pos").alias("at"), "n", "toks"), copies).drop("at")


def _adapted(known: DataFrame, heavy: Bloom, percent: int) -> DataFrame:
    """known(node, n, cost, toks) -> node, n, ell, h, dense, and pos and toks of the prefix's tokens that are not heavy.

    ell, the matches asked for, begins with the logarithm of the estimated cost and grows until fewer of the prefix's
    tokens than that are heavy; a set for which it would exceed its bound is dense and shows no prefix.
    """
    test = heavy.in_tasks()

    def one(n: int, cost: int, s: np.ndarray):
        most = min(int(n * LONGEST) + 1, _least_own(n, percent))
        ell = min(most, int(n * min(LONGEST, 0.02 * int(cost).bit_length())) + 1)
        front = n - _least_own(n, percent)
        load = test(s)
        h = np.cumsum(load)[front + ell - 1 : front + most]
        fits = np.flatnonzero(h < np.arange(ell, most + 1))
        if not len(fits):
            return most, int(h[-1]), True, np.zeros(0, np.int32), s[:0]
        ell, h = ell + int(fits[0]), int(h[fits[0]])
        at = np.flatnonzero(~load[: front + ell])
        return ell, h, False, at.astype(np.int32), s[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toks = batch.column("toks")
            values, ends = toks.values.to_numpy().view(np.uint64), toks.offsets.to_numpy()
            got = [one(n, c, values[ends[i] : ends[i + 1]]) for i, (n, c) in enumerate(zip(batch.column("n").to_pylist(), batch.column("cost").to_pylist(), strict=True))]
            ell, h, dense, pos, light = map(list, zip(*got, strict=True)) if got else [[]] * 5
            places = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, pos)]).astype(np.int32)), pa.array(np.concatenate(pos) if pos else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.array(ell, pa.int64()), pa.array(h, pa.int64()), pa.array(dense, pa.bool_()), places, shingles.lists(light)], names=["node", "n", "ell", "h", "dense", "pos", "toks"])

    return known.select("node", "n", "cost", "toks").mapInArrow(run, "node long, n long, ell long, h long, dense boolean, pos array<int>, toks array<long>")


def _pairs(prefixes: DataFrame, dense: DataFrame | None, percent: int) -> DataFrame:
    """Pairs (a, b) with a set that is not dense, which share as many light tokens as asked for and can still link."""
    shown = lambda df, toks, flag: df.select("node", F.posexplode(toks).alias("i", "tok"), "pos").select("tok", "node", F.get("pos", F.col("i")).cast("int").alias("pos"), F.lit(flag).alias("dense"))
    entries = shown(prefixes.filter("not dense"), "toks", False)
    entries = entries.unionByName(shown(dense, "light", True)) if dense else entries
    lists = Window.partitionBy("tok")  # short ones: light tokens
    entries = entries.withColumns({"c": F.count(F.lit(1)).over(lists), "l": F.count_if(~F.col("dense")).over(lists)}).filter("c > 1 and l > 0").drop("c", "l")
    entries = stage(entries.join(prefixes.select("node", "n", "ell", "h"), "node"), "light-entries")
    side = lambda df, x: df.select("tok", F.struct("node", "n", "ell", "h", "pos").alias(x), F.col("dense").alias(f"d{x}"))
    pairs = side(entries.filter("not dense"), "a").join(side(entries, "b"), "tok").filter("db or a.node < b.node").filter(_sized(F.col("a.n"), F.col("b.n"), percent))
    asked = F.least(F.col("a.ell") - F.col("a.h"), F.when(F.col("db"), F.lit(1 << 40)).otherwise(F.col("b.ell") - F.col("b.h")))
    spared = F.when(F.col("db"), F.col("a.h")).otherwise(F.least("a.h", "b.h"))
    grouped = pairs.groupBy(F.col("a.node").alias("a"), F.col("b.node").alias("b")).agg(
        F.count(F.lit(1)).alias("s"), F.max("a.pos").alias("pa"), F.max("b.pos").alias("pb"), F.max("a.n").alias("na"), F.max("b.n").alias("nb"), F.max(asked).alias("asked"), F.max(spared).alias("h")
    )
    reach = F.col("s") + F.col("h") + F.least(F.col("na") - 1 - F.col("pa"), F.col("nb") - 1 - F.col("pb"))
    return grouped.filter((F.col("s") >= F.col("asked")) & (reach >= _needed(F.col("na"), F.col("nb"), percent))).select("a", "b")


def link_rows(rows: DataFrame, text: str = "text", k: int = K, percent: int = PERCENT, heavy: int = HEAVY) -> DataFrame:
    """For rows(row, at): doc_id, at, n_shingles, root (a number that linked rows share; null without shingles),
    component_id, n_verified (links of the row's set that were verified: in a large family those that tie it together)."""
    base, ids, nodes, alone = _nodes(rows, text, k, percent)

    # 1. which sets share a token of their shortest prefixes with another set's longest, and with how many
    tokens = alone.select(F.explode("toks").alias("tok"))
    shared = stage(tokens.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "shared-tokens")
    short = F.slice("toks", F.lit(1), (F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1).cast("int"))
    first = alone.select("file", "pos", F.explode(short).alias("tok")).filter(Bloom(shared, F.col("tok")).holds(F.col("tok")))
    live = stage(first.join(shared, "tok").groupBy("file", "pos").agg(F.sum(F.col("c") - 1).alias("cost")), "live")
    known = nodes.select("node", "at.file", "at.pos").join(live, ["file", "pos"]).join(alone, ["file", "pos"])
    known = stage(known.select("node", "n", "cost", "toks"), "known")
    discard(base)

    # 2. heavy tokens: on long lists of prefixes, or in many of the sets that are dense by those
    tokens = stage(shared.filter(F.col("c") > heavy).select("tok"), "long-lists")
    places = lambda df: nodes.join(df.filter("dense").select("node"), "node", "left_semi").select("node", "at")
    if tokens.limit(1).count():
        families = stage(places(_adapted(known, Bloom(tokens, F.col("tok")), percent)), "dense-nodes")
        if families.limit(1).count():
            tokens = stage(tokens.union(_dense_tokens(rows, families, text, k, heavy)), "heavy-tokens")

    # 3. prefixes of all others; families of near copies
    prefixes = stage(_adapted(known, Bloom(tokens, F.col("tok")), percent), "adapted")
    discard(known, shared)
    families = stage(places(prefixes), "dense-nodes")
    dense = stars = across = None
    if families.limit(1).count():
        dense = stage(_dense_sets(rows, families, Bloom(tokens, F.col("tok")), text, k, percent), "dense-sets")
        entries = stage(_dense_entries(dense), "dense-entries")
        stars = stage(verified(rows, stage(_stars(entries, percent), "stars"), nodes, text, k, percent), "star-links")
        across = stage(_across(entries, stage(components(stars), "star-roots"), rows, nodes, text, k, percent), "across")

    # 4. all other pairs
    pairs = stage(_pairs(prefixes, dense, percent), "light-pairs")
    discard(prefixes, *([dense] if dense else []))
    pairs = stage(across.union(pairs).distinct(), "all-pairs") if across else pairs
    links = stage(verified(rows, pairs, nodes, text, k, percent), "links")
    links = stars.union(links) if stars else links

    # 5. components of nodes, then of rows
    roots = stage(components(links), "roots")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_verified"))
    placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(degree, "node", "left")
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    final = stage(placed.join(least, "root").select("digest", "root", "component_id", F.coalesce("n_verified", F.lit(0)).alias("n_verified")), "placed")
    at = F.struct("file", "pos").alias("at")
    with_set = ids.filter("n > 0").join(final, "digest").select("doc_id", at, F.col("n").alias("n_shingles"), "root", "component_id", "n_verified")
    empty = ids.filter("n = 0").select("doc_id", at, F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_verified"))
    return with_set.union(empty)


def link_components(docs: DataFrame, text: str = "text", files: bool = False, **how) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, n_verified. `files`: see common.rows_of."""
    return link_rows(rows_of(docs, files), text, **how).drop("at", "root")


def keep_one(docs: DataFrame, text: str = "text", files: bool = False, **how) -> DataFrame:
    """One row of each component, that of the smallest doc_id (null last), then place, with the columns of docs.

    Rows are told apart by their places, so ids may be null or repeat. Rows without shingles are linked to none; of
    those that share a doc_id and a text one stays.
    """
    rows = rows_of(docs, files)
    linked = stage(link_rows(rows, text, **how).filter(F.col("root").isNotNull()).select("root", "doc_id", "at"), "linked")
    order = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("at"))
    stays = linked.groupBy("root").agg(F.min(order).alias("h")).select("root", F.col("h.at").alias("head"))
    gone = linked.join(stays, "root").filter("at <> head").select("at")
    bare = rows.filter(F.btrim(text_or_empty(of_row(text)), F.lit(SPACES)) == "").select(of_row("doc_id").alias("doc_id"), of_row(text).alias("text"), "at")
    bare = bare.filter("doc_id is not null").select("doc_id", F.struct("text").alias("t"), "at")
    first = bare.groupBy("doc_id", "t").agg(F.min("at").alias("head"))
    gone = gone.union(bare.join(first, ["doc_id", "t"]).filter("at <> head").select("at"))
    return unpacked(without(rows, stage(gone, "near-copies")), docs.columns)
